"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its leading
token, a variable one as a wildcard.  In a leaf lines merge by similarity: the
tokens after the leading one are four quarters, and lines that agree in all of
them, in any three or in any two are a group, whose template has wildcards for
the quarters in which they differ.  So fields that vary are found wherever they
stand, if they lie in two quarters at most, without an order in which lines
come and without a search among the groups of a leaf: each line has at most six
candidates (one that is wider than another stands for it), and a template that recurs in enough different texts is dropped
with every line that has it.

A token is variable if it holds a digit, ``@``, a slash or a backslash.  At
least half of a line's tokens must be constant in a template, three quarters
if one token is open, and with open quarters ``least`` of them, so that tables of numbers and lines of a few common
words don't fall together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .wordhash import hash_words, mix64, text_buffers, word_spans

_U = np.uint64
_WILD = _U(0x5DEECE66D1CE4E5B)
_VARIABLE = np.zeros(256, dtype=np.int64)
_VARIABLE[[*range(48, 58), ord("@"), ord("/"), ord("\\")]] = 1


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines of a text, without the line feeds."""
    end = np.append(np.flatnonzero(data == 10), len(data))
    return np.concatenate([[0], end[:-1] + 1]), end


#: The quarters that a template leaves open.
OPEN = [(), *combinations(range(4), 1), *combinations(range(4), 2)]
_CODES = mix64(np.arange(len(OPEN), dtype=_U) + _WILD)
_ONE = _U(0x2545F4914F6CDD1D)
#: So many bytes of short texts are parsed at once.
TOGETHER = 1 << 18


def templates(data: np.ndarray, lead: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, template) pairs of a text, the templates as 64-bit hashes."""
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    held = np.concatenate([[0], np.cumsum(_VARIABLE[data])])
    variable = held[end] > held[start]
    token = np.where(variable, _WILD, hash_words(data))
    line_start, _ = line_spans(data)
    line = np.searchsorted(line_start, start, side="right") - 1
    first = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(first, len(line)))
    place = np.arange(len(token)) - np.repeat(first, size)
    value = mix64(token ^ mix64(place.astype(_U) + _U(1)))  # a sum over values keeps places apart
    run = np.concatenate([np.zeros(1, _U), np.cumsum(value, dtype=_U)])
    fixed = np.concatenate([[0], np.cumsum(~variable)])
    head = np.minimum(lead, size)
    edge = [first + head + (size - head) * q // 4 for q in range(5)]
    part = [run[edge[q + 1]] - run[edge[q]] for q in range(4)]
    const = [fixed[edge[q + 1]] - fixed[edge[q]] for q in range(4)]
    leaf = mix64(size.astype(_U) * _U(3) + _U(7)) + run[edge[4]] - run[first]
    whole = fixed[edge[4]] - fixed[first]
    ids, lines, keys, wider = line[first], [], [], {}
    for k, quarters in reversed([*enumerate(OPEN)]):
        key, stays = leaf, whole
        fits = size > 0
        for q in quarters:
            key, stays = key - part[q], stays - const[q]
            fits &= edge[q + 1] > edge[q]
        fits &= (2 * stays >= size) & ((stays >= least) | (not k))
        # lines that agree here agree in what a wider template keeps of it: the wider one alone is counted
        new = fits & ~reduce(np.logical_or, (w for x, w in wider.items() if {*quarters} < {*x}), np.zeros(len(size), dtype=bool))
        wider[quarters] = fits
        lines.append(ids[new])
        keys.append(mix64(key[new] + _CODES[k]))
    # one token open, where no open quarter with it fits
    quarter = np.sum([place >= np.repeat(edge[q] - first, size) for q in (1, 2, 3)], axis=0)
    covered = np.zeros((4, len(size)), dtype=bool)
    for quarters, fits in wider.items():
        for q in quarters:
            covered[q] |= fits
    group = np.repeat(np.arange(len(size)), size)
    one = np.flatnonzero((place >= lead) & ~variable & (4 * (whole - 1) >= 3 * size)[group] & ~covered[quarter, group])
    lines.append(line[one])
    keys.append(mix64(leaf[group[one]] - value[one] + mix64(place[one].astype(_U) + _ONE)))
    return np.concatenate(lines), np.concatenate(keys)


def _texts(lead: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [d.tobytes() if d is not None else b"" for d in text_buffers(batch.column(0))]
            found, size, lo = [np.zeros(0, np.int64)], [], 0
            while lo < len(texts):
                hi, held = lo + 1, len(texts[lo])
                while hi < len(texts) and held + len(texts[hi]) <= TOGETHER:
                    held += len(texts[hi])
                    hi += 1
                line, key = templates(np.frombuffer(b"\n".join(texts[lo:hi]), np.uint8), lead, least)
                after = np.cumsum([t.count(b"\n") + 1 for t in texts[lo:hi]])
                row = np.searchsorted(after, line, side="right")
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                found.append(key[new].view(np.int64))
                size.append(np.bincount(row[new], minlength=hi - lo))
                lo = hi
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(size))]) if size else np.zeros(1)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], ["text_hash", "templates"])

    return run


def _strip(lead: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, texts = [], [], {}
            for k, (data, drop) in enumerate(zip(text_buffers(batch.column(0)), batch.column(2).to_pylist(), strict=True)):
                lines.append(0 if data is None else 1 + data.tobytes().count(b"\n"))
                dropped.append(0)
                if drop:
                    start, end = line_spans(data)
                    keep = np.ones(len(start), dtype=bool)
                    line, template = templates(data, lead, least)
                    keep[line[np.isin(template.view(np.int64), np.array(drop, dtype=np.int64))]] = False
                    dropped[k], texts[k] = int((~keep).sum()), b"\n".join(data[s:e].tobytes() for s, e in zip(start[keep], end[keep], strict=True)).decode()
            text = batch.column(0)
            if texts:
                changed = np.zeros(len(lines), dtype=bool)
                changed[list(texts)] = True
                text = pc.replace_with_mask(text, pa.array(changed), pa.array(list(texts.values()), text.type))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), text], ["doc_id", "n_lines", "n_dropped", "text"])

    return run


def drop_recurring_lines(docs: DataFrame, texts: int = 3, lead: int = 1, least: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, text.

    Lines with a template that occurs in at least ``texts`` different texts are
    dropped, the others joined by line feeds; equal texts count as one, so
    copies alone make no template recur.  Lines without a token always stay.
    ``lead``: leading tokens that a template never leaves open; ``least``:
    constant tokens of a template with open quarters.  A null text stays null with no lines; an empty one has one
    empty line.  Repeated rows give equal results; an empty table gives no
    rows.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"))
    found = own.select("text", "text_hash").mapInArrow(_texts(lead, least), "text_hash bigint, templates array<bigint>")
    held = cut(found.where(F.size("templates") > 0).groupBy("text_hash").agg(F.first("templates").alias("templates")).select("text_hash", F.explode("templates").alias("template")), "line-templates")
    often = held.groupBy("template").count().where(F.col("count") >= texts).select("template")
    # a table of its own, so that the join can split the rows of a text with very many copies
    drop = cut(held.join(often, "template").groupBy("text_hash").agg(F.collect_list("template").alias("templates")), "line-drops")
    rows = own.join(drop.hint("shuffle_hash"), "text_hash", "left").select("text", "doc_id", "templates")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_strip(lead, least), f"doc_id {kind}, n_lines bigint, n_dropped bigint, text string")
