"""Language ID by prediction by partial matching.

Each language has a variable-order byte context tree, held as counts of byte
n-grams up to ``order`` bytes of context.  A byte that its context has seen
costs -log2(count / (n + d)); else an escape, -log2(d / (n + d)), and the same
byte in the context one byte shorter, at last 8 bits of no context (n: times
the context was seen, d: different bytes after it).  Statistics are frozen
after training, so the code length of a text is a sum over its bytes and
depends on the last order + 1 bytes at each place alone; texts are scored whole
with numpy, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused
from .wordhash import text_buffers

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
UNKNOWN = "und"
BLOCK = 1 << 19
#: A text may cost so many times what all but a hundredth of held-out texts cost a byte, and so many bits more (a key or a card number in a short text).
TIMES, MORE_BITS = 2.0, 256
#: The bytes of a text depend on each other: for the score its code lengths count as those of so many bytes at most.
EVIDENCE = 8
MOST_LANGUAGES = 1000


def grams(data: np.ndarray, length: int, pad: int) -> np.ndarray:
    """The last ``length`` bytes at each place of ``data`` from ``pad`` on, as numbers (the newest byte lowest)."""
    out = np.zeros(len(data) - pad, dtype=_U)
    for back in range(length - 1, -1, -1):
        out = (out << _U(8)) | data[pad - back : len(data) - back]
    return out


class Lookup:
    """Rows of a table by a 64-bit key: open addressing with linear steps, built and read with numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.zeros(1 << self.bits, dtype=_U)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        self.steps = 0
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            self.steps += 1
            free = self.rows[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.rows[slot[won]] = keys[left[won]], left[won]
            lost = np.ones(len(left), dtype=bool)
            lost[won] = False
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self._slot(keys)
        row = self.rows[slot]
        out = np.where(self.keys[slot] == keys, row, -1)
        left = np.flatnonzero((out < 0) & (row >= 0))
        for _ in range(self.steps):
            if not len(left):
                break
            slot = (slot if len(slot) == len(left) else slot[left]) + 1 & ((1 << self.bits) - 1)
            row = self.rows[slot]
            hit = (self.keys[slot] == keys[left]) & (row >= 0)
            out[left[hit]] = row[hit]
            go = ~hit & (row >= 0)
            left, slot = left[go], slot[go]
        return out


@dataclass
class Model:
    """Frozen statistics of all languages: costs in bits of n-grams, by length, and escapes of contexts."""

    langs: list[str]
    order: int
    found: list[Lookup]  # by length - 1: n-grams that some language has seen
    cost: list[np.ndarray]  # by length - 1: float32 (n-grams, languages)

    def _costs(self, gram: np.ndarray, length: int) -> np.ndarray:
        """Costs of n-grams of one length, (n, languages)."""
        if not length:
            return np.full((len(gram), len(self.langs)), 8.0, dtype=np.float32)
        low = gram & _U((1 << 8 * length) - 1)
        row = self.found[length - 1].find(low)
        out = self.cost[length - 1][row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            out[miss] = self._escape(low[miss], length) + self._costs(low[miss], length - 1)
        return out

    def _escape(self, gram: np.ndarray, length: int) -> np.ndarray:
        """Bits of the escape from each n-gram's context; 0 where a language never saw the context."""
        if length == 1:
            return np.broadcast_to(self.escapes[0], (len(gram), len(self.langs)))
        row = self.found[length - 2].find(gram >> _U(8))
        return np.where(row[:, None] < 0, np.float32(0), self.escapes[length - 1][row])

    escapes: list[np.ndarray] = None  # by context length; rows as in found[context length - 1]

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of a whole text in each language."""
        total = np.zeros(len(self.langs))
        pad = np.full(self.order, 10, dtype=np.uint8)
        for lo in range(0, len(data), BLOCK):
            part = data[max(0, lo - self.order) : lo + BLOCK]
            if lo < self.order:
                part = np.concatenate([pad[: self.order - lo], part])
            total += self._costs(grams(part, self.order + 1, self.order), self.order + 1).sum(axis=0, dtype=np.float64)
        return total


def train(texts: dict[str, list[bytes]], order: int) -> Model:
    """Counts byte n-grams of every language and turns them to costs."""
    langs = sorted(texts)
    pad = b"\n" * order
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for length in range(1, order + 2):
        per = []
        for lang in langs:
            got = [grams(np.frombuffer(pad + t, dtype=np.uint8), length, order) for t in texts[lang] if t]
            per.append(np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, _U), np.zeros(0, np.int64)))
        counts.append(per)
    # a context before the first byte of a text is padding and no n-gram of it, but it has an escape
    keys = [np.unique(np.concatenate([k for k, _ in per] + [k >> _U(8) for k, _ in after])) for per, after in zip(counts, [*counts[1:], []], strict=True)]
    model = Model(langs, order, [Lookup(k) for k in keys], [])
    model.escapes = [np.zeros((1 if not c else len(keys[c - 1]), len(langs)), dtype=np.float32) for c in range(order + 1)]
    for length in range(1, order + 2):
        own = keys[length - 1]
        cost = np.zeros((len(own), len(langs)), dtype=np.float32)
        if length == 1:
            lower = np.full((len(own), len(langs)), 8.0)
        else:
            below = np.searchsorted(keys[length - 2], own & _U((1 << 8 * (length - 1)) - 1))
            lower = model.cost[length - 2][below]
        for j, (k, c) in enumerate(counts[length - 1]):
            context = k >> _U(8)
            ctx, start = np.unique(context, return_index=True)
            n, d = np.add.reduceat(c, start) if len(k) else c, np.diff(np.append(start, len(k)))
            at = np.searchsorted(ctx, context)
            place = np.zeros(len(ctx), np.int64) if length == 1 else np.searchsorted(keys[length - 2], ctx)
            model.escapes[length - 1][place, j] = -np.log2(d / (n + d))
            seen = np.searchsorted(own, k)
            new = np.ones(len(own), dtype=bool)
            new[seen] = False
            cost[seen, j] = -np.log2(c / (n + d)[at])
            if length == 1:
                cost[new, j] = model.escapes[0][0, j] + 8.0
            else:
                row = np.minimum(np.searchsorted(keys[length - 2], own[new] >> _U(8)), len(keys[length - 2]) - 1)
                there = keys[length - 2][row] == own[new] >> _U(8)
                cost[new, j] = np.where(there, model.escapes[length - 1][row, j], 0) + lower[new, j]
        model.cost.append(cost)
    return model


def training_sample(docs: DataFrame, use: Column, train_bytes: int, doc_id: str, text: str, lang: str) -> dict[str, list[bytes]]:
    """About ``train_bytes`` of text of all languages together, dealt equally, gathered on the driver.

    A language's rows are chosen by a hash of doc_id and text; a text gives the
    whole of itself or, if it is longer than a sixteenth of its language's
    part (4096 bytes at least), a slice of as many code points from a place
    that the hash decides.  So every language with a text is learned and the
    bound holds whatever texts are like, to the four bytes of a code point.
    The sample is the operator's one bounded gathering; scoring covers all rows
    and whole texts.  More than ``MOST_LANGUAGES`` are an error.
    """
    rows = docs.where(use & F.col(lang).isNotNull() & (F.octet_length(F.col(text)) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.char_length(F.col(text)).alias("size"), F.xxhash64(F.lit("language id"), F.col(doc_id), F.col(text)).alias("h"))
    names = [r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if not names:
        return {}
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different languages: {sorted(names)[:5]} ...")
    part = train_bytes // len(names)
    limit = max(part // 16, 4096)
    taken = F.least("size", F.lit(limit))
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(taken).alias("n")).collect()}
    low = F.pmod("h", F.lit(1 << 30))
    chosen = F.lit(False)
    for name, n in sorted(held.items()):
        chosen = chosen | ((F.col("lang") == name) & (low < F.lit(int(min(1.0, part / n) * (1 << 30)))))
    begin = (F.pmod(F.shiftright("h", 30), F.col("size") - taken + 1) + 1).cast("int")
    rows = rows.withColumn("slice", F.substring(F.col("text"), begin, taken))
    out: dict[str, list[bytes]] = {name: [] for name in held}
    for r in rows.where(chosen).select("lang", "slice").collect():
        out[r["lang"]].append(r["slice"].encode())
    if none := [k for k, v in out.items() if not v]:  # few rows, and none under the threshold
        for r in rows.where(F.col("lang").isin(none)).groupBy("lang").agg(F.min(F.struct(low, "h", "slice")).alias("t")).select("lang", "t.slice").collect():
            out[r["lang"]].append(r["slice"].encode())
    return {k: sorted(v) for k, v in out.items()}


def identify(docs: DataFrame, use: Column | None = None, order: int = 4, train_bytes: int = 3 << 20, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score, bits_per_byte.

    Learns from the rows for which ``use`` holds (default: all) that have a
    text and a language; predictions read the text alone.  lang_pred: the
    language of the least code length (the first by name among equals), or
    ``und`` where the text is null or has no letter, or nothing could be
    learned; score: its probability given ``EVIDENCE`` bytes that cost what the
    text costs a byte (or the text, if shorter), when all languages are as
    likely before, 0 for ``und``; bits_per_byte: its code length per byte.
    Repeated rows give equal results; an empty table gives no rows.  Other
    columns are not read.  Up to a few hundred languages are meant; over
    ``MOST_LANGUAGES`` are an error.
    """
    model = _learn(docs, use, order, train_bytes, doc_id, text, lang)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, sure, per = [], [], []
            letters = batch.column(2).to_pylist()
            for data, letter in zip(text_buffers(batch.column(1)), letters, strict=True):
                for column, value in zip((pred, sure, per), _predict(model, data, letter), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(per, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), _has_letter(text))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")


def _learn(docs, use, order, train_bytes, doc_id, text, lang):
    sample = training_sample(docs, F.lit(True) if use is None else use, train_bytes, doc_id, text, lang)
    return small_batches(docs.sparkSession).sparkContext.broadcast(train(sample, order)) if sample else None


def _has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_has_letter")


def _predict(model, data: np.ndarray | None, letter: bool) -> tuple[str, float, float | None]:
    if data is None or not letter or model is None:
        return UNKNOWN, 0.0, None
    bits = model.value.bits(data)
    best = int(bits.argmin())
    sure = 1 / np.exp2(np.maximum(bits[best] - bits, -1e6) * min(1.0, EVIDENCE / len(data))).sum()
    return model.value.langs[best], float(sure), float(bits[best] / len(data))


def byte_limits(sample: dict[str, list[bytes]], order: int) -> np.ndarray:
    """For each language by name, the bits per byte over which a text isn't taken to be in it.

    An eighth of the different texts of the sample is held out and scored by
    the others; infinite for a language that has no two texts of 32 bytes.
    """
    rest, held = {}, {}
    for name, texts in sample.items():
        own = sorted(set(texts))
        held[name] = [t for t in own[::8] if len(t) >= 32] if len(own) > 1 else []
        rest[name] = [t for k, t in enumerate(own) if k % 8] or own
    model = train(rest, order)
    costs = [[model.bits(np.frombuffer(t, np.uint8))[j] / len(t) for t in held[name]] for j, name in enumerate(model.langs)]
    return np.array([TIMES * np.percentile(c, 99) if c else np.inf for c in costs])


def identified(docs: DataFrame, least_score: float = 0.3, use: Column | None = None, order: int = 4, train_bytes: int = 3 << 20, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns and no shuffle of them.

    Rejected: ``und``, a score under ``least_score``, and texts whose code
    length is over ``MORE_BITS`` plus, for each byte, ``TIMES`` the 99th
    percentile of held-out texts of the predicted language: those are in no
    learned language.  ``least_score`` leaves texts in two languages, which score
    about a half, and rejects what several languages explain alike.  The score
    alone can't tell, as it compares the learned
    languages with each other.  Null texts and texts without a letter go, as do
    all if nothing could be learned; repeated rows are judged alike; other
    columns may have any names; an empty table gives no rows.
    """
    sample = training_sample(docs, F.lit(True) if use is None else use, train_bytes, doc_id, text, lang)
    model = small_batches(docs.sparkSession).sparkContext.broadcast(train(sample, order)) if sample else None
    limits = dict(zip(sorted(sample), byte_limits(sample, order).tolist(), strict=True)) if sample else {}
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_pylist()
            known = []
            for data, letter in zip(text_buffers(batch.column(place)), letters, strict=True):
                pred, score, per = _predict(model, data, letter)
                known.append(pred != UNKNOWN and score >= least_score and per * len(data) <= MORE_BITS + limits[pred] * len(data))
            kept = batch.filter(pa.array(known, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    return docs.select("*", _has_letter(text).alias(*unused(docs, "_has_letter"))).mapInArrow(keep, docs.schema)
