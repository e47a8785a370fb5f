"""Token counts by a linear longest-match automaton.

A vocabulary of byte strings is held as a trie.  Every node has a failure link
and the number of tokens that are popped on the way over it: when the next byte
has no edge, the greedy longest matches that end here are counted without being
built, and the automaton goes on where their rest leads.  So each byte is read
once, whatever the pieces are.

Units are matched on their own: a run of bytes that aren't white space, with
the one space before it, or else a single byte of white space.  Counts of units
are remembered, in a table of bounded size.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .wordhash import text_buffers

UNIT = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")
REMEMBERED, LONGEST = 1 << 19, 64
BLOCK = 1 << 20


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file with a base64 piece and its rank on each line, read on the driver; a missing file is an error that names it."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no vocabulary at {path}: hand token_counts its pieces, or name a file")
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """Trie with failure links; node 0 is the root.

    Single bytes are pieces in any case: a byte that no piece of the vocabulary
    covers counts as one token, so every match can be popped to its end.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in chain(pieces, (bytes([b]) for b in range(256))):
            node = 0
            for byte in piece:
                if (to := self.next[node].get(byte)) is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = to
            whole[node] = bool(piece)
        # fail: where the rest of a node's string leads once its tokens are popped
        self.fail, self.popped = [0] * len(whole), [0] * len(whole)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, to in self.next[node].items():
                    below.append(to)
                    if whole[to]:
                        self.popped[to] = 1
                        continue
                    at, n = self.fail[node], self.popped[node]
                    while byte not in self.next[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    self.fail[to], self.popped[to] = self.next[at][byte], n
            level = below

    def count(self, data: bytes) -> int:
        """Greedy longest-match pieces in ``data``."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in data:
            while (to := step[node].get(byte)) is None:
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


class Counts(dict):
    """Token counts of units, found when first asked for; long units and those beyond the bound aren't kept."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, unit: bytes) -> int:
        n = self.automaton.count(unit)
        if len(self) < REMEMBERED and len(unit) <= LONGEST:
            self[unit] = n
        return n


def units(data: bytes) -> Iterator[list[bytes]]:
    """The units of a text, some at a time; blocks end before white space."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        if hi < len(data) and (m := re.compile(rb"[\x20\x09-\x0D]").search(data, hi)):
            hi = m.start()
        elif hi < len(data):
            hi = len(data)
        yield UNIT.findall(data[lo:hi])
        lo = hi


def token_counts(docs: DataFrame, pieces: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, n_units, n_bytes.

    ``pieces``: the vocabulary; the automaton is built on the driver and its
    size is bounded by the vocabulary's.  A null or empty text has no tokens;
    bytes that no piece covers count as one token each.  Repeated rows give
    equal results; an empty table gives no rows.  Other columns are not read.
    """
    automaton = small_batches(docs.sparkSession).sparkContext.broadcast(Automaton(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(automaton.value)
        for batch in batches:
            tokens, parts, size = [], [], []
            for data in text_buffers(batch.column(0)):
                n = k = 0
                for some in units(data.tobytes()) if data is not None else ():
                    n += sum(map(counts.__getitem__, some))
                    k += len(some)
                tokens.append(n), parts.append(k), size.append(0 if data is None else len(data))
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(x, pa.int64()) for x in (tokens, parts, size)]], ["doc_id", "n_tokens", "n_units", "n_bytes"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_units bigint, n_bytes bigint")
