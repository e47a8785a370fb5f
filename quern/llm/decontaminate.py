"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An n-gram of a test item is a seed if of the n-grams in some window of the
item's words it is the one that the fewest documents hold; n-grams that no
document holds are none.  Seeds join the documents that hold them to the items;
where two seeds of an item lie alike, or a rare one, the pair is aligned around
them, unless the words there can't reach the least score in any order.  The score is the alignment's share of what the
whole item would get, so edited and paraphrased copies score by what is left.
A copy in which no seed is left whole,
or a common one alone, isn't found.

Words are separated by every ASCII character other than letters and digits,
and letters are lower-cased in every script.  Documents are read a fixed number
of times, whatever the benchmark's size.  What is handed to all tasks is tables
of bits of a fixed size, which let through all that must pass and little else;
joins decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, small_batches, unused
from .wordhash import PUNCTUATION, hash_spans, shingle_hashes, text_buffers, word_spans

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the tables that are broadcast: 4 MB.
TABLE_BITS = 25
HELD_GRAMS = 1 << 20
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1 << 14
#: A seed that at most one text of so many holds, or of an item with fewer seeds, asks for an alignment on its own; another only beside a second one.
RARE, FEW = 2000, 12
_U = np.uint64


def lowered(column: pa.Array) -> pa.Array:
    """Texts in small letters; bytes that are no UTF-8 as replacement characters."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace").lower() for v in column.cast(pa.binary()).to_pylist()], pa.string())


def words_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of texts, and the row of each word, by blocks of rows of about a megabyte."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    rows = 0
    while rows < len(size):
        upto = rows + max(1, int(np.searchsorted(np.cumsum(size[rows : rows + BLOCK_ROWS]), BLOCK_BYTES, "right")))
        texts = lowered(column.slice(rows, upto - rows))  # small letters may have other sizes
        own = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        data = np.concatenate([np.zeros(0, np.uint8), *[d for d in text_buffers(texts) if d is not None]])
        joined = np.full(len(data) + len(own), 0x0A, np.uint8)  # a line feed ends each text
        joined[np.arange(len(data)) + np.repeat(np.arange(len(own)), own)] = data
        start, end = word_spans(joined, PUNCTUATION)
        begin = np.cumsum(own + 1) - own - 1
        yield hash_spans(joined, start, end), rows + np.searchsorted(begin, start, "right") - 1
        rows = upto


class Bits:
    """A set of 64-bit hashes by their first bits: holds all that were put in, and few others while it is mostly empty."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, rows: DataFrame, column: str) -> Bits:
        """Of a column of any length: its bits are set in the tasks, and as many words of 64 come to the driver as the table has."""
        at = F.shiftrightunsigned(column, 64 - TABLE_BITS)
        words = rows.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - TABLE_BITS}) & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << (TABLE_BITS - 6), _U)
        table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(_U)
        return cls(table)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> _U(64 - TABLE_BITS)
        return (self.table[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def grams_of(words: np.ndarray, row: np.ndarray, widths: list[int], bits: Bits) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within texts that ``bits`` lets through, and at which of all words they begin."""
    grams, places = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for width in widths:
        if len(words) >= width:
            found = shingle_hashes(words, width)
            places.append(np.flatnonzero(bits.has(found) & (row[: len(found)] == row[width - 1 :])))
            grams.append(found[places[-1]])
    return np.concatenate(grams), np.concatenate(places)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, and where in the item and in the window it ends (exclusive)."""
    steps = np.arange(len(window) + 1) * GAP
    row = np.zeros(len(window) + 1, dtype=np.int64)
    best, at = 0, (0, 0)
    for i, word in enumerate(item):
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(window == word, MATCH, MISMATCH), 0, out=new[1:])
        np.maximum(new, row + GAP, out=new)
        row = np.maximum.accumulate(new - steps) + steps  # gaps in the item, from any place to the left
        if (top := int(row.max())) > best:
            best, at = top, (i + 1, int(row.argmax()))
    return best, *at


def reachable(item: np.ndarray, window: np.ndarray) -> int:
    """No local alignment scores more: the best run of the window, if each word that the item holds matched."""
    run = np.concatenate([[0], np.cumsum(np.where(np.isin(window, item), MATCH, GAP))])
    return int((run - np.minimum.accumulate(run)).max())


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, item, size, words): the words' hashes, and one hash of them all that names equal items."""
    for batch in batches:
        for words, row in words_of(batch.column(1)):
            at, first = np.unique(row, return_index=True)
            own = np.split(words, first[1:]) if len(at) else []
            names = [int(shingle_hashes(w, len(w))[0].view(np.int64)) for w in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(names, pa.int64()), pa.array([len(w) for w in own], pa.int32()), pa.array([w.tobytes() for w in own], pa.binary())], ["item_id", "item", "size", "words"])


def _item_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, size, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                grams = shingle_hashes(np.frombuffer(words, _U), n).view(np.int64)
                k = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(k, item)), pa.array(np.full(k, size, np.int32)), pa.array(np.arange(k, dtype=np.int32))], ["gram", "item", "size", "inside"])

    return run


def _held(bits, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, docs): how many of the texts that a task has read hold each n-gram that passes."""
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            grams, docs = np.unique(np.concatenate([np.zeros(0, _U), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(docs.astype(np.int64))], ["gram", "docs"])

        size = 0
        for batch in batches:
            for words, row in words_of(batch.column(0)):
                grams, at = grams_of(words, row, widths, bits.value)
                order = np.lexsort((grams, row[at]))
                grams, at = grams[order], row[at][order]
                held.append(grams[np.append(True, (grams[1:] != grams[:-1]) | (at[1:] != at[:-1]))[: len(grams)]])
                size += len(held[-1])
                if size > HELD_GRAMS:
                    yield summed()
                    size = 0
        yield summed()

    return run


def _hits(bits, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text_hash, gram, place) of what may be a seed."""
        for batch in batches:
            for words, row in words_of(batch.column(0)):
                grams, at = grams_of(words, row, widths, bits.value)
                own = row[at]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(own)), pa.array(grams.view(np.int64)), pa.array(at - np.searchsorted(row, own))], ["text_hash", "gram", "place"])

    return run


def _near(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts that may have seeds."""
        for batch in batches:
            yield batch.filter(pa.array(bits.value.has(np.asarray(batch.column(1)).view(_U))))

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_hash, item, first, window): the words of a text around the seeds of each item."""
    for batch in batches:
        names, asked = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for words, row in words_of(batch.column(0)):
            rows = np.unique(row)
            at = []
            for r, begin, end in zip(rows.tolist(), np.searchsorted(row, rows).tolist(), np.searchsorted(row, rows, "right").tolist(), strict=True):
                at += [(names[r], a["item"], max(0, a["lo"]), words[begin + max(0, a["lo"]) : min(end, begin + a["hi"])].tobytes()) for a in asked[r]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in at], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["text_hash", "item", "first", "window"])


def _aligned(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, name, first, window, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                item, near = np.frombuffer(words, _U), np.frombuffer(window, _U)
                enough = least * MATCH * len(item)
                if reachable(item, near) < enough:
                    continue
                score, i, j = align(item, near)
                if score and score >= enough:
                    _, _, back = align(item[:i][::-1], near[:j][::-1])
                    rows.append((text, name, score / (MATCH * len(item)), first + j - back, first + j - 1))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["text_hash", "item", "score", "first_word", "last_word"])

    return run


def _copies(texts: DataFrame, benchmark: DataFrame, n: int, window: int, least: float, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(text_hash, item, score, first_word, last_word) of the best copy of each item in each text, and (item_id, item).

    texts: (text, text_hash).
    """
    spark = small_batches(texts.sparkSession)
    kind = benchmark.schema[item_id].dataType.simpleString()
    tests = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).mapInArrow(_items, f"item_id {kind}, item bigint, size int, words binary").where("item IS NOT NULL")
    tests = cut(tests, "benchmark-items")
    items = tests.select("item", "size", "words").dropDuplicates(["item"])
    grams = cut(items.mapInArrow(_item_grams(n), "gram bigint, item bigint, size int, inside int"), "benchmark-grams")
    widths = [r[0] for r in items.select(F.least(F.lit(n), "size")).distinct().collect()]
    texts = texts.where("text IS NOT NULL")

    asked = spark.sparkContext.broadcast(Bits.of(grams.select("gram").distinct(), "gram"))
    docs = texts.select("text").mapInArrow(_held(asked, widths), "gram bigint, docs bigint").groupBy("gram").agg(F.sum("docs").alias("docs"))
    docs = cut(grams.select("gram").distinct().join(docs, "gram"), "benchmark-frequencies")
    ranked = grams.join(docs, "gram").withColumn("rank", F.struct("docs", F.xxhash64("gram").alias("tie"), "gram"))
    ahead = Window.partitionBy("item").orderBy("inside").rangeBetween(0, max(0, window - n))
    # the rarest n-gram of each window of the item's words
    rarest = F.min_by(F.struct("gram", "inside"), F.struct("rank", "inside")).over(ahead)
    seeds = ranked.select("item", "size", rarest.alias("seed")).select("item", "size", "seed.*").distinct().join(docs, "gram")
    rare = F.col("docs") * RARE <= F.lit(texts.count())
    seeds = cut(seeds.withColumn("alone", rare | (F.count("*").over(Window.partitionBy("item")) < FEW)).drop("docs"), "benchmark-seeds")

    seeded = spark.sparkContext.broadcast(Bits.of(seeds.select("gram").distinct(), "gram"))
    hits = texts.select("text", "text_hash").mapInArrow(_hits(seeded, widths), "text_hash bigint, gram bigint, place bigint").distinct()
    # of two seeds that lie alike in text and item both count, of one alone only if it is rare or the item has few
    lie = F.col("place") - F.col("inside")
    alike = Window.partitionBy("text_hash", "item").orderBy("scaled").rangeBetween(-1000, 1000)
    hits = hits.join(seeds, "gram").withColumn("scaled", F.floor(lie * 1000 / F.col("size")))
    hits = hits.select("*", (F.min("inside").over(alike) < F.max("inside").over(alike)).alias("two")).where("two OR alone")
    # around them, to an item's length; a copy may hold other words besides the item's
    slack = (F.col("size") * F.lit(MATCH * (1 - least))).cast("bigint") + 1
    near = hits.groupBy("text_hash", "item", F.floor(lie / F.col("size")).alias("block")).agg(F.min(lie - slack).alias("lo"), F.max(lie + F.col("size") + slack).alias("hi"))
    near = cut(near.groupBy("text_hash").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("asked")), "benchmark-near")
    there = spark.sparkContext.broadcast(Bits.of(near, "text_hash"))
    whole = texts.select("text", "text_hash").mapInArrow(_near(there), "text string, text_hash bigint").dropDuplicates(["text_hash"])
    around = whole.join(near, "text_hash").select("text", "text_hash", "asked").mapInArrow(_windows, "text_hash bigint, item bigint, first bigint, window binary")
    scored = around.join(items.select("item", "words"), "item").select("text_hash", "item", "first", "window", "words").mapInArrow(_aligned(least), "text_hash bigint, item bigint, score double, first_word bigint, last_word bigint")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("from"), "last_word")).alias("b")
    found = scored.groupBy("text_hash", "item").agg(best).select("text_hash", "item", "b.score", (-F.col("b.from")).alias("first_word"), "b.last_word")
    found = cut(found, "benchmark-copies")
    discard([grams, docs, seeds, near])
    return found, tests.select("item_id", "item")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 2, window: int = 3, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and test item of which it holds a copy: doc_id, text_hash, item_id, score, first_word, last_word.

    Seeds are ``n`` words long, the rarest of every ``window`` words of an
    item; an item of fewer words is looked for whole.  score: Smith-Waterman
    score (match 2, other word -1, gap -1) over that of the whole item, at
    least ``least``; first_word and last_word: the best copy's place in the
    document, in words from 0.  text_hash (xxhash64 of the text) tells rows
    apart that share a doc_id or have none; equal texts are aligned once.  Null
    or empty texts and items match nothing.  Repeated rows give repeated
    results, as do repeated items.  Empty tables give no rows.  Other columns
    are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found, tests = _copies(own.select("text", "text_hash"), benchmark, n, window, least, item_id, item_text)
    rows = own.where("text IS NOT NULL").select("doc_id", "text_hash").join(found, "text_hash").join(tests, "item")
    return rows.select("doc_id", "text_hash", "item_id", "score", "first_word", "last_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 2, window: int = 3, least: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item, with all their columns.

    A copy is what ``contaminated`` finds.  Rows with a null or empty text
    stay, repeated rows stay or go together, null and empty items match
    nothing; without items all rows stay, and an empty table gives no rows.
    Other columns may have any names.
    """
    own = docs.select(F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found, _ = _copies(own, benchmark, n, window, least, item_id, item_text)
    (gone,) = unused(docs, "_gone")
    gone_texts = found.select(F.col("text_hash").alias(gone)).distinct()
    return docs.join(gone_texts, docs[text].isNotNull() & (F.xxhash64(docs[text].cast("string")) == F.col(gone)), "left_anti")
