"""Source divergence audit: how far the words of each source lie from those of every other source of its language.

The divergence of two sources is a sum over all terms that their language
keeps.  It is never made term by term: a pair of sources starts at the number
of kept terms times what a term gives that neither holds, and the postings of
the inverted index add what differs from it.  What a term adds where one source
alone holds it depends on the count there and on the other source's size, so
such postings are counted by their count first; only a term that both sources
hold gives a row for the two.

All shares are whole numbers of thousand millionths, all divisions are exact
and rounded down, so results are the same on any number of tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, small_batches
from .wordhash import text_buffers

SCALE = 1_000_000_000
BLOCK, HELD_TERMS = 1 << 20, 1 << 18
#: Letters A-Z to small ones, every other ASCII character that isn't a letter to a space; bytes of other scripts stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in blocks of a megabyte."""
    lo = 0
    data = data.translate(FOLD)
    while lo < len(data):
        hi = len(data) if len(data) - lo <= BLOCK or (at := data.find(b" ", lo + BLOCK)) < 0 else at
        yield data[lo:hi].split()
        lo = hi


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what a task has read, summed until HELD_TERMS are held; a null term says that the group occurs."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for data, lang, source in zip(text_buffers(batch.column(0)), langs, sources, strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n) + len(docs)
            seen: set[bytes] = set()
            for words in terms_of(data.tobytes()):
                n.update(words)
                seen.update(words)
                if len(n) > HELD_TERMS:
                    yield _rows({(lang, source): (n, Counter())})
                    n.clear()
            docs.update(seen)
            size += len(n) + len(docs) + 1
            if size > HELD_TERMS:
                yield _rows(held)
                held, size = {}, 0
    yield _rows(held)


def _rows(held: dict[tuple, tuple[Counter, Counter]]) -> pa.RecordBatch:
    langs, sources, terms, n, docs = [], [], [], [], []
    for (lang, source), (own, of_docs) in held.items():
        all_terms = [None, *(own.keys() | of_docs.keys())]
        langs += [lang] * len(all_terms)
        sources += [source] * len(all_terms)
        terms += all_terms
        n += [own[t] for t in all_terms]
        docs += [of_docs[t] for t in all_terms]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms))."""
    return F.expr("1L") + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(docs: DataFrame, least_docs: int = 3, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each language and source of ``docs``.

    A term is a run of letters (A-Z folded) and of characters beyond ASCII; a
    language keeps the V terms that ``least_docs`` of its documents hold.  In a
    group (a source of a language, or all of the language) with N occurrences
    of kept terms, a term that occurs c times has the share p =
    1 + floor(10^9 (c + 1) / (N + V)).  Two shares differ by
    floor((p - q)^2 / q).

    Part ``pair``: item is each other source of the language, value the sum
    over all kept terms, p being the source's and q the item's.  Part ``term``:
    item is each kept term that the source holds with a share above the
    language's, value its difference from that, the first ``top`` by value.
    rank: from 1 by value descending, then by item.

    Null texts, languages and sources read as empty ones; a source without kept
    terms has pairs, and in a language that keeps no term they are 0.  Repeated
    rows count again.  An empty table gives no rows.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("text", text), ("lang", lang), ("source", source))])
    sums = own.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    sums = cut(sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")

    of_term = Window.partitionBy("lang", "term")
    kept = sums.where("term IS NOT NULL").select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("docs"), (F.min("source").over(of_term) == F.col("source")).cast("bigint").alias("first"))
    kept = cut(kept.where(F.col("docs") >= least_docs).drop("docs"), "divergence-postings")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
    groups = sums.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = cut(groups.withColumn("zero", zero), "divergence-groups")
    discard([sums])

    postings = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    words = postings.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("p > q")
    words = words.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = _pairs(postings, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.union(words)


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the baseline of each pair of sources and the corrections of all terms, summed."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "zero", "q0"))
    base = groups.join(other, "lang").where("source <> item")
    base = base.select("lang", "source", "item", F.coalesce(F.col("terms") * apart(p0, q0), F.lit(0)).alias("value"))
    # a term as if the other source didn't hold it, by how often it occurs
    times = postings.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("k"))
    alone = times.join(other, "lang").where("source <> item")
    ways = F.array(
        F.struct("source", "item", (F.col("k") * (apart(p, q0) - apart(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * (apart(q0, p) - apart(q0, p0))).alias("value")),
    )
    alone = alone.select("lang", F.inline(ways))
    # a term that both hold: what that changes
    there = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("q0"))
    both = postings.join(there, ["lang", "term"]).where("source < item")
    over = lambda a, b, a0, b0: apart(a, b) - apart(a, b0) - apart(a0, b) + apart(a0, b0)
    both = both.groupBy("lang", "source", "item").agg(F.sum(over(p, q, p0, q0)).alias("there"), F.sum(over(q, p, q0, p0)).alias("back"))
    both = both.select("lang", F.inline(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))
    return base.union(alone).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
