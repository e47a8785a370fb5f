"""Order MinHash fingerprints from DataFrame functions alone.

The k-mers are runs of k words.  Each is numbered among its equals in the text,
so that a repeated k-mer counts as often as it stands there; the numbered
k-mers are ordered by hash, and the least ones are kept.  Every ``tuple_size``
of them that follow each other in hash order are put back into text order and
hashed together: the fingerprint is the set of these hashes.  Moving text
around changes the order in the tuples, so likeness follows edit distance and
not the bag of words alone.

Positions take the low and hashes the high 32 bits of one long, so that the
two sorts of a text are sorts of primitive arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import WORD

_HIGH, _LOW = -(1 << 32), (1 << 32) - 1


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 3, tuple_size: int = 2, kept: int = 64) -> DataFrame:
    """Adds ``out``: up to ``kept`` different 32-bit hashes, ascending; none where the text is null or has no words.

    Each step is a column of its own that the next one reads more than once, so
    that the optimiser doesn't fold one into the loop of the next.
    """
    w, s, d, v = (f"_{x}_{out}" for x in "wsdv")
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    # k-mers at every word, the last ones shorter, with their positions; equal ones come together
    kmer = lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])
    df = df.withColumn(s, F.sort_array(F.transform(w, lambda x, i: kmer(x, i).bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("bigint")))))
    high = lambda i: F.shiftright(F.get(s, i), 32)
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (high(i) != high(i - 1)))
    df = df.withColumn(d, F.when(F.size(s) > 0, starts).otherwise(F.array().cast("array<int>")))

    def numbered(start: Column, run: Column) -> Column:
        last = F.coalesce(F.get(d, run + 1), F.size(s)) - 1
        return F.transform(F.sequence(start, last), lambda i: F.xxhash64(high(i), i - start).bitwiseAND(F.lit(_HIGH)).bitwiseOR(F.get(s, i).bitwiseAND(F.lit(_LOW))))

    df = df.withColumn(v, F.slice(F.sort_array(F.flatten(F.transform(d, numbered))), 1, kept + tuple_size - 1))
    n = F.greatest(F.least(F.lit(kept), F.size(v) - tuple_size + 1), F.least(F.lit(1), F.size(v)))

    def in_text_order(j: Column) -> Column:
        turned = F.transform(F.slice(v, j, tuple_size), lambda x: F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32)))
        return F.shiftright(F.xxhash64(F.transform(F.sort_array(turned), lambda x: x.bitwiseAND(F.lit(_LOW)))), 32).cast("int")

    tuples = F.when(F.size(v) > 0, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), n), in_text_order)))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, tuples).drop(w, s, d, v)


def likeness(a: Column, b: Column) -> Column:
    """Hashes in both, over the mean number of hashes (Dice); 1 for two empty fingerprints."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(_LOW))), 8, "0")), ""))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (array<int>).

    A null or empty text, or one of white space alone, has an empty
    fingerprint; equal texts have equal ones; repeated rows each get theirs; an
    empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_fingerprint(rows, "text", "fingerprint", **options).select("doc_id", "fingerprint")


#: A range of rows is as many bytes of text as this at most, while there are no more ranges than ``MOST_RANGES``, whose bounds are a literal.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 16


def _bounds(rows: DataFrame, ranges: int) -> list[Row]:
    """Keys that part the rows into about as many ranges; a sample of 32 for each range tells them, results don't depend on them.

    The sample is chosen by a hash, so rows of one id, or of none, are parted by
    their texts' hashes like others.
    """
    held = rows.count()
    if ranges < 2 or not held:
        return []
    share = min(1.0, 32 * ranges / held)
    found = rows.where(F.pmod(F.xxhash64(F.lit("bounds"), "_key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("_key").orderBy("_key").collect()
    return [found[i]["_key"] for i in sorted({len(found) * k // ranges for k in range(1, ranges)} - {0})] if found else []


def _range_of(rows: DataFrame, bounds: list[Row]) -> Column:
    """How many of the bounds are at most the row's key; found in two steps, so that it takes the root of their number."""
    if not bounds:
        return F.lit(0)
    kind = rows.schema["_key"].dataType.simpleString()
    step = max(1, int(len(bounds) ** 0.5))
    listed = lambda x: json.dumps([[b.asDict() for b in part] for part in x] if isinstance(x[0], list) else [b.asDict() for b in x])
    heads = F.from_json(F.lit(listed(bounds[::step])), f"array<{kind}>")
    groups = F.from_json(F.lit(listed([bounds[i : i + step] for i in range(0, len(bounds), step)])), f"array<array<{kind}>>")
    head = F.size(F.filter(heads, lambda b: b <= F.col("_key")))
    inside = F.size(F.filter(F.get(groups, head - 1), lambda b: b <= F.col("_key")))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * step + inside).cast("int")


def with_next(docs: DataFrame, carry: list[str], before: Callable[[DataFrame], DataFrame] = lambda df: df, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds next_<column> for each column of ``carry``: that of the next row by descending doc_id, after the last that of the first.

    Rows of equal doc_id follow each other by descending hash of their texts;
    null ids come last; ids can be numbers or strings.  Rows are dealt by
    ranges of id and hash, one shuffle of about ``RANGE_BYTES`` each, several
    times as many as there are partitions, so that partitions get about equal
    parts; the first row of each range also stands at the end of the range
    above it, so no range needs another.  ``before`` adds columns before rows
    are dealt.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_key", F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("s")).first()["s"]
    ranges = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    rows = rows.withColumn("_range", _range_of(rows, _bounds(rows, ranges)))
    ids = rows.groupBy("_range").agg(F.max("_key").alias("_top")).orderBy("_range").collect()  # as many as ranges
    if not ids:
        rows = before(rows)
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carry]).drop("_range", "_key")
    above = {r["_range"]: ids[(i + 1) % len(ids)]["_range"] for i, r in enumerate(ids)}
    heads = spark.createDataFrame([(r["_range"], r["_top"], above[r["_range"]]) for r in ids], f"_own int, _head {rows.schema['_key'].dataType.simpleString()}, _to int")
    first = rows.join(F.broadcast(heads), (F.col("_range") == F.col("_own")) & F.col("_key").eqNullSafe(F.col("_head")))
    first = first.withColumn("_place", F.row_number().over(Window.partitionBy("_own").orderBy(F.lit(0)))).where("_place = 1")
    first = first.withColumn("_range", F.col("_to")).select(*docs.columns, "_key", "_range", F.lit(True).alias("_guest"))
    both = rows.select(*docs.columns, "_key", "_range", F.lit(False).alias("_guest")).union(first).transform(before)
    order = Window.partitionBy("_range").orderBy("_guest", F.col("_key").desc())
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).where("NOT _guest").drop("_range", "_guest", "_key")


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document's text, by descending doc_id
    (after the last: the first).  Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (strings), near_edited, near_next.  A null
    text counts as empty; null ids come last, and rows of one id follow each
    other by their texts' hashes, so that reruns agree; a single row is its own
    next one; repeated rows each get their row; an empty table gives no rows.
    Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "own"], lambda df: with_fingerprint(df, "text", "own", **options))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    cut_off = F.expr("CAST(n_chars DIV 3 AS INT)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut_off), F.substring("next_text", F.lit(1), cut_off))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "changed", **options)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
