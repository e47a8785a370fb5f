"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; row r of n
of a source gets the fractional rank (r - 1/2) / n.  All rows in the order of
their fractional ranks are cut into equal runs, so every shard holds each
source in its share of the whole (to a row or so), and the numbers of rows of
two shards differ by one at most.

Ranks are distributed: a hash range of a source, then a range of fractional
ranks, is all that one task sees, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_bucket, prefix_sums, tasks, unused


def shuffle_key(seed: int, *columns: Column) -> Column:
    """A hexadecimal hash of the seed and the columns, null apart from every value."""
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\x1enull")) for c in columns]))


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32: unsigned, of
    the UTF-8 text (null: of no bytes).  slot: gapless from 0 within a shard.
    A null source is a source of its own, a null doc_id a value like others.
    Repeated rows each get a slot; which of identical rows gets which cannot be
    told apart.  An empty table gives no rows.  Other columns are not read.
    """
    return _places(docs, shards, seed, doc_id, text, source).drop("_row")


def _places(docs: DataFrame, shards: int, seed: int, doc_id: str, text: str, source: str, row: Column | None = None) -> DataFrame:
    """What ``assign_shards`` returns, and ``_row``: the row's own number, which breaks ties."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), crc.alias("text_crc32"), (F.lit(0).cast("bigint") if row is None else row).alias("_row"))
    rows = cut(rows.withColumn("_key", shuffle_key(seed, F.col("doc_id"), F.col("text_crc32"))), "sharding")
    total = rows.count()
    buckets = tasks(docs.sparkSession, total)
    rows = rows.withColumn("_bucket", hash_bucket(F.col("_key"), buckets))
    order = [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_row")]
    rows = prefix_sums(rows, ["source"], "_bucket", order, F.lit(1), "_rank")
    held = rows.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
    rows = cut(rows.join(held, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_bucket"), "sharding")
    rows = rows.withColumn("_part", (2 * F.col("_rank") - 1) / (2 * F.col("_n")).cast("double"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_part") * buckets).cast("int"))
    order = [F.col("_part"), F.col("source"), F.col("_rank")]
    rows = prefix_sums(rows, [], "_bucket", order, F.lit(1), "_place")
    shard = F.expr(f"((_place - 1) * {shards}) DIV {max(total, 1)}")
    rows = rows.withColumn("_shard", shard)
    first = F.expr(f"(_shard * {total} + {shards - 1}) DIV {shards}")
    return rows.select("doc_id", "source", "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), (F.col("_place") - 1 - first).cast("bigint").alias("slot"), "_row")


def sharded(docs: DataFrame, shards: int = 16, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` with shard and slot (which replace columns of those names).

    Every row has a place of its own, also among equal rows: rows are numbered
    as they are written to the shared folder, once, and find their places by
    that number, in one shuffle of the texts.  Null texts, sources and ids are
    values like others; other columns may have any names; an empty table gives
    no rows.
    """
    row, place_row, shard, slot = unused(docs, "_shard_row", "_place_row", "_shard_no", "_shard_slot")
    docs_ = cut(docs.select("*", F.monotonically_increasing_id().alias(row)), "shard-rows")
    places = _places(docs_, shards, seed, doc_id, text, source, F.col(row))
    places = places.select(F.col("_row").alias(place_row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    kept = [F.col(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return docs_.join(places.hint("shuffle_hash"), F.col(row) == F.col(place_row)).select(*kept, F.col(shard).alias("shard"), F.col(slot).alias("slot"))
