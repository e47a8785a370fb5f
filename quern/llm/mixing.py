"""Mixing sources to target weights.

Every document gets a seeded hash as its key; within each source documents are
taken in key order, their sizes summed by distributed prefix sums, until the
source's budget is met to the word.  A budget above the source's size is met by
whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hash_bucket, prefix_sums, tasks, unused
from .sharding import shuffle_key


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """Targets of sources: rows (source, source_size, weight) get ``target``.

    ``share`` of all sizes is dealt by weight; no target passes ``cap`` times
    its source's size, and what is over goes to the others by weight.  Sources
    are ordered by size over weight, the order in which they reach their cap,
    so that each knows from the sums before it what is left when it does.  The
    table has one row for each source, the list that a mixture is written in.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = cap * F.col("source_size").cast("double")
    level = (share * F.sum("source_size").over(whole).cast("double") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")) / F.sum("weight").over(after).cast("double")
    left = sizes.withColumn("_level", level).withColumn("_full", full)
    free = F.col("_level") * F.col("weight") <= F.col("_full")
    # the first source that stays under its cap sets the level of all after it
    left = left.withColumn("_common", F.first(F.when(free, F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("_common").isNull(), F.col("_full")).otherwise(F.col("_common") * F.col("weight"))
    return left.withColumn("target", target).drop("_level", "_full", "_common")


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights that repeat over the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))


def mix(docs: DataFrame, weights=cyclic_weights, share: float = 1.0, cap: float = 3.0, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, epochs.

    size: words of the text (null: 0).  ``weights`` maps the table (source,
    source_size) to the same with a column weight; a weight of 0 or less takes
    nothing.  epochs: how often the whole document is taken; taken: its words
    times epochs plus, for the one document of a source at which the budget
    ends, the words still missing.  So a source's taken words are its target,
    rounded down.  Null is a source like others; a source without words takes
    none; repeated rows are separate documents, in any order among themselves.
    An empty table gives no rows.  Other columns are not read.
    """
    return _taken(docs, weights, share, cap, seed, doc_id, text, source).drop("_row")


def _taken(docs: DataFrame, weights, share: float, cap: float, seed: int, doc_id: str, text: str, source: str, row: Column | None = None) -> DataFrame:
    """What ``mix`` returns, and ``_row``: the row's own number, which breaks ties."""
    key = shuffle_key(seed, F.col("doc_id"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), (F.lit(0).cast("bigint") if row is None else row).alias("_row"))
    rows = cut(rows.withColumn("_key", key), "mixing")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sizes = cut(sizes, "mixing")
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    plan = water_fill(weights(sizes.drop("_rows")).where("weight > 0"), share, cap)
    plan = plan.select(F.col("source").alias("_source"), F.col("source_size").alias("_size"), "target")
    rows = rows.withColumn("_bucket", hash_bucket(F.col("_key"), tasks(docs.sparkSession, total)))
    rows = prefix_sums(rows, ["source"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_row")], F.col("size"), "_upto")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    budget = F.floor(F.coalesce(F.col("target"), F.lit(0.0))).cast("bigint")
    rows = rows.withColumn("_turns", F.when(F.col("_size") > 0, F.expr("CAST(floor(coalesce(target, 0)) AS BIGINT) DIV _size")).otherwise(F.lit(0)))
    rest = budget - F.col("_turns") * F.coalesce(F.col("_size"), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_upto") - F.col("size"))))
    rows = rows.withColumn("_part", F.when(F.col("_size") > 0, part).otherwise(F.lit(0)))
    return rows.select(
        "doc_id", "source", "size", F.coalesce("_size", F.lit(0)).cast("bigint").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("_turns") * F.col("size") + F.col("_part")).cast("bigint").alias("taken"),
        (F.col("_turns") + F.when((F.col("_part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("bigint").alias("epochs"), "_row",
    )


def mixed_documents(docs: DataFrame, weights=cyclic_weights, share: float = 1.0, cap: float = 3.0, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Texts stay whole: the one document of a source at which the budget ends is
    taken once more if at least half of it is within, so a source's words are
    its target to half a document.  Each row counts for itself, also if it
    shares its doc_id with others or has none: rows are numbered as they are
    written to the shared folder, once.  Rows without words (null, empty, white
    space) have no share and are not taken.  Other columns may have any names.
    An empty table gives no rows.
    """
    row, plan_row, n, k = unused(docs, "_mix_row", "_plan_row", "_mix_n", "_mix_k")
    docs_ = cut(docs.select("*", F.monotonically_increasing_id().alias(row)), "mix-rows")
    plan = _taken(docs_, weights, share, cap, seed, doc_id, text, source, F.col(row))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    plan = plan.select(F.col("_row").alias(plan_row), times.alias(n)).where(F.col(n) > 0)
    out = docs_.join(plan.hint("shuffle_hash"), F.col(row) == F.col(plan_row))
    return out.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
