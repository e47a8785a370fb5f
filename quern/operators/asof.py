"""Which definition reaches a use, and what comes before and after: as-of and range lookups on ordered events.

``defs`` and ``uses`` are ordered by columns that both have.  Rows travel once,
with a window over key and ``bucket``; what earlier buckets hold comes from a
table with a row for each key and bucket.  A key with very many events is so
dealt over its buckets, at the price of two aggregates and a join with their
table: worth it only where a key may be too large for a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.sequences import carried


def last_definition(defs: DataFrame, uses: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column | None = None, out: str = "definition") -> DataFrame:
    """``uses`` with ``out``: the value of the latest definition strictly before each, null if there is none.

    Every use keeps its row.  Null keys are a key like others, null order
    values come before all others, and a definition without a value defines
    nothing; ``bucket`` changes none of this.
    """
    slot = F.lit(0) if bucket is None else bucket
    columns = [c for c in uses.columns]
    marked = uses.select(*columns, slot.alias("_bucket"), F.lit(1).alias("_use"), F.lit(None).cast(defs.schema[value].dataType).alias("_value"))
    given = defs.select(*[F.col(c) if c in {*by, *order} else F.lit(None).cast(uses.schema[c].dataType).alias(c) for c in columns], slot.alias("_bucket"), F.lit(0).alias("_use"), F.col(value).alias("_value"))
    # among equals a use comes first: the definition must be before it
    ordered = [*[F.col(c) for c in order], F.col("_use").desc()]
    rows = marked.union(given)
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy(*by, "_bucket").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn(out, own).where("_use = 1")
    if bucket is None:
        return found.select(*columns, out)
    # a bucket's latest definition, for buckets that hold uses alone too
    latest = rows.groupBy(*by, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = latest.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    return carried(found, carry, by).select(*columns, F.coalesce(out, "_carry").alias(out))


def dominant_definition(defs: DataFrame, uses: DataFrame, by: Sequence[str], order: Sequence[str], value: str, guard: str, use_id: str, out: str = "definition", bucket: Column | None = None) -> DataFrame:
    """The latest definition before each use whose guards are a prefix of the use's.

    ``guard``: array column on both sides, null being the empty one.  A use's
    guard has few prefixes, so it looks for an equal guard under each of them,
    one as-of lookup of equal keys, and takes the latest.  ``use_id`` tells
    uses apart.
    """
    held = F.coalesce(guard, F.array().cast("array<string>"))
    keyed = uses.withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(0), F.size(held)), lambda n: F.concat_ws("\x1f", F.slice(held, 1, n)))))
    given = defs.select(*by, *order, F.struct(*order, value).alias("_def"), F.concat_ws("\x1f", held).alias("_prefix"))
    found = last_definition(given, keyed, [*by, "_prefix"], order, "_def", bucket, "_found")
    best = found.groupBy(F.col(use_id).alias("_of")).agg(F.max("_found")[value].alias(out))
    return uses.join(best, F.col(use_id).eqNullSafe(F.col("_of")), "left").drop("_of")


def counts_around(marks: DataFrame, events: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """``marks`` with n_before and n_after: how many of ``events`` of the same key come strictly before and after.

    Every mark keeps its row; nulls are as in ``last_definition``.
    """
    columns = marks.columns
    slot = (F.lit(0) if bucket is None else bucket).alias("_bucket")
    rows = marks.select(*columns, slot, F.lit(1).alias("_mark"), F.lit(0).alias("_n")).union(
        events.select(*[F.col(c) if c in {*by, *order} else F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in columns], slot, F.lit(0).alias("_mark"), F.lit(1).alias("_n"))
    )
    keys = [*by, "_bucket"]
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, 0))
    equal = F.sum("_n").over(Window.partitionBy(*keys, *order))
    held = rows.groupBy(*keys).agg(F.sum("_n").alias("_held"))
    both = Window.partitionBy(*by)
    held = held.withColumn("_all", F.sum("_held").over(both)).withColumn("_past", F.coalesce(F.sum("_held").over(both.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.select("*", (upto - equal).alias("_near"), upto.alias("_upto")).where("_mark = 1")
    return carried(rows, held, by).select(*columns, (F.col("_past") + F.col("_near")).alias("n_before"), (F.col("_all") - F.col("_past") - F.col("_upto")).alias("n_after"))


def definitions_before(defs: DataFrame, uses: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Callable[[Column], Column] | None = None, since: Sequence[str] | None = None, out: str = "definition") -> DataFrame:
    """``uses`` with ``out``, a row for each definition of the key strictly before the use.

    ``since`` names columns of ``uses``, one for each of ``order``: then only
    definitions strictly after those.  A use without definitions has no row.
    """
    return _pairs(defs, uses, by, order, value, bucket, since, order, out)


def usages_after(uses: DataFrame, marks: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Callable[[Column], Column] | None = None, until: Sequence[str] | None = None, out: str = "usage") -> DataFrame:
    """``marks`` with ``out``, a row for each usage of the key strictly after the mark, and strictly before ``until`` if that is named."""
    return _pairs(uses, marks, by, order, value, bucket, order, until, out)


def _pairs(events: DataFrame, marks: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Callable[[Column], Column] | None, after: Sequence[str] | None, before: Sequence[str] | None, out: str) -> DataFrame:
    """``marks`` with ``out``: a row for each of ``events`` of the key strictly between two places.

    ``bucket`` makes a bucket, whose order agrees, of the first of ``order``.
    A mark is sent to the buckets in its range in which its key has events,
    nowhere else, and meets the events of key and bucket there: so a key with
    very many events lies in many tasks, and but for the two buckets at the
    ends whatever meets is a row of the result.  Nulls are as in
    ``last_definition``; a null bound comes before all events.
    """
    slot = lambda names: F.struct((F.lit(0) if bucket is None else bucket(F.col(names[0]))).alias("b"))
    place = lambda names: F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(names)])
    key = F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(by)])  # of structs nulls are equal and come first
    held = events.select(key.alias("_key"), slot(order).alias("_bucket"), place(order).alias("_at"), F.col(value).alias(out))
    there = held.select("_key", "_bucket").distinct()
    fits, inside = F.lit(True), F.lit(True)
    asked = marks.select("*", key.alias("_mark_key"), *[c for k, names in enumerate((after, before)) if names for c in (slot(names).alias(f"_slot{k}"), place(names).alias(f"_bound{k}"))])
    if after:
        fits, inside = fits & (F.col("_bucket") >= F.col("_slot0")), inside & (F.col("_at") > F.col("_bound0"))
    if before:
        fits, inside = fits & (F.col("_bucket") <= F.col("_slot1")), inside & (F.col("_at") < F.col("_bound1"))
    sent = asked.join(there, (F.col("_mark_key") == F.col("_key")) & fits).withColumnRenamed("_bucket", "_sent").drop("_key")
    met = sent.join(held, (F.col("_mark_key") == F.col("_key")) & (F.col("_sent") == F.col("_bucket")) & inside)
    return met.select(*marks.columns, out)


def def_use_edges(reached: DataFrame, definition: str, use: str) -> DataFrame:
    """Each definition with the sorted set of uses that it reaches."""
    return reached.where(F.col(definition).isNotNull()).groupBy(definition).agg(F.array_sort(F.collect_set(use)).alias("uses"))


def unused_definitions(defs: DataFrame, uses: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Definitions with no later use of the same key: compared with the last use of the key alone."""
    last = uses.groupBy(*by).agg(F.max(order).alias("_last"))
    return defs.join(last, list(by), "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col(order))).drop("_last")


def in_all_branches(rows: DataFrame, by: Sequence[str], branch: str, branches: Sequence) -> DataFrame:
    """Keys that occur in every one of the branches."""
    return rows.where(F.col(branch).isin(list(branches))).groupBy(*by).agg(F.countDistinct(branch).alias("_n")).where(F.col("_n") == len(set(branches))).drop("_n")


def first_calls(calls: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: what a oneshot macro leaves.  An aggregate, combined before the shuffle."""
    rest = [c for c in calls.columns if c not in by]
    least = calls.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return least.select(*by, "_row.*").select(*calls.columns)
