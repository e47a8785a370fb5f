"""Ordered operators: numbering, runs, gaps, adjacent repeats, look-ahead chunks.

Where a key can hold very many rows, ``bucket`` (an integer or date column
whose order agrees with ``order``) deals it over tasks; what a bucket needs of
the ones before it comes from a table with a row for each key and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "exec_id", bucket: Column | None = None) -> DataFrame:
    if bucket is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    held = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = held.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    return carried(local, counts, by).withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_before")


def carried(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns that the table has for their key and bucket; nulls are keys like others."""
    keys = [*by, "_bucket"]
    named = table.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(named[f"_of_{k}"])
    return rows.join(named, same, "left").drop(*[f"_of_{k}" for k in keys])


def _previous(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column | None) -> DataFrame:
    """``_before``: a struct of the value of the row before in the key's order, null for the first row of all."""
    held = rows.withColumn("_bucket", F.lit(0) if bucket is None else bucket).withColumn("_own", F.struct(F.col(value).alias("v")))
    near = F.lag("_own").over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    if bucket is None:
        return held.withColumn("_before", near).drop("_own", "_bucket")
    last = held.groupBy(*by, "_bucket").agg(F.max_by("_own", F.struct(*order)).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket"))).drop("_last")
    return carried(held.withColumn("_before", near), last, by).withColumn("_before", F.coalesce("_before", "_carry")).drop("_own", "_bucket", "_carry")


def runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], mark: str, bucket: Column | None = None) -> DataFrame:
    """Runs of equal marks that follow each other: by, run number from 0, mark, size, and first and last of the last order column."""
    seen = _previous(rows, by, order, mark, bucket)
    new = (F.col("_before").isNotNull() & ~F.col(mark).eqNullSafe(F.col("_before.v"))).cast("bigint")
    seen = seen.withColumn("_new", new).drop("_before")
    if bucket is None:
        numbered = seen.withColumn("run", F.sum("_new").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        held = seen.withColumn("_bucket", bucket)
        before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = held.groupBy(*by, "_bucket").agg(F.sum("_new").alias("_n")).withColumn("_done", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        local = held.withColumn("run", F.sum("_new").over(Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        numbered = carried(local, sums, by).withColumn("run", F.col("run") + F.col("_done"))
    return numbered.groupBy(*by, "run", mark).agg(F.count("*").alias("size"), F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"))


def drop_adjacent_repeats(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column | None = None) -> DataFrame:
    seen = _previous(rows, by, order, value, bucket)
    return seen.where(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))).drop("_before")


def subtract_intervals(ranges: DataFrame, gaps: DataFrame, key: str, lo: str, hi: str, gap_lo: str, gap_hi: str) -> DataFrame:
    """What is left of each whole-number range [lo, hi] without the gaps [gap_lo, gap_hi] of its key: rows (key, lo, hi).

    Each range is cut on its own, also if a key has several or they overlap;
    equal ranges give their parts as often as they stand there.  Gaps are
    sorted within their range; the running maximum of their ends says where the
    next free part can begin, so overlaps need no merge.
    """
    each = ranges.groupBy(F.col(key).alias("_key"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).agg(F.count("*").alias("_times"))
    cuts = gaps.select(F.col(key).alias("_k"), F.col(gap_lo).alias("_a"), F.col(gap_hi).alias("_b"))
    rows = each.join(cuts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_b") >= F.col("_lo")) & (F.col("_a") <= F.col("_hi")), "left")
    own = Window.partitionBy("_key", "_lo", "_hi").orderBy("_a", "_b")
    reach = F.coalesce(F.max("_b").over(own.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.col("_lo"))
    until = F.max("_b").over(Window.partitionBy("_key", "_lo", "_hi"))
    rows = rows.withColumns({"_from": F.greatest("_lo", reach), "_until": until, "_last": F.lead(F.lit(1)).over(own).isNull()})
    before = F.struct(F.col("_from").alias("lo"), F.coalesce(F.col("_a") - 1, F.col("_hi")).alias("hi"))
    after = F.struct(F.greatest(F.col("_lo"), F.col("_until") + 1).alias("lo"), F.col("_hi").alias("hi"))
    free = F.array(before, F.when(F.col("_last") & F.col("_a").isNotNull(), after))
    parts = rows.select("_key", "_times", F.explode(F.array_compact(free)).alias("f")).where("f.lo <= f.hi")
    return parts.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(F.col("_key").alias(key), F.col("f.lo").alias("lo"), F.col("f.hi").alias("hi"))


def look_ahead_chunks(rows: DataFrame, by: Sequence[str], order: Sequence[str], defines: str, uses: str, window: int = 2, out: str = "chunk", cut: str | None = None, free: str | None = None, within: str | None = None) -> DataFrame:
    """Fuses rows in order to chunks: the next row joins if it uses what the chunk defines, or else the rows up to the farthest related one of the next ``window``.

    ``defines`` and ``uses`` are arrays of strings, null being an empty one.
    Columns that may be named: a row with ``cut`` true begins a chunk where it
    is the next one; rows with ``free`` true (assignments) are looked through
    without counting for the window; looking ahead ends where ``within`` (the
    parent) isn't that of the chunk's first row.  The state is what the chunk
    defines so far and ``window`` rows with the free ones among them, so rows
    stream through, sorted within their partition, and a key is never held
    whole.
    """
    names = [*rows.columns, out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out} bigint"
    keyed, made, used = [rows.columns.index(c) for c in by], rows.columns.index(defines), rows.columns.index(uses)
    at = lambda c: rows.columns.index(c) if c else None
    cuts, frees, parent = at(cut), at(free), at(within)
    known = lambda x: None if x != x else x  # noqa: E731 - a missing number is not itself

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, have, inside, waiting, done = None, 0, None, None, [], []

        def ahead(end: bool) -> int | None:
            """How many rows are looked at; None if rows to come may be among them."""
            left = window
            for k, r in enumerate(waiting):
                passes = frees is not None and bool(r[frees])
                if not (left or passes) or parent is not None and known(r[parent]) != inside:
                    return max(k, 1)
                left -= not passes
            return max(len(waiting), 1) if end or not left and frees is None else None

        def settle(end: bool) -> None:
            nonlocal number, have, inside
            while waiting:
                if have is None:
                    taken, have, inside = 1, set(), known(waiting[0][parent]) if parent is not None else None
                elif cuts is not None and waiting[0][cuts]:
                    number, have = number + 1, None
                    continue
                elif waiting[0][used] is not None and not have.isdisjoint(waiting[0][used]):
                    taken = 1
                else:
                    n = ahead(end)
                    if n is None:
                        return
                    related = [k for k, r in enumerate(waiting[:n]) if r[used] is not None and not have.isdisjoint(r[used])]
                    if not related:
                        number, have = number + 1, None
                        continue
                    taken = related[-1] + 1
                for r in waiting[:taken]:
                    have.update(r[made] if r[made] is not None else ())
                    done.append((*r, number))
                del waiting[:taken]

        for frame in frames:
            for r in frame.itertuples(index=False, name=None):
                own = tuple(known(r[k]) for k in keyed)
                if own != key:
                    settle(True)
                    key, number, have = own, 0, None
                waiting.append(r)
                settle(False)
            yield pd.DataFrame(done, columns=names)
            done = []
        settle(True)
        yield pd.DataFrame(done, columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(fold, schema)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two arrays."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))), lambda i: F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    first = F.array_position(same, False)
    return F.slice(a, 1, F.when(F.least(F.size(a), F.size(b)) == 0, 0).otherwise(F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1)).cast("int"))
