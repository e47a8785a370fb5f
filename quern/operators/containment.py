"""Structural containment: which intervals a place lies in, by one sorted pass that carries the intervals open at each place.

Intervals and places of a key are dealt by bucket, equal ranges of positions.
An interval is sent to every bucket that it reaches into, so what is open where
a bucket begins stands first in it; among nested sets that is one path of the
tree for each bucket.  A task sorts its rows and goes through them once, with
the open intervals in hand.  No rows meet but those of the result, and a key
of any size lies in as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Positions in a bucket, and rows in a batch of the result.
WIDTH, BATCH_ROWS = 1 << 16, 1 << 16


def contained(intervals: DataFrame, places: DataFrame, by: Sequence[str], begin: str, end: str, at: str, interval: str, place: str, closed: bool = False, width: int = WIDTH, names: tuple[str, str] = ("interval", "place")) -> DataFrame:
    """(by, interval, place) for each place with begin < at < end, or begin <= at < end if ``closed``, of an interval with equal keys.

    ``interval`` and ``place`` name the columns that stand for an interval and
    a place in the result, under ``names``.  Positions are whole numbers.
    Intervals may overlap in any way and repeat; each meets each place once.
    Null keys and positions match nothing, nor do intervals that end where they
    begin.  ``width`` is how many positions a bucket has; no result depends on it.
    """
    first, last = F.col(begin).cast("bigint"), F.col(end).cast("bigint")
    slot = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    wide = last > first if closed else last > first + 1  # others hold no place, such as nodes with nothing in them
    open_ = intervals.where(wide).select(*key, F.explode(F.sequence(slot(first), slot(last - 1))).alias("slot"), first.alias("at"), F.lit(0 if closed else 1).alias("side"), last.alias("end"), F.col(interval).alias("interval"), none(places, place).alias("place"))
    met = places.select(*key, slot(F.col(at).cast("bigint")).alias("slot"), F.col(at).cast("bigint").alias("at"), F.lit(1 if closed else 0).alias("side"), F.lit(None).cast("bigint").alias("end"), none(intervals, interval).alias("interval"), F.col(place).alias("place"))
    keys = [f"k{i}" for i in range(len(by))]
    rows = open_.union(met).where(F.col("at").isNotNull() & ~F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x))
    rows = rows.repartition(*keys, "slot").sortWithinPartitions(*keys, "slot", "at", "side")
    fields = StructType([*[rows.schema[k] for k in keys], rows.schema["interval"], rows.schema["place"]])
    out = rows.mapInArrow(_swept(len(by), to_arrow_schema(fields)), fields)
    return out.toDF(*by, *names)


def _swept(n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are by key, bucket and position; an interval's row has an end."""
        key: list | None = None
        ends: list[int] = []
        held: list = []  # what is open, in the order in which it began
        soonest = 0
        out: list[list] = [[] for _ in schema]

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for *own, at, _, end, interval, place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != key:
                    key, ends, held, soonest = own, [], [], 0
                if ends and soonest <= at:  # of nested sets the last ones end first
                    while ends and ends[-1] <= at:
                        ends.pop()
                        held.pop()
                    if ends and min(ends) <= at:
                        left = [k for k, e in enumerate(ends) if e > at]
                        ends, held = [ends[k] for k in left], [held[k] for k in left]
                    soonest = min(ends, default=0)
                if end is not None:
                    ends.append(end)
                    held.append(interval)
                    soonest = end if len(ends) == 1 else min(soonest, end)
                elif held:
                    for c, v in zip(out[:n], key[:n], strict=True):
                        c.extend([v] * len(held))
                    out[n].extend(held)
                    out[n + 1].extend([place] * len(held))
                    if len(out[n]) >= BATCH_ROWS:
                        yield taken()
        yield taken()

    return run
