"""As-of lookups and pairs in order against plain loops, with nulls, ties and buckets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import asof

SLOT = "CAST(floor(t / 7) AS INT)"
low = lambda x: (x is not None, x if x is not None else 0)


def made(seed, n=160):
    r = random.Random(seed)
    some = lambda most: r.choice([None, *range(most)])
    defs = [(some(3), r.choice([None, *range(40)]), r.choice([None, *range(100, 150)]), r.choice([None, [], ["a"], ["a", "b"], ["c"]])) for _ in range(n)]
    uses = [(k, some(4), r.choice([None, *range(40)]), r.choice([None, [], ["a"], ["a", "b"], ["a", "b", "c"]])) for k in range(n)]
    return defs, uses


@pytest.fixture(params=[1, 2])
def tables(spark, request):
    defs, uses = made(request.param)
    return defs, uses, spark.createDataFrame(defs, "k int, t int, v int, g array<string>"), spark.createDataFrame(uses, "id int, k int, t int, g array<string>")


@pytest.mark.parametrize("bucket", [None, SLOT])
def test_last_definition_keeps_every_use(tables, bucket):
    defs, uses, d, u = tables
    got = {r.id: r.definition for r in asof.last_definition(d, u, ["k"], ["t"], "v", bucket and F.expr(bucket)).collect()}
    assert set(got) == {x[0] for x in uses}
    for i, k, t, _ in uses:
        before = [x for x in defs if x[0] == k and low(x[1]) < low(t) and x[2] is not None]
        last = max((low(x[1]) for x in before), default=None)
        assert got[i] in {x[2] for x in before if low(x[1]) == last} if before else got[i] is None


@pytest.mark.parametrize("bucket", [None, SLOT])
def test_dominant_definition_of_null_guards(tables, bucket):
    defs, uses, d, u = tables
    got = {r.id: r.definition for r in asof.dominant_definition(d.where("v IS NOT NULL"), u, ["k"], ["t"], "v", "g", "id", bucket=bucket and F.expr(bucket)).collect()}
    for i, k, t, g in uses:
        before = [(low(x[1]), x[2]) for x in defs if x[0] == k and low(x[1]) < low(t) and x[2] is not None and (x[3] or []) == (g or [])[: len(x[3] or [])]]
        last = max((x[0] for x in before), default=None)
        assert got[i] in {v for at, v in before if at == last} if before else got[i] is None


@pytest.mark.parametrize("bucket", [None, SLOT])
def test_counts_keep_every_mark(tables, bucket):
    defs, uses, d, u = tables
    got = {r.id: (r.n_before, r.n_after) for r in asof.counts_around(u, d, ["k"], ["t"], bucket and F.expr(bucket)).collect()}
    assert got == {i: (sum(x[0] == k and low(x[1]) < low(t) for x in defs), sum(x[0] == k and low(x[1]) > low(t) for x in defs)) for i, k, t, _ in uses}


@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 7)])
def test_pairs(tables, bucket):
    defs, uses, d, u = tables
    u = u.withColumn("since", F.col("t") - 9)
    want = lambda keep: sorted(((i, x[2]) for i, k, t, _ in uses for x in defs if x[0] == k and keep(low(x[1]), low(t), low(None if t is None else t - 9))), key=str)
    got = lambda df, c: sorted(((r.id, r[c]) for r in df.collect()), key=str)
    assert got(asof.definitions_before(d, u, ["k"], ["t"], "v", bucket), "definition") == want(lambda x, t, s: x < t)
    assert got(asof.definitions_before(d, u, ["k"], ["t"], "v", bucket, ["since"]), "definition") == want(lambda x, t, s: s < x < t)
    assert got(asof.usages_after(d, u, ["k"], ["t"], "v", bucket), "usage") == want(lambda x, t, s: x > t)
    assert asof.usages_after(d.limit(0), u, ["k"], ["t"], "v", bucket).count() == 0


def test_pairs_of_a_large_key_are_split(spark):
    """A key with 200,000 events meets few marks in many tasks, and only near their bounds do rows meet that are no pair."""
    events = spark.range(200_000).selectExpr("1 AS k", "id AS t", "id AS v")
    marks = spark.createDataFrame([(i, 1, 1000 * i + 500) for i in range(0, 200, 20)], "id int, k int, t bigint")
    out = asof.definitions_before(events, marks, ["k"], ["t"], "v", lambda t: F.floor(t / 1000))
    assert out.count() == sum(1000 * i + 500 for i in range(0, 200, 20))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2


def test_order_of_several_columns(spark):
    rows = [(1, a, b) for a, b in itertools.product(range(4), range(4))]
    df = spark.createDataFrame(rows, "k int, a int, b int").withColumn("v", F.struct("a", "b"))
    got = asof.definitions_before(df, df.drop("v"), ["k"], ["a", "b"], "v", lambda a: F.floor(a / 2))
    assert sorted((r.a, r.b, *r.definition) for r in got.collect()) == sorted((*x[1:], *y[1:]) for x in rows for y in rows if y[1:] < x[1:])
