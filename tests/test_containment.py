"""Containment against a plain loop: nested and crossing intervals, nulls, repeats, widths."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import macros, options, trees
from quern.operators.containment import contained
from quern.plans import table_queries


def nested(r, lo, hi, depth=0):
    out = [(lo, hi)]
    at = lo + 1
    while at < hi and depth < 6:
        size = r.randrange(1, max(2, hi - at))
        out += nested(r, at, min(hi, at + size), depth + 1)
        at += size
    return out


def made(seed, crossing):
    r = random.Random(seed)
    intervals, places = [], []
    for k in (1, 2, None):
        spans = [(r.randrange(80), r.randrange(80)) for _ in range(40)] if crossing else nested(r, 0, 60)
        intervals += [(k, lo, hi, len(intervals) + n) for n, (lo, hi) in enumerate(spans)]
        places += [(k, r.choice([None, *range(-3, 85)]), f"p{len(places) + n}") for n in range(60)]
    return intervals + intervals[:3], places


@pytest.mark.parametrize("crossing", [False, True])
@pytest.mark.parametrize("width", [1, 7, 1 << 16])
@pytest.mark.parametrize("closed", [False, True])
def test_contained(spark, crossing, width, closed):
    intervals, places = made(width, crossing)
    a = spark.createDataFrame(intervals, "k int, lo int, hi int, i int")
    b = spark.createDataFrame(places, "k int, at bigint, p string")
    want = sorted((k, i, p) for k, lo, hi, i in intervals for k2, at, p in places if k == k2 and k is not None and at is not None and (lo < at or closed and lo == at) and at < hi)
    got = contained(a, b, ["k"], "lo", "hi", "at", "i", "p", closed, width)
    assert sorted((r.k, r.interval, r.place) for r in got.collect()) == want
    assert contained(a, b.limit(0), ["k"], "lo", "hi", "at", "i", "p").count() == 0


def test_several_keys_and_large_groups(spark):
    """One key of 100,000 nested nodes lies in many tasks; no join stands in the plan."""
    nodes = spark.range(100_000).selectExpr("'s' AS script_id", "id AS node_id", "id AS exec_id", "CASE WHEN id = 0 THEN 100000 WHEN id % 100 = 0 THEN id + 100 ELSE id + 1 END AS exit_id")
    out = trees.descendants(nodes)
    assert "Join" not in out._jdf.queryExecution().toString()
    assert out.count() == 99_999 + 99 * 999
    narrow = contained(nodes, nodes, ["script_id"], "exec_id", "exit_id", "exec_id", "node_id", "node_id", width=1000)
    parts = [r["count"] for r in narrow.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 99_999 + 99 * 999 and len(parts) > 1


def test_no_range_join_of_scripts(spark):
    """Operators on what stands within what join by equal keys alone."""
    nodes = spark.createDataFrame([("s", 1, 0, 9), ("s", 2, 1, 5), ("s", 3, 2, 3), ("s", 4, 6, 8)], "script_id string, node_id bigint, exec_id bigint, exit_id bigint")
    terms = spark.createDataFrame([("s", "v", 1, 0, "Var"), ("s", "v", 2, 0, "Var"), ("s", "w", 4, 0, "Var")], "script_id string, name string, node_id bigint, guard int, atom_kind string")
    outer = options.outermost_guarded(terms, nodes)
    assert sorted((r.name, r.node_id) for r in outer.collect()) == [("v", 1), ("w", 4)]
    kept = options.without_declarations(nodes, spark.createDataFrame([("s", 2)], "script_id string, node_id bigint"))
    assert sorted(r.node_id for r in kept.collect()) == [1, 4]
    calls = spark.createDataFrame([("s", 2, "AC_ARG_WITH", [("lit", "x-y")])], "script_id string, node_id bigint, name string, args array<struct<kind:string,text:string>>")
    events = spark.createDataFrame([("s", "a", "def", 2), ("s", "withval", "def", 2), ("s", "b", "def", 6), ("s", "c", "use", 2)], "script_id string, var string, event string, exec_id bigint")
    assert [(r.option, r.vars) for r in macros.build_options(calls, events, nodes).collect()] == [("x_y", ["a"])]
    for df in (outer, kept):
        assert "exec_id < " not in df._jdf.queryExecution().optimizedPlan().toString()


def test_intervals_without_room_are_not_sent(spark):
    """Most nodes have nothing in them: they go into no shuffle; closed ones hold their own place."""
    df = spark.range(50).selectExpr("1 AS k", "id AS b", "id + 1 AS e").union(spark.sql("SELECT 1, CAST(10 AS BIGINT), CAST(12 AS BIGINT)"))
    open_ = contained(df, df, ["k"], "b", "e", "b", "b", "b")
    assert {tuple(r) for r in open_.collect()} == {(1, 10, 11)}
    assert contained(df.where("e = b + 1"), df, ["k"], "b", "e", "b", "b", "b").count() == 0
    closed = contained(df, df, ["k"], "b", "e", "b", "b", "b", closed=True)
    assert {tuple(r) for r in closed.collect()} == {(1, k, k) for k in range(50)} | {(1, 10, 11)}


def test_small_partitions(spark):
    """Where the session says nothing, a task sorts a few MB of a shuffle; what a session sets stays."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        assert trees.small_partitions(spark).conf.get(name) == str(8 << 20)
        spark.conf.set(name, "16m")
        assert trees.small_partitions(spark).conf.get(name) == "16m"
    finally:
        spark.conf.set(name, before)


def test_more_partitions_for_more_rows(spark):
    """A shuffle begins with a partition for every so many rows; what the session has is never lowered."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        for rows, want in ((8 * trees.ROWS, None), (8 * trees.ROWS + 1, "9"), (30 * trees.ROWS, "30"), (20 * trees.ROWS, "30")):
            assert trees.small_partitions(spark, rows).conf.get(name, None) == want
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("query", ["dependencies_of_lines", "edges_of_lines", "options_turned_on", "outermost_blocks", "variables_of_declarations"])
def test_tasks_do_not_grow(spark, monkeypatch, query):
    """However few partitions the session names, all shuffles of nodes are dealt by the number of rows, and the result stays."""
    name, data = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "/root/testdata/sf0.001"
    run = lambda: table_queries.queries()[query](spark, data)
    want = sorted(map(str, run().collect()))
    monkeypatch.setattr(trees, "ROWS", 100, raising=False)
    try:
        df = run()
        dealt = {int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}
        rows = sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("orders", "lineitem"))
        assert dealt == {-(-rows // 100)}
        assert sorted(map(str, df.collect())) == want
    finally:
        spark.conf.unset(name)


def test_lines_are_dealt_before_they_are_counted(spark):
    """Counting a file's lines by order holds no order of the file in a task that reads it."""
    plan = table_queries.nodes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"partial_count.*\n.*Exchange hashpartitioning\(o_orderkey#\d+L?, \d+\), REPARTITION_BY_COL", plan)


@pytest.mark.parametrize("off", ["spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"])
def test_tasks_do_not_grow_without_merging(spark, monkeypatch, off):
    """Where adaptive execution doesn't merge partitions, shuffles are dealt by the number of rows too; more partitions of the session stay."""
    name, data = "spark.sql.shuffle.partitions", "/root/testdata/sf0.001"
    before, was = spark.conf.get(name), spark.conf.get(off)
    want = sorted(map(str, table_queries.queries()["edges_of_lines"](spark, data).collect()))
    monkeypatch.setattr(trees, "ROWS", 100)
    try:
        spark.conf.set(off, "false")
        df = table_queries.queries()["edges_of_lines"](spark, data)
        dealt = {int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}
        rows = sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("orders", "lineitem"))
        assert dealt == {-(-rows // 100)}
        assert sorted(map(str, df.collect())) == want
        assert trees.small_partitions(spark, 100).conf.get(name) == str(-(-rows // 100))
    finally:
        spark.conf.set(name, before)
        spark.conf.set(off, was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
