"""Closures, layers and orders of graphs against plain walks, and how many rounds they take."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import graphs, projects, trees


def walked(edges, start):
    seen, left = set(), [start]
    while left:
        for a, b in edges:
            if a == left[-1] and b not in seen:
                seen.add(b)
                left.insert(0, b)
        left.pop()
    return seen


@pytest.fixture
def cuts(monkeypatch):
    """How often tables are cut: twice a round."""
    counted = []
    monkeypatch.setattr(graphs, "cut", lambda df: (counted.append(1), trees.cut(df))[1])
    return counted


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_reach(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(20), r.randrange(20)) for _ in range(22)]
    df = spark.createDataFrame([*edges, edges[0], (None, 3), (3, None)], "src int, dst int")
    assert sorted(map(tuple, graphs.closure(df).collect())) == sorted((a, b) for a in range(20) for b in walked(edges, a))
    start = spark.createDataFrame([("x", 1), ("x", 2), ("y", edges[0][0]), ("y", 99), (None, 4)], "k string, n int")
    got = sorted(map(str, graphs.reached(start, df, ["k"], "n", "src", "dst").collect()))
    want = {("x", n) for n in {1, 2} | walked(edges, 1) | walked(edges, 2)} | {("y", n) for n in {edges[0][0], 99} | walked(edges, edges[0][0])} | {(None, n) for n in {4} | walked(edges, 4)}
    assert got == sorted(f"Row(k={k!r}, n={n})" for k, n in want)
    assert graphs.closure(df.limit(0)).count() == 0


def test_long_chains_end_in_few_rounds(spark, cuts):
    chain = spark.range(5000).selectExpr("id AS src", "id + 1 AS dst")
    assert graphs.reached(spark.createDataFrame([(0,)], "n bigint"), chain, [], "n", "src", "dst").count() == 5001
    assert len(cuts) <= 2 + 2 * 15
    cuts.clear()
    assert graphs.closure(chain.where("src < 1000")).count() == 1000 * 1001 // 2
    assert len(cuts) <= 1 + 2 * 12


def test_reach_of_branching_graphs(spark, monkeypatch):
    """Steps are squared while they stay few only; the result is the same however long that is, also on cycles."""
    squared, sizes = graphs._squared, []
    monkeypatch.setattr(graphs, "_squared", lambda step: (sizes.append(squared(step).count()), squared(step))[1])
    edges = [(n, c) for n in range(1, 400) for c in {n // 2, n // 3} if c != n] + [(0, 390)]
    df, start = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([("x", 390), ("y", 7), (None, 3)], "k string, n int")
    want = {(k, n) for k, at in (("x", 390), ("y", 7), (None, 3)) for n in {at} | walked(edges, at)}
    got = [tuple(r) for r in graphs.reached(start, df, ["k"], "n", "src", "dst").collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(sizes) <= 4 * len(edges)
    for growth in (0, 10**6):
        assert {tuple(r) for r in graphs.reached(start, df, ["k"], "n", "src", "dst", growth).collect()} == want


def test_layers(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5), (6, 7), (7, 8), (8, 7), (9, 6), (8, 5), (5, 77), (1, 2)]
    nodes = spark.createDataFrame([(k,) for k in range(1, 11)] + [(1,)], "n int")
    got = {r.n: (r.layer, r.error) for r in graphs.layers(nodes, spark.createDataFrame(edges, "p int, c int"), "n", "p", "c").collect()}
    bad = (None, "on or above a cycle")
    assert got == {5: (0, None), 4: (1, None), 2: (2, None), 3: (2, None), 1: (3, None), 10: (0, None), 6: bad, 7: bad, 8: bad, 9: bad}
    assert graphs.layers(nodes.limit(0), spark.createDataFrame(edges, "p int, c int"), "n", "p", "c").count() == 0


def test_layers_write_what_changes(spark, monkeypatch):
    """What rounds write is in proportion to nodes and edges, also where layers are many."""
    written = []
    monkeypatch.setattr(graphs, "cut", lambda df: (written.append(df.count()), trees.cut(df))[1])
    edges = spark.range(40).selectExpr("id + 1 AS p", "id AS c").union(spark.range(2, 40).selectExpr("id + 1 AS p", "id - 2 AS c"))
    nodes = spark.range(41).selectExpr("id AS n")
    assert sorted((r.n, r.layer) for r in graphs.layers(nodes, edges, "n", "p", "c").collect()) == [(k, k) for k in range(41)]
    assert sum(written) <= 4 * (41 + 78)


def test_closed_post_order(spark):
    nodes = spark.createDataFrame([(k, p) for k, p in ((1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (9, None), (10, 9))], "n int, p int")
    paths = trees.paths(nodes, "n", "p")
    got = graphs.closed_post_order(paths, spark.createDataFrame([(5,), (6,), (10,), (5,)], "node int"), []).orderBy("place").collect()
    assert [r.node for r in got] == [5, 2, 6, 3, 1, 10, 9]


def test_rounds_of_includes(spark, monkeypatch):
    """As many rounds as files are nested, whatever the number of includes; empty lines stay, unknown files and null texts too."""
    counted = []
    monkeypatch.setattr(projects, "cut", lambda df: (counted.append(1), trees.cut(df))[1])
    rows = [("many", "\n".join(f"include f{k % 7}" for k in range(500)))] + [(f"f{k}", f"{k}\n\ninclude g\n") for k in range(7)] + [("g", "x\n"), ("plain", "a\n\nb"), ("none", None), ("lost", "include nowhere\nnot include g")]
    got = {r.path: r.content for r in projects.inline_includes(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["f3"] == "3\n\nx\n\n" and got["many"] == "\n".join(f"{k % 7}\n\nx\n\n" for k in range(500))
    assert got["plain"] == "a\n\nb" and got["none"] is None and got["lost"] == "\nnot include g" and len(counted) <= 4


def test_long_alias_chains(spark):
    lines = "\n".join(f"#define A{k + 1} A{k}" for k in range(100)) + "\nuse(A100);\n#define B1 B2\n#define B2 B1\n"
    used = projects.values_used(spark.createDataFrame([("A0",), ("B1",), ("A99",)], "symbol string"), spark.createDataFrame([(lines,)], "content string"))
    assert sorted(r.symbol for r in used.collect()) == ["A0", "A99"]
    headers = spark.createDataFrame([(f"h{k}.h", f'#include "h{k + 1}.h"\n') for k in range(100)] + [("m.c", '#include "h0.h"\n#include <stdio.h>\n')], "path string, content string")
    inside, outside = projects.reached_headers(spark.createDataFrame([("m.c",)], "path string"), headers, [])
    assert inside.count() == 100 and sorted(r.header for r in outside.collect()) == ["h100.h", "stdio.h"]
    assert inside.select(F.max("path")).first()[0] == "h99.h"
