"""Products and fixpoints of values against plain versions."""

import itertools
import random

from quern.operators import valuesets

PARTS = "k int, var string, def_id string, pos int, kind string, text string"


def fixpoint(defs):
    """All values of each variable, by trying until nothing new comes up; concatenations that depend on themselves give nothing."""
    needs = {}
    for _, v, parts in defs:
        needs.setdefault(v, set()).update(t for kind, t in parts if kind == "ref")
    reach = {v: set(x) for v, x in needs.items()}
    for _ in reach:
        for v in reach:
            reach[v] |= {y for x in set(reach[v]) for y in reach.get(x, ())}
    held = {}
    while True:
        size = sum(map(len, held.values()))
        for _, v, parts in defs:
            if len(parts) > 1 and any(kind == "ref" and v in {t, *reach.get(t, ())} for kind, t in parts):
                continue
            choices = [[t] if kind == "lit" else sorted(held.get(t, ())) for kind, t in parts]
            held.setdefault(v, set()).update("".join(c) for c in itertools.product(*choices))
        if sum(map(len, held.values())) == size:
            return {(v, x) for v, xs in held.items() for x in xs}


def test_value_sets(spark):
    r = random.Random(9)
    rows, want = [], set()
    for k in range(12):
        defs = []
        for n in range(r.randrange(3, 12)):
            parts = [("lit", r.choice("xyz")) if r.random() < 0.5 else ("ref", r.choice("abcde")) for _ in range(r.choice([1, 1, 2, 3]))]
            defs.append((n, r.choice("abcde"), parts))
        want |= {(k, *x) for x in fixpoint(defs)}
        rows += [(k, v, f"d{n}", 10 * p, kind, t) for n, v, parts in defs for p, (kind, t) in enumerate(parts)]
    got = [tuple(x) for x in valuesets.value_sets(spark.createDataFrame(rows, PARTS), ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cycles_and_gaps(spark):
    rows = [(1, "a", "1", 0, "ref", "b"), (1, "b", "2", 0, "ref", "a"), (1, "b", "3", 0, "lit", "x"), (1, "c", "4", 0, "ref", "c"), (1, "c", "4", 1, "lit", "y"), (1, "c", "5", 0, "lit", "z"), (1, "d", "6", 0, "ref", "gone"), (1, "d", "6", 1, "lit", "w"), (2, "a", "7", 0, "ref", "b")]
    df = spark.createDataFrame(rows, PARTS)
    assert sorted(tuple(x) for x in valuesets.value_sets(df, ["k"]).collect()) == [(1, "a", "x"), (1, "b", "x"), (1, "c", "z")]
    assert valuesets.value_sets(df.limit(0), ["k"]).count() == 0


def test_guarded_product(spark):
    """What both sides begin with stays, from either side; what one has beyond it goes."""
    rows = [(1, 0, "a", ["W", "X"]), (1, 0, "b", ["W"]), (1, 1, "c", ["W", "X", "Y"]), (1, 1, "d", ["V"]), (1, 1, None, ["W"]), (2, 7, "e", ["Z"]), (2, 7, "e", ["Z"]), (3, 0, "f", None), (3, 5, "g", ["Q"])]
    got = sorted((r.k, r.value, r.conds) for r in valuesets.guarded_product(spark.createDataFrame(rows, "k int, p int, v string, c array<string>"), ["k"], "p", "v", "c").collect())
    assert got == [(1, "ac", ["W", "X"]), (1, "ad", []), (1, "bc", ["W"]), (1, "bd", []), (2, "e", ["Z"]), (3, "fg", [])]


def test_divisions(spark):
    one = lambda *x: [{"kind": k, "text": t} for k, t in x]
    shape = "kind string, text string"
    ids = [("s", 1, 10, one(("var", "p"), ("lit", "_"), ("var", "q"))), ("s", 2, 3, one(("lit", "x_"), ("var", "q"))), ("t", 1, 10, one(("var", "p"))), ("s", 3, 9, one())]
    values = [("s", 1, "p", "x"), ("s", 1, "p", "xx"), ("s", 1, "q", "y"), ("s", 1, "q", "z"), ("s", 1, "q", "x_y"), ("s", 2, "q", "y"), ("s", 2, "q", "z"), ("t", 1, "p", "x_y"), ("s", 1, "p", "x_x")]
    known = [("s", "x_y", 5, "def"), ("s", "x_z", 10, "def"), ("s", "xx_z", 99, "use"), ("s", "x_x_y", 1, "def"), ("t", "other", 1, "def")]
    found = valuesets.divisions(spark.createDataFrame(ids, f"s string, e int, at int, parts array<struct<{shape.replace(' string', ':string')}>>"), spark.createDataFrame(values, "s string, e int, var string, value string"), spark.createDataFrame(known, "s string, name string, at int, role string"), ["s"], "e")
    got = sorted((r.s, r.e, r.name, [tuple(m) for m in r.mapping]) for r in found.collect())
    assert got == [("s", 1, "x_x_y", [("p", "x"), ("q", "x_y")]), ("s", 1, "x_x_y", [("p", "x_x"), ("q", "y")]), ("s", 1, "x_y", [("p", "x"), ("q", "y")]), ("s", 1, "xx_z", [("p", "xx"), ("q", "z")])]


def test_edges_on_cycles(spark, monkeypatch):
    """Chains are cut off from both ends, so no closure is made of what has no cycle; a definition with one ref keeps its literals around it."""
    closed = []
    closure = valuesets.graphs.closure
    monkeypatch.setattr(valuesets.graphs, "closure", lambda e: (closed.append(e.count()), closure(e))[1])
    chain = [(k, f"v{n}", f"d{n}", p, kind, t) for k in range(4) for n in range(1, 7) for p, (kind, t) in enumerate([("lit", "<"), ("ref", f"v{n - 1}"), ("lit", ">")])] + [(k, "v0", "d0", 0, "lit", "x") for k in range(4)]
    got = {tuple(x) for x in valuesets.value_sets(spark.createDataFrame(chain, PARTS), ["k"]).collect()}
    assert got == {(k, f"v{n}", "<" * n + "x" + ">" * n) for k in range(4) for n in range(7)} and not closed
    cycle = [(9, "a", "1", 0, "lit", "y"), (9, "a", "1", 1, "ref", "b"), (9, "b", "2", 0, "ref", "a"), (9, "b", "3", 0, "lit", "z")]
    got = {tuple(x) for x in valuesets.value_sets(spark.createDataFrame([*chain, *cycle], PARTS), ["k"]).where("k = 9").collect()}
    assert got == {(9, "b", "z")} and closed == [2]
