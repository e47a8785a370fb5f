"""Glob joins against matching every pattern with every name."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import globs
from quern.operators import globjoin

NAMES = ["", "a", "ab", "abc", "hello", "hello world", "helloworld", "say hello world now", "x86_64", "i386", "i686", "mingw32", "linux-gnu", "linux-musl", "file.c", "main.h", "file.cpp", "test*", "test?", "tést", "漢字", "line\nbreak", "[x]", "a-b", None, "abc"]
PATTERNS = ["", "*", "**", "?", "??", "a*", "*c", "h?llo*", "*hello*world*", "*-literal", "*.[ch]", "test\\*", "test\\?", "test[!0-9]*", "[a-m]*", "[!a]", "[ab][ab]", "i[3456]86", "x86*", "*mingw*", "linux-*", "*gnu", "t?st", "漢?", "line*k", "[", "[abc", "[]", "a\\", "\\[x]", "?*?", "[a]b", None, "a*", "nothing at all"]


def test_pairs_and_first_matches(spark):
    r = random.Random(4)
    names = NAMES + ["".join(r.choice("abc-.") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    patterns = PATTERNS + ["".join(r.choice(["a", "b", "c", "-", ".", "*", "?", "[ab]", "[!c]"]) for _ in range(r.randrange(1, 7))) for _ in range(200)]
    p, n = spark.createDataFrame([(x,) for x in patterns], "p string"), spark.createDataFrame([(x,) for x in names], "n string")
    want = {(x, y) for x in patterns for y in names if x is not None and y is not None and globs.matches(x, y)}
    got = [(a.p, a.n) for a in globjoin.glob_pairs(p, n, "p", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = globjoin.first_match(p, n, "p", "n").collect()
    best = {x: min((y for a, y in want if a == x), key=lambda y: (len(y), y.encode()), default=None) for x in patterns if x is not None}
    assert sorted((a.p or "", a.match or "") for a in first) == sorted((x or "", best.get(x) or "") for x in patterns)


@pytest.mark.parametrize("f", [globjoin.glob_pairs, globjoin.first_match])
def test_no_nested_loop(spark, f):
    p = spark.createDataFrame([("*a?c*",), ("x*",), ("*",)], "p string")
    n = spark.range(1000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("n"))
    plan = f(p, n, "p", "n")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert f(p, n.limit(0), "p", "n").count() == (0 if f is globjoin.glob_pairs else 3)


def test_many_patterns(spark):
    """More patterns than any list in the driver should hold."""
    p = spark.range(20_000).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit("*")).alias("p"))
    n = spark.range(2000).select(F.concat(F.lit("n"), (F.col("id") * 10).cast("string"), F.lit("x")).alias("n"))
    assert globjoin.glob_pairs(p, n, "p", "n").count() == sum(str(k * 10).startswith(str(j)) for k in range(2000) for j in {int(str(k * 10)[:i]) for i in range(1, len(str(k * 10)) + 1)} if str(j) == str(k * 10)[: len(str(j))])


def test_platforms(spark):
    patterns = spark.createDataFrame([("arch", "i?86"), ("arch", "x86*"), ("arch", "i386"), ("os", "mingw*"), ("os", "linux*"), ("os", "*win*"), ("arch", "vax"), ("os", None), ("os", "linux*")], "part string, pattern string")
    platforms = spark.createDataFrame([("x86_64", "linux"), ("x86", "windows"), ("i686", "darwin"), (None, "linuxkernel")], "arch string, os string")
    got = sorted((r.part, r.pattern or "", r.arch, r.os, r.env) for r in globjoin.platform_atoms(patterns, platforms).collect())
    assert got == sorted([("arch", "i?86", "i686", None, None), ("arch", "x86*", "x86", None, None), ("arch", "i386", "x86", None, None), ("os", "mingw*", None, "windows", "gnu"), ("os", "linux*", None, "linux", None), ("os", "linux*", None, "linux", None), ("os", "*win*", None, "darwin", None), ("arch", "vax", None, None, None), ("os", "", None, None, None)])
