"""Joins of glob patterns with names by an index of anchors.

A pattern's anchor is a piece of text that every name it matches must hold: of
the pieces of its longest literal runs the one that the fewest names hold.
Names are indexed by their pieces, patterns look their anchor up, and regular
expressions decide.  A pattern without literals is looked up by the characters
of its smallest class, one of wildcards alone by the length that it asks for.
So no pattern meets all names, however many there are of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import globs
from quern.operators.trees import cut

#: Characters of an anchor where the pattern has so many in a row.
PIECE = 3


def anchor_parts(pattern: str) -> tuple | None:
    """(regular expression, kind, pieces, least, exact) of a pattern, None for a bad one.

    kind ``all``: a name that matches holds each of the pieces; ``any``: one of
    them; ``length``: it has ``least`` characters, or more unless ``exact``.
    """
    expression = globs.to_regex(pattern)
    if expression is None:
        return None
    runs, run, classes = [], "", []
    parts = globs.parse(pattern)
    for kind, value in (*parts, ("many", None)):
        char = value if kind == "lit" else value[0] if kind == "class" and len(value) == 1 else None
        if char is not None:
            run += char
            continue
        runs, run = [*runs, run], ""
        classes += [value] if kind == "class" else []
    longest = max(map(len, runs))
    size = min(longest, PIECE)
    pieces = sorted({r[k : k + size] for r in runs for k in range(len(r) - size + 1)}) if size else []
    kind = "all" if pieces else "any" if classes else "length"
    if kind == "any":
        pieces = list(min(classes, key=len))
    many = sum(k == "many" for k, _ in parts)
    return expression[:-1] + r"\z", kind, pieces, len(parts) - many, not many


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(p, *parts) for p in f.pattern if (parts := anchor_parts(p))]
        yield pd.DataFrame(rows, columns=["pattern", "regex", "kind", "pieces", "least", "exact"])


def _parsed(patterns: DataFrame, pattern: str) -> DataFrame:
    rows = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct()
    return cut(rows.mapInPandas(_parts, "pattern string, regex string, kind string, pieces array<string>, least int, exact boolean"))


def _anchored(parsed: DataFrame, names: DataFrame) -> DataFrame:
    """(pattern, name) of the patterns that have pieces."""
    asked = parsed.where("kind <> 'length'").select("pattern", "kind", F.explode("pieces").alias("piece"))
    sizes = F.array(*[F.lit(k) for k in range(1, PIECE + 1)])
    cuts = F.flatten(F.transform(sizes, lambda n: F.when(F.length("name") >= n, F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda k: F.substring("name", k, n))).otherwise(F.array().cast("array<string>"))))
    pieces = names.select("name", F.explode(F.array_distinct(cuts)).alias("piece"))
    index = cut(pieces.join(asked.select("piece").distinct(), "piece"))
    held = index.groupBy("piece").agg(F.count("*").alias("n"))
    # a piece that no name holds is the rarest: then nothing matches
    ranked = asked.where("kind = 'all'").join(held, "piece", "left").groupBy("pattern").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    met = ranked.union(asked.where("kind = 'any'").select("pattern", "piece")).join(index, "piece").select("pattern", "name").distinct()
    return met.join(parsed.select("pattern", "regex"), "pattern").where(F.expr("name RLIKE regex")).select("pattern", "name")


def _by_length(parsed: DataFrame, names: DataFrame) -> DataFrame:
    """(pattern, name) of the patterns that ask for a length alone."""
    wild = parsed.where("kind = 'length'").select("pattern", "least", "exact")
    most = wild.groupBy().agg(F.max("least").alias("most")).first()[0]
    if most is None:
        return parsed.select("pattern", F.lit(None).cast("string").alias("name")).limit(0)
    sized = names.withColumn("size", F.length("name"))
    sizes = sized.select("size").distinct().withColumn("least", F.explode(F.sequence(F.lit(0), F.least("size", F.lit(most)))))
    fits = sizes.join(wild, "least").where("NOT exact OR size = least").select("pattern", "size")
    return sized.join(fits, "size").select("pattern", "name")


def glob_pairs(patterns: DataFrame, names: DataFrame, pattern: str, name: str) -> DataFrame:
    """(pattern, name) for each different pattern and each different name that it matches.

    Null patterns and names, and bad patterns, match nothing.
    """
    parsed = _parsed(patterns, pattern)
    different = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    found = _anchored(parsed, different).union(_by_length(parsed, different))
    return found.select(F.col("pattern").alias(pattern), F.col("name").alias(name))


def first_match(patterns: DataFrame, names: DataFrame, pattern: str, name: str) -> DataFrame:
    """``patterns`` with ``match``: the first name that each matches, by length and then by text; null without one."""
    parsed = _parsed(patterns, pattern)
    different = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    least = different.groupBy(F.length("name").alias("size")).agg(F.min("name").alias("name")).select("name")  # all that a length can choose
    met = _anchored(parsed, different).union(_by_length(parsed, least))
    first = met.groupBy(F.col("pattern").alias("_pattern")).agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("match"))
    return patterns.join(first, F.col(pattern) == F.col("_pattern"), "left").select(*patterns.columns, "match")


#: Names that scripts give to platforms which are known by others: architectures, and systems with their environment.
ARCH_ALTERNATIVES = [("i386", "x86")]
OS_ALTERNATIVES = [("mingw", "windows", "gnu")]


def platform_atoms(patterns: DataFrame, platforms: DataFrame) -> DataFrame:
    """``patterns`` (part: arch or os, pattern) with arch, os and env: the supported platform that each asks for.

    platforms: (arch, os).  The first supported name that matches wins, by
    length and text; without one, an alternative name that matches gives what
    it stands for, with the environment where it has one.  All null: not
    supported.  Repeated and null patterns keep their rows.
    """
    spark = patterns.sparkSession
    others = spark.createDataFrame([("arch", a, b, None) for a, b in ARCH_ALTERNATIVES] + [("os", a, b, e) for a, b, e in OS_ALTERNATIVES], "part string, alternative string, stands string, env string")
    out = None
    for part in ("arch", "os"):
        own = first_match(patterns.where(F.col("part") == part), platforms, "pattern", part)
        own = first_match(own.withColumnRenamed("match", "_known"), others.where(F.col("part") == part), "pattern", "alternative")
        known = others.where(F.col("part") == part).select(F.col("alternative").alias("match"), F.col("stands").alias("_stands"), F.col("env").alias("_env"))
        own = own.join(known, "match", "left").withColumns({"_name": F.coalesce("_known", "_stands"), "env": F.when(F.col("_known").isNull(), F.col("_env"))})
        own = own.select("part", "pattern", *[(F.col("_name") if p == part else F.lit(None).cast("string")).alias(p) for p in ("arch", "os")], "env")
        out = own if out is None else out.union(own)
    return out
