"""Platforms and include directories as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sequences import number_rows


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """(name, arch, os, env, abi) of a JSON object with an entry for each target; its path is a parameter."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<arch:string,os:string,env:string,abi:string>>")).alias("name", "t"))
    return rows.select("name", "t.*")


def supported(platforms: DataFrame, part: str) -> DataFrame:
    """Different values of arch or os with their place by length, then text; numbered length by length."""
    rows = platforms.select(F.col(part).alias("name")).where("name IS NOT NULL").distinct().withColumn("size", F.length("name"))
    return number_rows(rows, [], ["size", "name"], "place", F.col("size")).select("name", "place")


def msvc_directories(include: str) -> list[str]:
    return [p for p in include.split(";") if p]


def compiler_directories(stderr: str) -> list[str]:
    """Directories between the two marker lines of a preprocessor's verbose output."""
    out, inside = [], False
    for line in stderr.splitlines():
        if line.startswith("#include <...>"):
            inside = True
        elif line.startswith("End of search list"):
            break
        elif inside:
            out.append(line.strip().split(" (framework")[0])
    return out
