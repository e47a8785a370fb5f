"""The data source of scripts: tasks by size, patterns on the list of files, unreadable files as rows, streams."""

import time

import pytest
from pyspark.sql import functions as F

from quern.sources import files
from quern.streaming import script_stream


@pytest.fixture
def source(spark):
    spark.dataSource.register(files.ScriptFiles)
    return spark.read.format("scripts")


def test_many_small_files_in_few_tasks(source, tmp_path):
    for k in range(10_000):
        folder = tmp_path / f"d{k % 20}"
        folder.mkdir(exist_ok=True)
        (folder / f"f{k}.ac").write_text(f"echo {k}\n")
    df = source.load(str(tmp_path))
    assert df.rdd.getNumPartitions() <= 2
    assert df.count() == 10_000 and df.agg(F.sum("bytes")).first()[0] == sum(len(f"echo {k}\n") for k in range(10_000))
    assert df.where("path = 'd3/f103.ac'").collect()[0].content == "echo 103\n"


def test_filters_errors_and_options(spark, source, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.ac", b"x=1\n"), ("sub/b.am", "größe\n".encode()), ("bad.ac", b"\xff\xfe\x00"), ("_hidden", b"no"), (".git", b"no"), ("empty.ac", b"")):
        (tmp_path / name).write_bytes(data)
    df = source.load(f"file://{tmp_path}")
    rows = {r.path: r for r in df.collect()}
    assert set(rows) == {"a.ac", "sub/b.am", "bad.ac", "empty.ac"} and rows["sub/b.am"].content == "größe\n" and rows["empty.ac"].content == ""
    assert rows["bad.ac"].content is None and "UnicodeDecodeError" in rows["bad.ac"].error and rows["a.ac"].error is None
    assert [r.path for r in df.where(F.col("path").endswith(".am")).collect()] == ["sub/b.am"]
    assert sorted(r.path for r in df.where(F.col("path").startswith("a") | F.col("path").contains("sub")).collect()) == ["a.ac", "sub/b.am"]
    ends = spark.read.format("scripts").option("match", "*.am").option("targetFiles", 1).load(str(tmp_path))
    assert [r.path for r in ends.collect()] == ["sub/b.am"] and ends.rdd.getNumPartitions() == 1
    assert {r.content for r in source.option("content", "false").load(str(tmp_path)).collect()} == {None}
    assert source.load(str(tmp_path / "sub")).count() == 1


def test_tasks_by_size():
    parts = files.dealt([(f"f{k}", size, 0) for k, size in enumerate([10, 200, 10, 10, 90, 5, 5, 5])], 100, 3)
    assert [p.sizes for p in parts] == [[10], [200], [10, 10], [90, 5, 5], [5]]


def test_stream_shares_the_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"f{k}").write_text(str(k))
    time.sleep(1.2)
    run = lambda: script_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(60)
    run()
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list("01234")
    (tmp_path / "in" / "g").write_text("new")
    time.sleep(1.2)
    run()
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [*"01234", "new"]
