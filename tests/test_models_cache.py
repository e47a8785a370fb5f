"""Requests under way together, answers that outlive their task, and a cache with several writers."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import sequences, values
from quern.plans import models
from quern.plans.cache import Cache


def requests(spark, n):
    return spark.range(n).select(F.concat(F.lit("r"), "id").alias("request_id"), F.concat(F.lit("q"), "id").alias("request")).coalesce(1)


def test_requests_under_way_together(spark):
    def slow(text):
        time.sleep(0.2)
        return json.dumps(text.split("Input:\n")[1].split("\n")[0])

    began = time.monotonic()
    rows = models.ask(requests(spark, 100), slow, lambda q, a: []).collect()
    took = time.monotonic() - began
    assert [r.answer for r in rows] == [f'"q{k}"' for k in range(100)] and took < 12  # one after the other: 20 s and more


def test_pace():
    pace, at = models.Pace(50), []
    threads = [threading.Thread(target=lambda: (pace.wait(), at.append(time.monotonic()))) for _ in range(11)]
    began = time.monotonic()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert time.monotonic() - began >= 0.19 and len(at) == 11


def test_a_killed_task_repeats_no_answered_request(spark, tmp_path):
    log, ledger = tmp_path / "asked", models.Ledger(f"file://{tmp_path}/ledger")

    def provider(deadly):
        def f(text):
            own = text.split("Input:\n")[1].split("\n")[0]
            if deadly and own == "q17":
                time.sleep(1)
                raise SystemExit("killed")
            with open(log, "a") as out:
                out.write(own + "\n")
            return "[]" if own != "q5" else "no JSON"

        return f

    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a dead task
        models.ask(requests(spark, 30), provider(True), lambda q, a: [], retries=2, ledger=ledger).collect()
    first = log.read_text().split()
    rows = models.ask(requests(spark, 30), provider(False), lambda q, a: [], retries=2, ledger=ledger).collect()
    again = log.read_text().split()[len(first) :]
    assert len(rows) == 30 and set(first) & set(again) <= {"q5"} and {r.request_id for r in rows if r.error} == {"r5"}
    assert sorted({*first, *again}) == sorted(f"q{k}" for k in range(30))


def test_two_writers_one_row_a_key(spark, tmp_path):
    kept = Cache(spark, f"file://{tmp_path}/cache", "size bigint, by string")
    rows = lambda by: spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("size"), F.lit(by).alias("by"))
    writers = [threading.Thread(target=kept.write, args=(rows(by),)) for by in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert kept.read().count() == 500 == kept.read().select("key").distinct().count()
    kept.write(rows("last").where("size < 10"))
    assert {r.by for r in kept.read().where("size < 10").collect()} == {"last"}
    some = rows("x").where("size < 3").select("key")
    found = kept.read(some)
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan.replace("isnotnull(part", "part") or "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_edges_of_candidates_chunks_and_errors(spark):
    rows = [(1, "10"), (1, "9"), (1, "0" * 50 + "7"), (1, "7"), (1, "1" * 40), (1, None), (None, "b"), (None, "a"), (2, None), (3, "1"), (3, "x")]
    got = {r.k: (r.numeric, r.candidates) for r in values.candidates(spark.createDataFrame(rows, "k int, v string"), ["k"], "v").collect()}
    assert got == {1: (True, ["7", "9", "10", "1" * 40]), None: (False, ["a", "b"]), 3: (False, ["1", "x"])}
    chunks = spark.createDataFrame([(1, 0, ["a"], None), (1, 1, None, ["a"]), (1, 2, None, None)], "k int, t int, d array<string>, u array<string>")
    assert [(r.t, r.chunk) for r in sequences.look_ahead_chunks(chunks, ["k"], ["t"], "d", "u").orderBy("t").collect()] == [(0, 0), (1, 0), (2, 1)]
    made = spark.createDataFrame([(1, "f", None, ["a"], None, None), (2, "f", "fn f a", None, None, ["fn"]), (3, None, "x", ["x"], ["y"], None)], "chunk int, name string, source string, snippets array<string>, placeholders array<string>, banned array<string>")
    assert sorted((r.chunk, r.error) for r in models.translation_errors(made).collect()) == [(1, "no translation"), (2, "banned: fn"), (3, "missing placeholder: y")]
