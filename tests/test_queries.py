"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from quern.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def shown(v):
    return "\0" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_asof_buckets_change_nothing(spark):
    from pyspark.sql import functions as F

    from quern.operators import asof

    events = spark.read.parquet(f"{DATA}/events.parquet")
    a = asof.last_definition(events.where("event_type='click'"), events.where("event_type='purchase'").select("event_id", "user_id", "ts"), ["user_id"], ["ts"], "event_id")
    b = asof.last_definition(events.where("event_type='click'"), events.where("event_type='purchase'").select("event_id", "user_id", "ts"), ["user_id"], ["ts"], "event_id", F.date_trunc("hour", "ts"))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
