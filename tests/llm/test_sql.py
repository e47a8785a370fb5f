"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from quern.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    shown = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted([shown(r[c]) for c in columns] for r in df.collect()) == sorted([shown(r[names.index(c)]) for c in columns] for r in found.fetchall())
