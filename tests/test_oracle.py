"""Every query of the plans against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillspan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


def shown(value) -> str:
    if value is None or str(value) in ("NaT", "<NA>") or value != value:
        return "null"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else str(round(value, 6))
    return str(value)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if Path(path).is_file() else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, con):
    got, want = registry.queries()[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(shown(v) for v in row) for row in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
