"""Every registered query against DuckDB over the same small tables."""

import datetime
import decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} | {"pipeline"}
NAMES = sorted(set(entry.queries()) - LLM)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if hasattr(value, "item") and getattr(value, "ndim", 0) == 0:
        value = value.item()
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    return str(value) if isinstance(value, (datetime.date, pd.Timestamp)) else value


def rows(frame: pd.DataFrame) -> list[str]:
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_as_in_sql(spark, duck, sf, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in entry.oracle_sql()])
def test_query_without_sql_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_of_queries_are_their_own():
    from lendmill.registry import query

    with pytest.raises(ValueError, match="two queries"):
        query("policy_bank_map")(len)
