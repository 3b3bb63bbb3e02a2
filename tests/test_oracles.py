"""Every registered query against its SQL, run by DuckDB over the same tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as contract  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or str(v) in ("nan", "<NA>", "NaT"):
        return "NULL"
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    if isinstance(v, str):
        return v
    f = float(v)
    return "NULL" if math.isnan(f) else repr(f)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(cell(v) for v in row) for row in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 1235
