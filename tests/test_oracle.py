"""Every named query against its SQL at the smallest scale."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from linkgrid.checks import oracle  # noqa: E402
from tools.check_oracle import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
SLOW = {"model_report", "quantile_forecast", "model_dish_verdicts"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.QUERIES) - set(oracle.all_sql()) == SLOW


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracle.all_sql()))
def test_query_matches_sql(spark, tables, name):
    found = compare(entry.queries()[name](spark, SF), tables, entry.oracle_sql()[name])
    assert found.startswith("ok"), found
