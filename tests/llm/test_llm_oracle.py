"""The training-data queries that SQL can express, against it, at the smallest scale."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from linkgrid.llm.oracle import SQL  # noqa: E402
from linkgrid.llm.queries import QUERIES  # noqa: E402
from tools.check_oracle import compare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tables, name):
    found = compare(QUERIES[name](spark, SF), tables, SQL[name])
    assert found.startswith("ok"), found


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
