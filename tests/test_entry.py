import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA, needs_data

#: Queries whose whole results are compared with SQL on the smallest tables.
COMPARED = ["p2_found", "p2_values", "p5_found", "p5_pending", "p5_runs", "exact_search", "prefix_search", "implements", "implementors", "trace_d2", "impact_d2", "top_by_refs", "importers", "graph_nodes", "changed_files", "text_search"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@needs_data
@pytest.mark.parametrize("name", COMPARED)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    answer = duck.execute(entry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(answer.description)}
    assert sorted(at) == columns
    assert mine == sorted(repr(tuple(r[at[c]] for c in columns)) for r in answer.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
