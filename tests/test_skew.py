from collections import Counter, defaultdict

from pyspark.sql import functions as F

from symgraph.operators.skew import imbalance, per_value

SCHEMA = "name string, file_id long, val int, _n int"


def brute(rows):
    n, members = Counter(), defaultdict(set)
    for r in rows:
        n[r[0]] += 1
        if r[1] is not None:
            members[r[0]].add(r[1])
    return {k: (n[k], len(members[k])) for k in n}


def test_counts_with_nulls_repeats_hot_key_and_clashing_columns(spark):
    rows = [("hot", k % 7, 1, 2) for k in range(400)] + [(f"v{k}", k, 1, 2) for k in range(100)] * 2 + [(None, 1, 0, 0), ("", 2, 0, 0), ("hot", None, 0, 0), ("x" * 50_000, 1, 0, 0)]
    got = {r.val: (r.n_rows, r.n_members) for r in per_value(spark.createDataFrame(rows, SCHEMA), "name", "file_id").collect()}
    assert got == brute(rows)


def test_hot_values_are_named(spark):
    rows = [("a", 1, 0, 0)] * 50 + [(None, 1, 0, 0)] * 30 + [("", 1, 0, 0)] * 19 + [("b", 1, 0, 0)]
    out = {r.val: r.hot for r in imbalance(spark.createDataFrame(rows, SCHEMA), "name", "file_id", 0.02).collect()}
    assert out == {"a": True, None: False, "": False, "b": False}


def test_empty(spark):
    assert imbalance(spark.createDataFrame([], SCHEMA), "name", "file_id").count() == 0


def test_no_window_and_partial_aggregation(spark):
    plan = per_value(spark.createDataFrame([("a", 1, 0, 0)], SCHEMA), "name", "file_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_") >= 2 and "Window" not in plan and F is not None
