import random
from collections import Counter

import pyarrow as pa

from symgraph.llm.frequent import frequent_values, shrink

SCHEMA = "name string, key string, est long, n_rows long, part int"


def frame(spark, values, parts=5):
    return spark.createDataFrame([(v, "k", 1, 1, 1) for v in values], SCHEMA).repartition(parts)


def test_equals_counts(spark):
    rng = random.Random(5)
    values = [f"v{k}" for k in range(3000)] + ["hot"] * 900 + ["edge"] * 42 + ["under"] * 41 + [None] * 120 + [""] * 100 + ["hot "] * 60 + ["y" * 9000] * 60
    rng.shuffle(values)
    n = len(values)
    share = 42 / n
    got = {r.val: r.n_rows for r in frequent_values(frame(spark, values), "name", share, counters=400).collect()}
    want = {v: c for v, c in Counter(values).items() if v and c >= share * n}
    assert got == want and "edge" in got and "under" not in got


def test_ties_empty_and_all_null(spark):
    assert frequent_values(frame(spark, []), "name").count() == 0
    assert frequent_values(frame(spark, [None, "", None]), "name").count() == 0
    assert {r.val for r in frequent_values(frame(spark, ["a", "b"] * 10), "name", 0.5, 100).collect()} == {"a", "b"}


def test_summary_error_is_bounded():
    rng = random.Random(1)
    counts = Counter()
    table = pa.table({"key": pa.array([], pa.string()), "est": pa.array([], pa.int64())})
    k = 20
    for _ in range(30):
        block = [f"x{int(rng.paretovariate(0.7))}" for _ in range(200)]
        counts.update(block)
        c = Counter(block)
        table = shrink(pa.concat_tables([table, pa.table({"key": list(c), "est": list(c.values())})]), k)
        assert len(table) <= k
    kept = dict(zip(table["key"].to_pylist(), table["est"].to_pylist(), strict=True))
    n = sum(counts.values())
    for v, c in counts.items():
        assert c - n / (k + 1) <= kept.get(v, 0) <= c
