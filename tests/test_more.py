import subprocess

import pytest
from pyspark.sql import functions as F

from symgraph.functions import names as N
from symgraph.operators import bundles, graph, lookup, search, traverse
from symgraph.sources import render, walk
from tests.test_index import index


@pytest.fixture(scope="module")
def idx(spark):
    symbols = [
        ("a.go", "HandleRequest", "function", 1, 9), ("a.go", "Leaf", "function", 10, 19), ("b.go", "Request", "struct", 1, 9), ("b.go", "Épée", "function", 20, 29), ("b.go", "Far", "function", 30, 39), ("a.go", "Leaf", "function", 20, 29),
    ]
    refs = [("a.go", "Leaf", 2, "call"), ("a.go", "Far", 3, "call"), ("a.go", "Other", 12, "call"), ("b.go", "Base", 2, "implements"), ("b.go", "Request", 21, "implements")]
    return index(spark, ["a.go", "b.go"], symbols, refs)


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_words_that_must_all_match(idx):
    assert names(search.prefix_search(idx, "function handle")) == ["HandleRequest"]
    assert names(search.prefix_search(idx, "struct handle")) == [] and names(search.prefix_search(idx, "request stru")) == ["Request"]
    assert names(search.prefix_search(idx, "epee")) == ["Épée"] and names(search.prefix_search(idx, "ÉPÉE")) == ["Épée"]
    assert search.query_phrases('a_b  c. "') == [["a", "b"], ["c"]]


def test_order_of_discovery(idx):
    rows = [(r.caller, r.callee, r.depth) for r in traverse.trace(idx, ["HandleRequest"], 3, limit=2).collect()]
    assert rows == [("HandleRequest", "Leaf", 1), ("HandleRequest", "Far", 1)]
    assert [(r.caller, r.depth) for r in traverse.impact(idx, ["Other"], 3, limit=1).collect()] == [("Leaf", 1)]


def test_filters_of_results(idx):
    found = lookup.implementors(idx, ["Base", "Request"])
    assert names(lookup.narrowed(found, resolved=False), "target") == ["Base"] and names(lookup.narrowed(found, resolved=True), "target") == ["Request"]
    assert lookup.narrowed(found, language="java").count() == 0 and lookup.narrowed(found, exclude=["b.go"]).count() == 0 and lookup.narrowed(found, limit=1).count() == 1
    assert names(lookup.outline_names(idx, "a.go")) == ["HandleRequest", "Leaf"]


def test_names_and_forms():
    assert search.listed(["b", " a ", "b"], "# no\n\na\nc\n") == ["b", "a", "c"]
    assert [graph.form_of("dot", True), graph.form_of("", True, True), graph.form_of(terminal=True), graph.form_of()] == ["dot", "json", "mermaid", "json"]
    with pytest.raises(ValueError):
        graph.form_of("svg")


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1), ("b", 4, 2)], "query string, item long, rank int")
    expected = spark.createDataFrame([("a", 1), ("a", 1), ("b", 4), ("c", 9)], "query string, item long")
    assert tuple(search.ranking_metrics(ranked, expected).first()) == (3, 0.5, pytest.approx(1 / 3), 1.5)
    assert tuple(search.ranking_metrics(ranked, expected.limit(0)).first()) == (0, None, None, None)


def test_looks_like_code(spark):
    rows = spark.createDataFrame([("ab",), ("abc",), ("*.go",), ("123",), ("(.*)a",), ("f(x)",), (None,)], "q string")
    assert [r[0] for r in rows.select(N.looks_like_code(F.col("q"))).collect()] == [False, True, False, False, False, True, False]


def test_diff_of_a_symbol(spark, idx, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    lines = [f"line {k}" for k in range(1, 60)]
    (tmp_path / "a.go").write_text("\n".join(lines) + "\n")
    git("init", "-q"), git("add", "."), git("commit", "-qm", "x")
    lines[2], lines[40] = "changed", "changed too"
    (tmp_path / "a.go").write_text("\n".join(lines) + "\n")
    diff = walk.git_diff(spark, str(tmp_path), "a.go")
    mine = bundles.diff_of(idx, diff, "HandleRequest")
    assert "+changed" in names(mine, "text") and "+changed too" not in names(mine, "text")
    assert tuple(bundles.diff_stat(mine).first()) == (1, 1) and tuple(bundles.diff_stat(diff).first()) == (2, 2)
    with pytest.raises(bundles.Ambiguous):
        bundles.diff_of(idx, diff, "Leaf")


def test_envelope_says_that_there_is_more(spark, tmp_path):
    rows = spark.range(5)
    assert '"more": true' in render.envelope(rows, 4) and "more" not in render.envelope(rows, 5)
    render.write_json(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 5


def test_conditions_reach_the_stored_table(spark, idx, tmp_path):
    plan = lookup.references(idx, ["Leaf"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") > plan.index("Aggregate")  # below the removal of repeats
    assert names(idx.pick("refs", "kind", [""]), "name") == [] and len(names(idx.pick("symbols", "parent", [""]), "name")) == 6


def test_like_join_by_the_rarest_piece(spark):
    texts = spark.createDataFrame([("r", f"corp.core.pkg{k}.x") for k in range(30)] + [("r", "A%B"), ("r", "ab"), ("q", "corp.core.pkg1.x")], "repo_id string, raw string")
    patterns = spark.createDataFrame([("r", "core.pkg1.", 0), ("r", "absent", 1), ("r", "b", 2), ("r", "_", 3), ("r", "", 4), ("r", "a%b", 5), ("r", "CORE.pkg_.x", 6)], "repo_id string, p string, n int")
    got = {}
    for r in traverse.like_join(texts, "raw", patterns, "p").collect():
        got.setdefault(r.n, set()).add((r.repo_id, r.raw))
    assert got[0] == {("r", "corp.core.pkg1.x")} and 1 not in got and 4 not in got
    assert got[2] == {("r", "A%B"), ("r", "ab")} and len(got[3]) == 32 and got[5] == {("r", "A%B"), ("r", "ab")} and len(got[6]) == 10
