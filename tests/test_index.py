import pytest
from pyspark.sql import functions as F

from symgraph.functions import names as N
from symgraph.operators import bundles, graph, lookup, search, structure, traverse
from symgraph.sources.index import Index

SYMBOL = "id long, file_id long, name string, kind string, language string, start_line int, end_line int, start_col int, end_col int, parent string, depth int, signature string"
REF = "id long, file_id long, line int, name string, language string, kind string"


def index(spark, files, symbols=(), refs=(), imports=()):
    """files: path; symbols: (file, name, kind, first, last[, parent, depth]); refs: (file, name, line[, kind]); imports: (file, path)."""
    paths = [f if isinstance(f, str) else f[0] for f in files]
    at = {p: k + 1 for k, p in enumerate(paths)}
    f = [(at[p], "r", "/repo/" + p, p, p.rsplit(".", 1)[-1], "", None, 1, 10) for p in paths]
    s = [(k, at[x[0]], x[1], x[2], "go", x[3], x[4], 0, 0, x[5] if len(x) > 5 else None, x[6] if len(x) > 6 else 0, None) for k, x in enumerate(symbols)]
    r = [(k, at[x[0]], x[2], x[1], "go", x[3] if len(x) > 3 else None) for k, x in enumerate(refs)]
    i = [(k, at[x[0]], x[1], "go") for k, x in enumerate(imports)]
    return Index.of(
        spark.createDataFrame(f, "file_id long, repo_id string, path string, rel_path string, language string, hash string, indexed_at timestamp, mtime_ns long, size long"),
        spark.createDataFrame(s * 2, SYMBOL), spark.createDataFrame(r * 2, REF), spark.createDataFrame(i * 2, "id long, file_id long, raw_path string, language string"),
    )


@pytest.fixture(scope="module")
def small(spark):
    symbols = [
        ("main.go", "main", "function", 1, 5), ("main.go", "HandleRequest", "function", 7, 20), ("main.go", "Server", "struct", 22, 30), ("main.go", "Config", "struct", 32, 40),
        ("app.py", "Application", "class", 1, 50), ("app.py", "handle_request", "function", 10, 20), ("app.py", "Config", "class", 52, 70),
    ]
    return index(spark, ["main.go", "app.py"], symbols, [("main.go", "Println", 10), ("main.go", "ListenAndServe", 15)], [("main.go", "fmt"), ("main.go", "net/http")])


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_search_modes(small):
    assert names(search.exact_search(small, ["HandleRequest"])) == ["HandleRequest"]
    assert names(search.exact_search(small, ["handlerequest"])) == []
    for q in ("handlerequest", "HANDLEREQUEST"):
        assert names(search.exact_search(small, [q], ignore_case=True)) == ["HandleRequest"]
    assert len(names(search.exact_search(small, ["Config"]))) == 2
    assert names(search.exact_search(small, ["Config"], kind="struct"), "rel_path") == ["main.go"]
    assert set(names(search.prefix_search(small, "Handle"))) == {"HandleRequest", "handle_request"}
    assert names(search.prefix_search(small, "handle_req")) == ["handle_request"]
    assert set(names(search.prefix_search(small, "function"))) == {"main", "HandleRequest", "handle_request"}
    assert names(search.prefix_search(small, "-.*\"")) == []
    assert names(search.flex_search(small, "SERVER")) == ["Server"] and set(names(search.flex_search(small, "Appl"))) == {"Application"}
    assert len(search.multi_search(small, ["Config", "main", "Config"]).collect()) == 3


def test_outline_and_references(small):
    assert names(lookup.outline(small, "main.go")) == ["main", "HandleRequest", "Server", "Config"]
    assert len(lookup.file_imports(small, "main.go").collect()) == 2
    assert [(r.line, r.kind) for r in lookup.references(small, ["Println"]).collect()] == [(10, "use")]


def test_children_by_file(spark):
    idx = index(spark, ["T.java", "T.kt"], [("T.java", "Tables", "class", 1, 20), ("T.java", "USERS", "field", 3, 3, "Tables", 1), ("T.java", "ORDERS", "field", 4, 4, "Tables", 1), ("T.kt", "Tables", "object", 1, 10), ("T.kt", "users", "field", 3, 3, "Tables", 1)])
    assert len(names(lookup.children(idx, "Tables"))) == 3
    assert len(names(lookup.children(idx, "Tables", rel_path="T.java"))) == 2


def test_conformance(spark):
    idx = index(
        spark, ["N.swift", "T.swift", "S.swift", "f.rs"],
        [("N.swift", "Named", "protocol", 1, 3), ("T.swift", "TimerIntent", "class", 1, 10), ("T.swift", "NamedTimer", "class", 12, 20), ("S.swift", "Session", "class", 1, 100), ("S.swift", "RequestConvertible", "struct", 50, 60), ("f.rs", "Frame", "struct", 1, 5), ("f.rs", "Frame", "impl", 10, 12)],
        [("T.swift", "LiveActivityIntent", 1, "implements"), ("T.swift", "Named", 12, "implements"), ("T.swift", "LiveActivityIntent", 5, "use"), ("S.swift", "Sendable", 1, "implements"), ("S.swift", "URLRequestConvertible", 50, "implements"), ("f.rs", "Error", 10, "implements")],
    )
    one = lookup.implementors(idx, ["LiveActivityIntent"]).collect()
    assert [(r.implementer, r.resolved) for r in one] == [("TimerIntent", False)]
    assert [(r.implementer, r.resolved) for r in lookup.implementors(idx, ["Named"]).collect()] == [("NamedTimer", True)]
    assert names(lookup.implements(idx, ["Session"]), "target") == ["Sendable"]
    assert names(lookup.implements(idx, ["RequestConvertible"]), "target") == ["URLRequestConvertible"]
    assert names(lookup.implements(idx, ["Frame"]), "target") == ["Error"]
    assert names(lookup.implementors(idx, ["Error"]), "implementer") == ["Frame"]


@pytest.fixture(scope="module")
def calls(spark):
    return index(
        spark, ["app/main.go"], [("app/main.go", n, "function", a, b) for n, a, b in (("Entry", 1, 20), ("Helper", 21, 30), ("Leaf", 31, 40), ("Caller", 41, 50))],
        [("app/main.go", "Helper", 2, "call"), ("app/main.go", "Leaf", 22, "call"), ("app/main.go", "Entry", 42, "call"), ("app/main.go", "Printf", 3, "call"), ("app/main.go", "external", 3, "call")],
    )


def test_trace_and_impact(calls):
    assert {(r.caller, r.callee, r.depth) for r in traverse.trace(calls, ["Entry"], 3).collect()} == {("Entry", "Helper", 1), ("Entry", "external", 1), ("Helper", "Leaf", 2)}
    assert {(r.caller, r.depth) for r in traverse.impact(calls, ["Leaf"], 5).collect()} == {("Helper", 1), ("Entry", 2), ("Caller", 3)}
    shallow = {tuple(r) for r in traverse.impact(calls, ["Leaf"], 1).collect()}
    assert shallow <= {tuple(r) for r in traverse.impact(calls, ["Leaf"], 2).collect()}


def test_graphs(calls):
    down = graph.call_graph(calls, ["Entry"], 3)
    assert down.edges.count() == 2 and down.unresolved.count() == 1
    assert graph.call_graph(calls, ["Entry"], 2, "up").edges.count() == 1
    both = graph.call_graph(calls, ["Entry"], 3, "both")
    assert both.edges.count() == 3
    assert graph.call_graph(calls, ["Entry"], 3, exclude=["app/*"]).nodes.count() == 0
    with_ext = graph.call_graph(calls, ["Entry"], 3, scope=["app/*"], include_unresolved=True)
    assert with_ext.edges.filter("not resolved").count() == 1
    cut = graph.truncated(both, 2)
    assert {r.id for r in cut.nodes.collect()} > {"_truncated"} and cut.nodes.count() == 3
    assert cut.nodes.filter("root").count() == 1
    assert graph.render(down, "mermaid").startswith("flowchart LR\n  n") and "-->" in graph.render(down, "mermaid")
    assert "style=dashed" in graph.render(with_ext, "dot")
    assert graph.render(graph.call_graph(calls, ["none"]), "dot") == "digraph g { /* no edges */ }\n"
    assert graph.merged([down, both]).edges.count() == 3


def test_importers(spark):
    idx = index(spark, ["pkg/util.go", "a.go", "b.go", ".env"], [("pkg/util.go", "Do", "function", 1, 2)], [], [("a.go", "corp/pkg/UTIL"), ("b.go", "x/a"), (".env", "none")])
    got = {r.rel_path: (r.depth, r.parent) for r in traverse.importers(idx, ["Do"], depth=3).collect()}
    assert got["a.go"] == (1, "pkg/util.go") and got["b.go"][0] == 2
    assert {r.rel_path for r in traverse.importers(idx, paths=["pkg/util"]).collect()} == {"a.go"}
    made = graph.import_graph(traverse.importers(idx, ["Do"]))
    assert made.edges.count() == 1 and made.nodes.count() == 2


def test_structure(spark):
    symbols = [("src/main/x.go", "Run", "function", 1, 2), ("a.go", "main", "function", 1, 2), ("a.go", "T", "struct", 1, 9), ("b/c.go", "T", "struct", 1, 9)]
    idx = index(spark, ["src/main/x.go", "a.go", "b/c.go"], symbols, [("a.go", "T", 3)] + [("b/c.go", "T", 4)], [("a.go", "x.b.c"), ("src/main/x.go", "y.b.c.z")])
    s = structure.structure(idx)
    assert {r.name for r in s["entry_points"].collect()} == {"Run", "main"}
    assert {(r.rel_path, r.n_refs) for r in s["top_by_refs"].collect()} == {("a.go", 2), ("b/c.go", 2)}
    assert [(r.rel_path, r.n_files) for r in s["top_by_import_fan"].collect()] == [("b/c.go", 2)]
    assert {r.package for r in s["top_packages"].collect()} == {"src/main", ".", "b/c.go"}


def test_empty_index(spark):
    idx = index(spark, [])
    assert search.exact_search(idx, ["x"]).count() == 0 and traverse.trace(idx, ["x"], 2).count() == 0 and lookup.implements(idx, ["x"]).count() == 0
    assert structure.repo_stats(idx).count() == 0 and search.prefix_search(idx, "x").count() == 0


@pytest.mark.parametrize(
    "path, pattern, hit",
    [("internal/a/b.go", "internal/**", True), ("web/a/x.tsx", "**/*.tsx", True), ("x.tsx", "**/*.tsx", True), ("src/a/b/types.ts", "src/**/types.ts", True), ("src/a/b.ts", "src/*", False),
     ("src/a.ts", "src/*", True), ("cmd/search.go", "cmd/search", True), ("./cmd/x.go", "cmd/*.go", True), ("a/b", "", False), ("a/b", "a/[bc]", True)],
)
def test_globs(spark, path, pattern, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(N.path_matches(F.col("p"), [pattern]).alias("x")).first().x is hit


def test_score_ranks_the_plain_function_first(spark):
    rows = [("method", "internal/run_test.go"), ("class", "src/docs/run.go"), ("function", "cmd/run.go")]
    df = spark.createDataFrame(rows, "kind string, rel_path string").withColumn("score", N.symbol_score(F.col("kind"), F.col("rel_path")))
    assert df.orderBy(F.desc("score")).first().rel_path == "cmd/run.go"


def test_text_lines(spark):
    contents = spark.createDataFrame([(1, "a\r\nneedle\n\nx needle"), (2, ""), (3, None), (4, "needle\n")], "file_id long, content string")
    files = spark.createDataFrame([(k, "r", f"f{k}", "go") for k in (1, 2, 3, 4)], "file_id long, repo_id string, rel_path string, language string")
    assert [(r.rel_path, r.line, r.snippet) for r in search.text_search(files, contents, "needle").collect()] == [("f1", 2, "needle"), ("f1", 4, "x needle"), ("f4", 1, "needle")]
    assert search.text_search(files, contents, "needle", limit=2).count() == 2


def test_bundles(spark, calls):
    contents = spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(1, 51)))], "file_id long, content string")
    found = bundles.investigate(calls, contents, "Helper")
    assert set(found) == {"symbol", "source", "refs", "impact"} and found["source"].count() == 10
    assert bundles.context_of(calls, contents, "main.go:Entry")["callers"].count() == 1
    with pytest.raises(LookupError):
        bundles.investigate(calls, contents, "nothing_at_all")
    assert bundles.parse_range("a/b.go:L10-L20") == ("a/b.go", 10, 20) and bundles.parse_range("a/b.go") is None
    hits = calls.refs.filter("name = 'Helper'")
    assert bundles.with_context(hits, contents, 2).first().context == ["line 1", "line 2", "line 3", "line 4"]


def test_hunks(spark):
    text = ["--- a", "+++ b", "@@ -1,2 +1,3 @@", " x", "+y", "@@ -40 +41,0 @@", "-z", "@@ -90,2 +90,2 @@", " q"]
    diff = spark.createDataFrame([*enumerate(text)], "pos int, text string")
    assert [r.text for r in bundles.hunks_in(diff, 41, 50).collect()] == ["--- a", "+++ b", "@@ -40 +41,0 @@", "-z"]
    assert bundles.hunks_in(diff, 200, 300).count() == 0
