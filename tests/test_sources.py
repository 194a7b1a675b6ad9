import json
import os

from pyspark.sql import functions as F

from symgraph.sources import extract, render, walk
from symgraph.sources.index import Index
from symgraph.sources.languages import language, registry
from symgraph.streaming import refresh

GO = 'package main\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\n\ntype Runner interface {\n\tRun() error\n}\n\ntype Worker struct {\n\tName string\n}\n\nfunc (w *Worker) Run() error {\n\tfmt.Println("helper()") // helper()\n\treturn helper()\n}\n\nfunc helper() error {\n\tw := Worker{Name: "x"}\n\treturn w.Run()\n}\n'


def rows(text, lang, tag):
    return [(r.name, r.kind) for r in extract.extract(text, lang) if r.tag == tag]


def test_go():
    assert rows(GO, "go", "symbol") == [("Runner", "interface"), ("Worker", "struct"), ("Run", "method"), ("helper", "function")]
    assert [n for n, _ in rows(GO, "go", "import")] == ["fmt", "net/http"]
    assert rows(GO, "go", "ref") == [("Println", "call"), ("helper", "call"), ("Worker", "use"), ("Run", "call")]


def test_python():
    text = "import os\nfrom a.b import c\n\nclass A(Base, m.Mixin):\n    @deco\n    def f(self, x=1) -> int:\n        return c(x)\n"
    got = [r for r in extract.extract(text, "python") if r.tag == "symbol"]
    assert [(r.name, r.kind, r.start_line, r.end_line, r.parent, r.depth) for r in got] == [("A", "class", 4, 7, "", 0), ("f", "function", 5, 7, "A", 1)]
    assert got[1].signature == "(self, x=1) -> int"
    assert rows(text, "python", "ref") == [("Base", "implements"), ("Mixin", "implements"), ("c", "call")]
    assert [r.tag for r in extract.extract("def (", "python")] == ["error"]


def test_other_languages():
    assert rows("pub struct F { a: u8 }\nimpl Error for F {\n  fn d(&self) -> u8 { a::b::c(1) }\n}\n", "rust", "ref") == [("Error", "implements"), ("a::b::c", "call")]
    java = "import java.util.List;\npublic class S extends B implements R, C {\n  private int n = 0;\n  public S(int n) { this.n = n; }\n  public void run(List<String> xs) {\n    helper(xs);\n  }\n}\n"
    assert rows(java, "java", "symbol") == [("S", "class"), ("n", "field"), ("S", "constructor"), ("run", "method")]
    assert rows(java, "java", "ref") == [("B", "implements"), ("R", "implements"), ("C", "implements"), ("helper", "call")]
    assert rows('resource "aws" "b" {\n}\n', "hcl", "symbol") == [("aws.b", "resource")]
    assert rows("class A < B\n  def run(x)\n    go(x)\n  end\nend\n", "ruby", "symbol") == [("A", "class"), ("run", "method")]
    assert rows("#include <stdio.h>\nstatic int add(int a)\n{\n  return f(a);\n}\n", "c", "symbol") == [("add", "function")]
    assert list(extract.extract("anything", "zig")) == [] and list(extract.extract("", "go")) == []


def test_walk_index_refresh(spark, tmp_path):
    for path, text in {"src/main.go": GO, "node_modules/x.js": "f()", ".hidden/y.go": "package y", "a_generated.go": "package a", "notes.xyz": "", "Makefile": "all:"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    os.symlink(tmp_path / "src/main.go", tmp_path / "link.go")
    files = walk.listing(spark, str(tmp_path))
    assert [r.rel_path for r in files.collect()] == ["Makefile", "a_generated.go", "src/main.go"]
    kept = files.filter(~walk.excluded())
    assert {r.rel_path for r in kept.collect()} == {"Makefile", "src/main.go"}
    read = walk.with_content(spark, kept).withColumn("file_id", F.xxhash64("rel_path"))
    symbols, refs, imports = extract.tables(extract.parsed(read))
    stamped = read.withColumns({"hash": F.lit(""), "indexed_at": F.current_timestamp()})
    idx = Index.of(stamped, symbols, refs, imports)
    assert {r.name for r in idx.symbols.collect()} == {"Runner", "Worker", "Run", "helper"}
    idx.save(f"{tmp_path}/index")
    again = Index.read(spark, f"{tmp_path}/index")
    assert again.refs.count() == 4 and again.imports.count() == 2
    assert refresh.changed_files(kept, again.files).count() == 0 and refresh.changed_files(kept, again.files, force=True).count() == 2
    (tmp_path / "src/main.go").write_text(GO + "\nfunc more() {}\n")
    (tmp_path / "Makefile").unlink()
    now = walk.listing(spark, str(tmp_path)).filter(~walk.excluded())
    assert [r.rel_path for r in refresh.changed_files(now, again.files).collect()] == ["src/main.go"]
    assert [r.rel_path for r in refresh.stale_files(now, again.files).collect()] == ["Makefile"]
    assert walk.render_tree(walk.tree(now)) == "└── src/\n    └── main.go\n"


def test_merged_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "file_id long, name string")
    new, gone = spark.createDataFrame([(1, "x")], old.schema), spark.createDataFrame([(3,)], "file_id long")
    assert sorted(tuple(r) for r in refresh.merged_rows(old, new, gone).collect()) == [(1, "x"), (2, "b")]


def test_stream(spark, tmp_path):
    schema = "entry_id long, repo_id string, rel_path string, mtime_ns long, size long, hash string, seen_at timestamp"
    rows = [(1, "r", "./a", 1, 1, "x", None), (2, "r", "a", 2, 1, "y", None), (3, "r", "b", 1, 1, "z", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        refresh.follow(source, f"{tmp_path}/ck", lambda batch, n: seen.extend(r.entry_id for r in batch.collect())).awaitTermination()
    assert sorted(seen) == [2, 3]


def test_languages(spark):
    df = spark.createDataFrame([("a/x.go",), ("a/Makefile",), ("a/x.GO",), ("a.b/c",)], "p string")
    assert [r.l for r in df.select(language(F.col("p")).alias("l")).collect()] == ["go", "make", None, None]
    assert registry(spark).filter("parseable").select("language").distinct().count() == 21


def test_render(spark):
    assert render.front_matter([("a", "x: y"), ("b", "plain"), ("c", "")], "body") == '---\na: "x: y"\nb: plain\nc: ""\n---\nbody\n'
    assert json.loads(render.envelope(spark.createDataFrame([(1,)], "x int"))) == {"version": "0.1", "results": [{"x": 1}]}
    assert render.human_size(512) == "512 B" and render.human_size(1536) == "1.5 KB"


def test_damaged_kotlin():
    text = '@Tag("x") class Box<T : Any>(val a: Map<String, Int> = mapOf("k" to 1)) : Base<T>(a), Named where T : X {\n  fun run() { open(\n}\n}\nenum class Way { A }\nsealed interface Far : Near\n'
    symbols, refs = rows(text, "kotlin", "symbol"), rows(text, "kotlin", "ref")
    assert {("Box", "class"), ("Way", "enum"), ("Far", "interface")} <= set(symbols)
    assert {("Base", "implements"), ("Named", "implements"), ("Near", "implements")} <= set(refs)
    whole = "class A : B(), C {\n  fun f() { g() }\n}\n"
    assert rows(whole, "kotlin", "symbol") == [("A", "class"), ("f", "function")] and [r for r in rows(whole, "kotlin", "ref") if r[1] == "implements"] == [("B", "implements"), ("C", "implements")]
