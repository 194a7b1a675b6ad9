"""Queries over the index, one for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import names as N
from symgraph.operators import bundles, graph, lookup, search, structure, traverse
from symgraph.session import load
from symgraph.sources.index import Index
from symgraph.sources.languages import BY_NAME, EXTENSIONS, language
from symgraph.sources import extract
from symgraph.streaming import refresh

SYMBOLS, USED = ["New", "load"], ["loadDocket", "Parcel"]
ROOTS = ["New", "Config", "ReplayShuttle", "ReplayCargo", "flushSignal", "flushCistern"]
TARGETS = ["append", "Get"]
TYPES = ["New", "load", "Config"]

QUERIES: dict = {}
SQL: dict[str, str] = {}

_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)

#: The index in SQL.
_INDEX = """
f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC) = 1),
s AS (SELECT DISTINCT s.id, s.file_id, coalesce(s.name, '') AS name, coalesce(s.kind, '') AS kind, s.language, s.start_line, s.end_line,
        coalesce(s.parent, '') AS parent, s.depth, coalesce(s.signature, '') AS signature, f.repo_id, f.rel_path
      FROM symbols s JOIN f USING (file_id)),
r AS (SELECT DISTINCT r.id, r.file_id, r.line, coalesce(r.name, '') AS name, r.language,
        CASE WHEN coalesce(r.kind, '') = '' THEN 'use' ELSE r.kind END AS kind, f.repo_id, f.rel_path
      FROM refs r JOIN f USING (file_id)),
i AS (SELECT DISTINCT i.id, i.file_id, coalesce(i.raw_path, '') AS raw_path, f.repo_id, f.rel_path FROM imports i JOIN f USING (file_id))"""


def _score_sql() -> str:
    p = "lower(rel_path)"
    terms = [f"CASE WHEN kind IN ({_quoted(kinds)}) THEN {v} ELSE 0 END" for v, kinds in N.KIND_SCORES.items()]
    for v, parts in N.PATH_SCORES:
        terms.append(f"CASE WHEN {' OR '.join(f'contains({p}, {chr(39)}{x}{chr(39)})' for x in parts)} THEN {v} ELSE 0 END")
    platform = [f"contains({p}, '/{x}') OR starts_with({p}, '{x}')" for x in N.PLATFORM_FOLDERS]
    terms.append(f"CASE WHEN {' OR '.join(platform)} THEN -50 ELSE 0 END")
    ends = [f"ends_with({p}, '{x}') OR contains({p}, '{x}/')" for x in N.GENERATED_ENDS]
    terms.append(f"CASE WHEN {' OR '.join(ends)} THEN -70 ELSE 0 END")
    return "CAST(" + " + ".join(terms) + " - 3 * (length(rel_path) - length(replace(rel_path, '/', ''))) - strlen(rel_path) // 10 AS INTEGER)"


_SCORE = _score_sql()
_PACKAGE = "CASE WHEN instr(rel_path, '/') = 0 THEN '.' ELSE array_to_string(string_split(rel_path, '/')[1:2], '/') END"
_ORDER = "score DESC, name, repo_id, rel_path, start_line, id"


def query(name: str, sql: str = ""):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = "WITH " + _INDEX + sql
        return f

    return keep


# Search
_FOUND = "id, name, kind, repo_id, rel_path, start_line, end_line, parent, depth, signature, language"


@query("exact_search", f" SELECT {_FOUND}, score FROM (SELECT *, {_SCORE} AS score FROM s WHERE name IN ({_quoted(SYMBOLS)})) ORDER BY {_ORDER} LIMIT 50")
def exact_search(spark: SparkSession, base: str) -> DataFrame:
    return search.exact_search(Index.load(spark, base), SYMBOLS, limit=50)


@query("exact_search_filtered", f" SELECT {_FOUND}, score FROM (SELECT *, {_SCORE} AS score FROM s WHERE name = 'load' AND kind = 'function' AND language = 'go') ORDER BY {_ORDER} LIMIT 20")
def exact_search_filtered(spark: SparkSession, base: str) -> DataFrame:
    return search.exact_search(Index.load(spark, base), ["load"], "function", "go")


@query("exact_search_ci", f" SELECT {_FOUND}, score FROM (SELECT *, {_SCORE} AS score FROM s WHERE lower(name) = 'replayweft') ORDER BY {_ORDER} LIMIT 50")
def exact_search_ci(spark: SparkSession, base: str) -> DataFrame:
    return search.exact_search(Index.load(spark, base), ["replayWeft"], ignore_case=True, limit=50)


@query("symbol_score", f" SELECT id, {_SCORE} AS score FROM s")
def symbol_score(spark: SparkSession, base: str) -> DataFrame:
    return search.scored(Index.load(spark, base).symbols).select("id", "score")


_PREFIX = f""",
t AS (SELECT *, [x FOR x IN string_split_regex(lower(name || ' ' || kind), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS t FROM s),
c AS (SELECT *, len([x FOR x IN t IF starts_with(x, 'replay')]) AS n FROM t),
st AS (SELECT count(*) AS total, avg(len(t)) AS mean, count(*) FILTER (WHERE n > 0) AS hits FROM c),
q AS (SELECT c.*, {_SCORE} AS score,
        CASE WHEN lower(name) = 'replay' THEN 0 WHEN starts_with(lower(name), 'replay') THEN 1 ELSE 2 END AS tier,
        round(greatest(ln((total - hits + 0.5) / (hits + 0.5)), 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / mean)), 6) AS rank
      FROM c, st WHERE n > 0)
SELECT {_FOUND}, score, tier, rank FROM q ORDER BY tier, score DESC, rank DESC, name, repo_id, rel_path, start_line, id LIMIT 100"""


@query("prefix_search", _PREFIX)
def prefix_search(spark: SparkSession, base: str) -> DataFrame:
    return search.prefix_search(Index.load(spark, base), "replay", limit=100)


@query("flex_search", f" SELECT {_FOUND}, score FROM (SELECT *, {_SCORE} AS score FROM s WHERE lower(name) = 'config') ORDER BY {_ORDER} LIMIT 20")
def flex_search(spark: SparkSession, base: str) -> DataFrame:
    return search.flex_search(Index.load(spark, base), "config")


_MULTI = f""",
q AS (SELECT *, {_SCORE} AS score, CASE name WHEN 'New' THEN 0 ELSE 1 END AS query_no,
        rel_path || ':' || language || ':' || kind || ':' || name || ':' || start_line AS symbol_id FROM s WHERE name IN ({_quoted(SYMBOLS)})),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {_ORDER}) AS rank FROM q)
SELECT query_no, CAST(rank AS INTEGER) AS rank, symbol_id, name, kind, repo_id, rel_path, start_line, end_line, parent, depth, signature, language, score
FROM k WHERE rank <= 30 QUALIFY row_number() OVER (PARTITION BY repo_id, symbol_id ORDER BY query_no, rank) = 1"""


@query("multi_search", _MULTI)
def multi_search(spark: SparkSession, base: str) -> DataFrame:
    return search.multi_search(Index.load(spark, base), SYMBOLS, 30)


_LINES = """,
p AS (SELECT file_id, content AS text, string_split(content, chr(10)) AS pieces FROM file_contents WHERE content IS NOT NULL),
u AS (SELECT file_id, unnest(pieces) AS content, unnest(range(1, len(pieces) + 1)) AS line, len(pieces) AS n FROM p),
l AS (SELECT file_id, CAST(line AS INTEGER) AS line, regexp_replace(content, '\\r$', '') AS content FROM u WHERE content <> '' OR line < n)"""


@query("text_search", _LINES + " SELECT repo_id, rel_path, line, left(content, 200) AS snippet FROM l JOIN f USING (file_id) WHERE contains(content, 'ledger.') ORDER BY repo_id, rel_path, line LIMIT 200")
def text_search(spark: SparkSession, base: str) -> DataFrame:
    return search.text_search(Index.load(spark, base).files, load(spark, base, "file_contents"), "ledger.", limit=200)


@query("text_search_regex", _LINES + " SELECT repo_id, rel_path, line, left(content, 200) AS snippet FROM l JOIN f USING (file_id) WHERE regexp_matches(content, 'fn [a-z_]+_ledger')")
def text_search_regex(spark: SparkSession, base: str) -> DataFrame:
    return search.text_search(Index.load(spark, base).files, load(spark, base, "file_contents"), "fn [a-z_]+_ledger", limit=None, regex=True)


@query("line_counts", _LINES + " SELECT file_id, count(*) AS n_lines, max(length(content)) AS longest FROM l GROUP BY file_id")
def line_counts(spark: SparkSession, base: str) -> DataFrame:
    lines = search.lines_of(load(spark, base, "file_contents"))
    return lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("content")).cast("long").alias("longest"))


# Lookups
@query("file_outline", ", a AS (SELECT min(rel_path) AS p FROM s) SELECT id, name, kind, repo_id, rel_path, start_line, end_line, parent, depth, signature, language FROM s WHERE rel_path = (SELECT p FROM a)")
def file_outline(spark: SparkSession, base: str) -> DataFrame:
    idx = Index.load(spark, base)
    return lookup.outline(idx, idx.symbols.agg(F.min("rel_path")).first()[0] or "")


@query("child_symbols", f" SELECT {_FOUND} FROM s WHERE parent = (SELECT min(parent) FROM s WHERE parent <> '') ORDER BY repo_id, rel_path, start_line, id LIMIT 50")
def child_symbols(spark: SparkSession, base: str) -> DataFrame:
    idx = Index.load(spark, base)
    return lookup.children(idx, idx.symbols.filter("parent <> ''").agg(F.min("parent")).first()[0] or "?")


@query("find_references", f" SELECT id, name, kind, repo_id, rel_path, line FROM r WHERE name IN ({_quoted(USED)})")
def find_references(spark: SparkSession, base: str) -> DataFrame:
    return lookup.references(Index.load(spark, base), USED)


@query("find_references_kinds", f" SELECT id, name, kind, repo_id, rel_path, line FROM r WHERE name IN ({_quoted(USED)}) AND kind IN ('call', 'implements') ORDER BY repo_id, rel_path, line, id LIMIT 40")
def find_references_kinds(spark: SparkSession, base: str) -> DataFrame:
    return lookup.references(Index.load(spark, base), USED, ["call", "implements"], 40)


@query("file_list", " SELECT file_id, repo_id, rel_path, language, size FROM f WHERE lower(trim(language)) = 'go'")
def file_list(spark: SparkSession, base: str) -> DataFrame:
    return lookup.file_list(Index.load(spark, base), "go")


@query("file_imports", " SELECT id, repo_id, raw_path FROM i WHERE rel_path = (SELECT min(rel_path) FROM i)")
def file_imports(spark: SparkSession, base: str) -> DataFrame:
    idx = Index.load(spark, base)
    return lookup.file_imports(idx, idx.imports.agg(F.min("rel_path")).first()[0] or "")


_WITHIN = """,
w AS (SELECT r.id AS r_id, r.repo_id, r.rel_path, r.file_id, r.line, r.name AS r_name, r.kind AS r_kind, s.id AS s_id, s.name AS s_name, s.kind AS s_kind,
        s.end_line - s.start_line AS span FROM r JOIN s ON r.file_id = s.file_id AND r.line BETWEEN s.start_line AND s.end_line)"""


@query("enclosing_symbol", _WITHIN + " SELECT r_id, s_name AS encloser FROM w QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY span, s_id) = 1")
def enclosing_symbol(spark: SparkSession, base: str) -> DataFrame:
    return lookup.enclosing(Index.load(spark, base))


_IMPLEMENTORS = f""",
e AS (SELECT r_id, s_name FROM w WHERE s_kind IN ({_quoted(N.TYPE_ENCLOSERS)}) QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY span, s_id) = 1)
SELECT r.id, coalesce(e.s_name, '') AS implementer, r.name AS target, r.repo_id, r.rel_path, r.line, r.language,
  EXISTS (SELECT 1 FROM s WHERE s.repo_id = r.repo_id AND s.name = r.name AND s.kind IN ({_quoted(N.TYPE_TARGETS)})) AS resolved
FROM r LEFT JOIN e ON e.r_id = r.id WHERE r.kind = 'implements' AND r.name IN ({_quoted(TARGETS)})"""


@query("implementors", _WITHIN + _IMPLEMENTORS)
def implementors(spark: SparkSession, base: str) -> DataFrame:
    return lookup.implementors(Index.load(spark, base), TARGETS)


_IMPLEMENTS = f""",
v AS (SELECT * FROM w WHERE r_kind = 'implements' AND s_kind IN ({_quoted(N.TYPE_ENCLOSERS)})),
n AS (SELECT * FROM v QUALIFY rank() OVER (PARTITION BY r_id ORDER BY span) = 1)
SELECT DISTINCT r_id AS id, s_name AS implementer, r_name AS target, repo_id, rel_path, line,
  EXISTS (SELECT 1 FROM s WHERE s.repo_id = n.repo_id AND s.name = n.r_name AND s.kind IN ({_quoted(N.TYPE_TARGETS)})) AS resolved
FROM n WHERE s_name IN ({_quoted(TYPES)})"""


@query("implements", _WITHIN + _IMPLEMENTS)
def implements(spark: SparkSession, base: str) -> DataFrame:
    return lookup.implements(Index.load(spark, base), TYPES)


_DEDUPED = _LINES + f""",
d AS (SELECT DISTINCT repo_id, rel_path, file_id, line FROM r WHERE name IN ({_quoted(USED)}))
SELECT d.repo_id, d.rel_path, trim(l.content, ' ') AS text, array_to_string(list_sort(list(DISTINCT d.line)), ',') AS lines, count(*) AS n
FROM d JOIN l ON l.file_id = d.file_id AND l.line = d.line GROUP BY 1, 2, 3"""


@query("dedup_ref_lines", _DEDUPED)
def dedup_ref_lines(spark: SparkSession, base: str) -> DataFrame:
    idx = Index.load(spark, base)
    found = lookup.deduped_lines(idx.refs.filter(F.col("name").isin(*USED)), load(spark, base, "file_contents"))
    return found.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


_CONTEXT = _LINES + f""",
d AS (SELECT id, file_id, line FROM r WHERE name IN ({_quoted(USED)}) AND kind = 'implements'),
x AS (SELECT d.id, string_agg(rtrim(l.content, ' '), chr(10) ORDER BY l.line) AS context FROM d JOIN l ON l.file_id = d.file_id AND l.line BETWEEN d.line - 1 AND d.line + 1 GROUP BY 1)
SELECT d.id, x.context FROM d LEFT JOIN x USING (id)"""


@query("ref_context", _CONTEXT)
def ref_context(spark: SparkSession, base: str) -> DataFrame:
    hits = Index.load(spark, base).refs.filter(F.col("name").isin(*USED) & (F.col("kind") == "implements"))
    return bundles.with_context(hits, load(spark, base, "file_contents"), 1).select("id", F.array_join("context", "\n").alias("context"))


# Traversals
_DOWN = f""",
ed AS (SELECT repo_id, s_name AS caller, r_name AS callee, arg_min({{'p': rel_path, 'l': line}}, (s_id, r_id)) AS p FROM w
       WHERE r_kind = 'call' AND s_name <> r_name AND strlen(r_name) > 2 AND r_name NOT IN ({_quoted(N.BUILTINS)}) GROUP BY 1, 2, 3),
l0 AS (SELECT DISTINCT repo_id, name AS root, name AS here FROM s WHERE name IN ({_quoted(ROOTS)})),
t1 AS (SELECT root, e.repo_id, caller, callee, p, 1 AS depth FROM l0 JOIN ed e ON e.repo_id = l0.repo_id AND e.caller = l0.here),
l1 AS (SELECT DISTINCT repo_id, root, callee AS here FROM t1 EXCEPT SELECT repo_id, root, here FROM l0),
t2 AS (SELECT root, e.repo_id, caller, callee, p, 2 AS depth FROM l1 JOIN ed e ON e.repo_id = l1.repo_id AND e.caller = l1.here),
tr AS (SELECT root, repo_id, caller, callee, p.p AS rel_path, p.l AS line, depth FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2))"""


@query("call_edges", _WITHIN + _DOWN + " SELECT repo_id, caller, callee, p.p AS rel_path, p.l AS line FROM ed")
def call_edges(spark: SparkSession, base: str) -> DataFrame:
    return traverse.edges_down(Index.load(spark, base)).drop("r_id")


@query("trace_d2", _WITHIN + _DOWN + " SELECT * FROM tr")
def trace_d2(spark: SparkSession, base: str) -> DataFrame:
    return traverse.trace(Index.load(spark, base), ROOTS, 2)


_UP = f""",
eu AS (SELECT * FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY span, s_id) = 1) WHERE s_name <> r_name),
m0 AS (SELECT DISTINCT repo_id, name AS root, name AS here FROM r WHERE name IN ({_quoted(USED)})),
u1 AS (SELECT root, e.repo_id, r_name AS callee, s_name AS caller, rel_path, line, r_id, 1 AS depth FROM m0 JOIN eu e ON e.repo_id = m0.repo_id AND e.r_name = m0.here),
m1 AS (SELECT DISTINCT repo_id, root, caller AS here FROM u1 EXCEPT SELECT repo_id, root, here FROM m0),
u2 AS (SELECT root, e.repo_id, r_name AS callee, s_name AS caller, rel_path, line, r_id, 2 AS depth FROM m1 JOIN eu e ON e.repo_id = m1.repo_id AND e.r_name = m1.here),
im AS (SELECT root, repo_id, callee, caller, rel_path, line, depth FROM (SELECT * FROM u1 UNION ALL SELECT * FROM u2)
       QUALIFY row_number() OVER (PARTITION BY root, repo_id, caller, rel_path ORDER BY depth, callee, line, r_id) = 1)"""


@query("impact_d2", _WITHIN + _UP + " SELECT * FROM im")
def impact_d2(spark: SparkSession, base: str) -> DataFrame:
    return traverse.impact(Index.load(spark, base), USED, 2)


@query("multi_symbol_attribution", _WITHIN + _UP + " SELECT repo_id, rel_path, line, caller, min(depth) AS depth, array_to_string(list_sort(list(DISTINCT root)), ',') AS hit_symbols FROM im GROUP BY 1, 2, 3, 4")
def multi_symbol_attribution(spark: SparkSession, base: str) -> DataFrame:
    return traverse.attributed(traverse.impact(Index.load(spark, base), USED, 2)).withColumn("hit_symbols", F.array_join("hit_symbols", ","))


_BASE = "regexp_replace(string_split(target, '/')[-1], '\\.[^.]*$', '')"
_IMPORTERS = f""",
g0 AS (SELECT DISTINCT repo_id, rel_path AS target FROM s WHERE name IN ({_quoted(ROOTS)})),
g AS (SELECT repo_id, target, lower({_BASE}) AS b FROM g0)
SELECT i.repo_id, i.rel_path, arg_min(i.raw_path, (target, raw_path)) AS import, 1 AS depth, min(target) AS parent
FROM i JOIN g ON g.repo_id = i.repo_id AND g.b <> '' AND lower(i.raw_path) LIKE '%' || g.b || '%' GROUP BY 1, 2"""


@query("importers", _IMPORTERS)
def importers(spark: SparkSession, base: str) -> DataFrame:
    return traverse.importers(Index.load(spark, base), ROOTS)


_BY_PATH = """
SELECT i.repo_id, i.rel_path, min(i.raw_path) AS import, 1 AS depth, 'base/log' AS parent
FROM i WHERE lower(i.raw_path) LIKE '%log%' OR lower(i.raw_path) LIKE '%base/log' GROUP BY 1, 2"""


@query("importers_by_path", _BY_PATH)
def importers_by_path(spark: SparkSession, base: str) -> DataFrame:
    return traverse.importers(Index.load(spark, base), paths=["base/log"])


# Structure
@query("language_counts", " SELECT repo_id, language, count(*) AS n_files FROM f GROUP BY 1, 2")
def language_counts(spark: SparkSession, base: str) -> DataFrame:
    return structure.language_counts(Index.load(spark, base))


@query("repo_stats", " SELECT f.repo_id, count(*) AS n_files, (SELECT count(*) FROM s WHERE s.repo_id = f.repo_id) AS n_symbols, count(DISTINCT language) AS n_languages FROM f GROUP BY 1")
def repo_stats(spark: SparkSession, base: str) -> DataFrame:
    return structure.repo_stats(Index.load(spark, base))


@query("entry_points", """
SELECT id, repo_id, name, kind, rel_path, start_line FROM s WHERE depth = 0 AND kind IN ('function', 'method')
  AND (name IN ('main', 'init', 'Main', 'Init') OR (regexp_matches(name, '^[A-Z]') AND kind = 'function' AND lower(rel_path) LIKE '%main%'))""")  # fmt: skip
def entry_points(spark: SparkSession, base: str) -> DataFrame:
    return structure.entry_points(Index.load(spark, base))


@query("top_by_refs", """
SELECT s.repo_id, s.name, s.rel_path, any_value(c.n) * count(*) AS n_refs, arg_min(s.kind, s.id) AS kind, arg_min(s.start_line, s.id) AS start_line
FROM s JOIN (SELECT repo_id, name, count(*) AS n FROM r GROUP BY 1, 2) c ON c.repo_id = s.repo_id AND c.name = s.name WHERE s.depth = 0 GROUP BY 1, 2, 3""")  # fmt: skip
def top_by_refs(spark: SparkSession, base: str) -> DataFrame:
    return structure.top_by_refs(Index.load(spark, base))


@query("top_packages", f" SELECT repo_id, {_PACKAGE} AS package, count(DISTINCT id) AS n_symbols, count(DISTINCT file_id) AS n_files FROM s GROUP BY 1, 2")
def top_packages(spark: SparkSession, base: str) -> DataFrame:
    return structure.top_packages(Index.load(spark, base))


# Paths
@query("package_key", f" SELECT file_id, {_PACKAGE} AS package FROM f")
def package_key(spark: SparkSession, base: str) -> DataFrame:
    return Index.load(spark, base).files.select("file_id", N.package_key(F.col("rel_path")).alias("package"))


@query("node_id", " SELECT DISTINCT name, 'n' || left(sha256(name), 16) AS node_id FROM s")
def node_id(spark: SparkSession, base: str) -> DataFrame:
    return Index.load(spark, base).symbols.select("name", N.node_id(F.col("name")).alias("node_id")).distinct()


@query("path_filter", " SELECT file_id, rel_path FROM f WHERE (regexp_matches(rel_path, '^src/.*\\.go$') OR contains(rel_path, 'service/')) AND NOT contains(rel_path, '_generated')")
def path_filter(spark: SparkSession, base: str) -> DataFrame:
    return Index.load(spark, base).files.filter(N.path_allowed(F.col("rel_path"), ["src/**/*.go", "service/"], ["_generated"])).select("file_id", "rel_path")


@query("generated_filter", f"""
SELECT file_id, rel_path FROM f WHERE regexp_matches('/' || lower(rel_path), '/(generated|__generated__)/')
  OR {' OR '.join(f"ends_with(lower(rel_path), '{x}')" for x in N.GENERATED_SUFFIXES)} OR regexp_matches('/' || lower(rel_path), '_generated\\.[^/]*$')""")  # fmt: skip
def generated_filter(spark: SparkSession, base: str) -> DataFrame:
    return Index.load(spark, base).files.filter(N.is_generated(F.col("rel_path"))).select("file_id", "rel_path")


@query("excluded_totals", f" SELECT repo_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM f WHERE size > {N.LARGE_FILE} GROUP BY 1")
def excluded_totals(spark: SparkSession, base: str) -> DataFrame:
    large = Index.load(spark, base).files.filter(F.col("size") > N.LARGE_FILE)
    return large.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


_EXT = " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in EXTENSIONS.items())
_NAMES = " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in BY_NAME.items())


@query("detected_language", f"""
SELECT file_id, coalesce(CASE regexp_extract(string_split(rel_path, '/')[-1], '(\\.[^.]*)$', 1) {_EXT} END, CASE string_split(rel_path, '/')[-1] {_NAMES} END) AS detected FROM f""")  # fmt: skip
def detected_language(spark: SparkSession, base: str) -> DataFrame:
    return Index.load(spark, base).files.select("file_id", language(F.col("rel_path")).alias("detected"))


@query("content_hash", " SELECT file_id, sha256(content) AS hash FROM file_contents WHERE content IS NOT NULL")
def content_hash(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "file_contents").filter("content is not null").select("file_id", F.sha2("content", 256).alias("hash"))


# Graphs
_GRAPH = """,
pl AS (SELECT repo_id, name, arg_min(rel_path, id) AS rel_path, arg_min(kind, id) AS kind FROM s WHERE depth = 0 GROUP BY 1, 2),
ge AS (SELECT DISTINCT t.repo_id, caller, callee FROM tr t JOIN pl a ON a.repo_id = t.repo_id AND a.name = caller JOIN pl b ON b.repo_id = t.repo_id AND b.name = callee),
gn AS (SELECT DISTINCT * FROM (SELECT repo_id, caller AS name FROM ge UNION SELECT repo_id, callee FROM ge UNION SELECT repo_id, name FROM pl WHERE name IN ({roots})))""".format(roots=_quoted(ROOTS))


def _graph(spark: SparkSession, base: str) -> graph.Graph:
    return graph.call_graph(Index.load(spark, base), ROOTS, 2)


@query("graph_nodes", _WITHIN + _DOWN + _GRAPH + f" SELECT gn.repo_id, 'n' || left(sha256(gn.name), 16) AS id, gn.name AS label, pl.kind, pl.rel_path, gn.name IN ({_quoted(ROOTS)}) AS root FROM gn JOIN pl ON pl.repo_id = gn.repo_id AND pl.name = gn.name")
def graph_nodes(spark: SparkSession, base: str) -> DataFrame:
    return _graph(spark, base).nodes


@query("graph_edges", _WITHIN + _DOWN + _GRAPH + " SELECT repo_id, 'n' || left(sha256(caller), 16) AS source, 'n' || left(sha256(callee), 16) AS target, 'call' AS kind, true AS resolved FROM ge")
def graph_edges(spark: SparkSession, base: str) -> DataFrame:
    return _graph(spark, base).edges


_DEGREE = """,
dg AS (SELECT repo_id, name, count(*) AS n FROM (SELECT repo_id, caller AS name FROM ge UNION ALL SELECT repo_id, callee FROM ge) GROUP BY 1, 2),
rk AS (SELECT gn.repo_id, gn.name, 'n' || left(sha256(gn.name), 16) AS id, coalesce(dg.n, 0) AS degree FROM gn LEFT JOIN dg USING (repo_id, name))
SELECT repo_id, id, name AS label FROM rk QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY name IN ({roots}) DESC, degree DESC, id) <= 3
UNION ALL SELECT repo_id, '_truncated', '… (' || (count(*) - 3) || ' more, truncated)' FROM rk GROUP BY 1 HAVING count(*) > 3""".format(roots=_quoted(ROOTS))


@query("graph_degree_topn", _WITHIN + _DOWN + _GRAPH + _DEGREE)
def graph_degree_topn(spark: SparkSession, base: str) -> DataFrame:
    return graph.truncated(_graph(spark, base), 3).nodes.select("repo_id", "id", "label")


@query("graph_unresolved", _WITHIN + _DOWN + _GRAPH + """
SELECT DISTINCT t.repo_id, 'n' || left(sha256(caller), 16) AS source, 'ext:' || callee AS name FROM tr t JOIN pl a ON a.repo_id = t.repo_id AND a.name = caller
WHERE NOT EXISTS (SELECT 1 FROM pl b WHERE b.repo_id = t.repo_id AND b.name = callee)""")  # fmt: skip
def graph_unresolved(spark: SparkSession, base: str) -> DataFrame:
    return _graph(spark, base).unresolved


# Refresh
_NOW = """,
n AS (SELECT repo_id, CASE WHEN rel_path LIKE './%' THEN substr(rel_path, 3) ELSE rel_path END AS rel_path, mtime_ns, size, seen_at, entry_id FROM walk_entries),
ls AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY repo_id, rel_path ORDER BY seen_at DESC, entry_id DESC) = 1)"""


@query("stale_paths", _NOW + " SELECT file_id, repo_id, rel_path FROM f WHERE NOT EXISTS (SELECT 1 FROM ls WHERE ls.repo_id = f.repo_id AND ls.rel_path = f.rel_path)")
def stale_paths(spark: SparkSession, base: str) -> DataFrame:
    return refresh.stale_files(refresh.latest_sights(load(spark, base, "walk_entries")), Index.load(spark, base).files).select("file_id", "repo_id", "rel_path")


@query("changed_files", _NOW + """
SELECT repo_id, rel_path FROM ls WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo_id = ls.repo_id AND f.rel_path = ls.rel_path
  AND coalesce(f.mtime_ns, 0) = coalesce(ls.mtime_ns, 0) AND coalesce(f.size, -1) = coalesce(ls.size, -1))""")  # fmt: skip
def changed_files(spark: SparkSession, base: str) -> DataFrame:
    return refresh.changed_files(refresh.latest_sights(load(spark, base, "walk_entries")), Index.load(spark, base).files).select("repo_id", "rel_path")


@query("ingest_counters", """
SELECT repo_id, CAST(sum(files_indexed) AS BIGINT) AS files_indexed, CAST(sum(symbols_found) AS BIGINT) AS symbols_found, CAST(sum(parse_errors) AS BIGINT) AS parse_errors
FROM (SELECT DISTINCT * FROM index_stats) GROUP BY 1""")  # fmt: skip
def ingest_counters(spark: SparkSession, base: str) -> DataFrame:
    stats = load(spark, base, "index_stats").distinct()
    return stats.groupBy("repo_id").agg(*[F.sum(c).alias(c) for c in ("files_indexed", "symbols_found", "parse_errors")])


@query("reference_metrics", """,
a AS (SELECT DISTINCT repo_id, name FROM r WHERE kind = 'call' AND name <> ''), b AS (SELECT DISTINCT repo_id, name FROM s),
j AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, a.name IS NOT NULL AS used, b.name IS NOT NULL AS known FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.name = b.name)
SELECT repo_id, count(*) FILTER (WHERE used AND known) AS both, count(*) FILTER (WHERE used AND NOT known) AS only_used, count(*) FILTER (WHERE known AND NOT used) AS only_known FROM j GROUP BY 1""")  # fmt: skip
def reference_metrics(spark: SparkSession, base: str) -> DataFrame:
    """The parts of precision and recall of called names against defined names."""
    idx = Index.load(spark, base)
    used = idx.refs.filter("kind = 'call' and name <> ''").select("repo_id", "name").distinct().withColumn("used", F.lit(True))
    known = idx.symbols.select("repo_id", "name").distinct().withColumn("known", F.lit(True))
    both = used.join(known, ["repo_id", "name"], "full")
    u, k = F.col("used").isNotNull(), F.col("known").isNotNull()
    return both.groupBy("repo_id").agg(F.count_if(u & k).alias("both"), F.count_if(u & ~k).alias("only_used"), F.count_if(k & ~u).alias("only_known"))


# Extraction, which SQL can't say
def _extracted(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = extract.with_language(Index.load(spark, base).files)
    return extract.tables(extract.parsed(files.join(load(spark, base, "file_contents"), "file_id")))


@query("extracted_symbols")
def extracted_symbols(spark: SparkSession, base: str) -> DataFrame:
    return _extracted(spark, base)[0]


@query("extracted_refs")
def extracted_refs(spark: SparkSession, base: str) -> DataFrame:
    return _extracted(spark, base)[1]


@query("extracted_imports")
def extracted_imports(spark: SparkSession, base: str) -> DataFrame:
    return _extracted(spark, base)[2]
