"""Further queries over the index: deeper traversals, graphs in all directions, lists of the overview, composite answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import names as N
from symgraph.operators import bundles, graph, lookup, search, structure, traverse
from symgraph.plans.index_queries import _BASE, _FOUND, _INDEX, _LINES, _ORDER, _PACKAGE, _SCORE, _WITHIN, _quoted
from symgraph.session import load
from symgraph.sources import walk
from symgraph.sources.index import Index
from symgraph.streaming import refresh

#: Names with calls between their definitions, and names that others use.
CALLERS = ["ReplayShuttle", "ReplayCargo", "flushSignal", "flushCistern", "New"]
USED = ["loadDocket", "trimKiln"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str = ""):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = "WITH " + _INDEX + sql
        return f

    return keep


def _down(roots: list[str], depth: int) -> str:
    """Trace in SQL: ed are the edges, tr the rows."""
    sql = f""",
ed AS (SELECT repo_id, s_name AS caller, r_name AS callee, arg_min({{'p': rel_path, 'l': line, 'r': r_id}}, (s_id, r_id)) AS p FROM w
       WHERE r_kind = 'call' AND s_name <> r_name AND strlen(r_name) > 2 AND r_name NOT IN ({_quoted(N.BUILTINS)}) GROUP BY 1, 2, 3),
d0 AS (SELECT DISTINCT repo_id, name AS root, name AS here, 0 AS depth FROM s WHERE name IN ({_quoted(roots)}))"""
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT repo_id, root, here FROM d{j}" for j in range(k))
        sql += f""",
t{k} AS (SELECT root, e.repo_id, caller, callee, p, {k} AS depth FROM d{k - 1} d JOIN ed e ON e.repo_id = d.repo_id AND e.caller = d.here),
d{k} AS (SELECT DISTINCT repo_id, root, callee AS here, {k} AS depth FROM t{k} EXCEPT SELECT repo_id, root, here, {k} FROM ({seen}))"""
    rows = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, depth + 1))
    return sql + f", tr AS (SELECT root, repo_id, caller, callee, p.p AS rel_path, p.l AS line, depth FROM ({rows}))"


def _up(roots: list[str], depth: int) -> str:
    """Impact in SQL: im are the rows."""
    sql = f""",
eu AS (SELECT * FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY span, s_id) = 1) WHERE s_name <> r_name),
m0 AS (SELECT DISTINCT repo_id, name AS root, name AS here FROM r WHERE name IN ({_quoted(roots)}))"""
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT * FROM m{j}" for j in range(k))
        sql += f""",
u{k} AS (SELECT root, e.repo_id, r_name AS callee, s_name AS caller, rel_path, line, r_id, {k} AS depth FROM m{k - 1} m JOIN eu e ON e.repo_id = m.repo_id AND e.r_name = m.here),
m{k} AS (SELECT DISTINCT repo_id, root, caller AS here FROM u{k} EXCEPT SELECT * FROM ({seen}))"""
    rows = " UNION ALL ".join(f"SELECT * FROM u{k}" for k in range(1, depth + 1))
    return sql + f""",
im AS (SELECT root, repo_id, callee, caller, rel_path, line, depth FROM ({rows})
       QUALIFY row_number() OVER (PARTITION BY root, repo_id, caller, rel_path ORDER BY depth, callee, line, r_id) = 1)"""


# Deeper traversals
@query("trace_d3", _WITHIN + _down(CALLERS, 3) + " SELECT * FROM tr")
def trace_d3(spark: SparkSession, base: str) -> DataFrame:
    return traverse.trace(Index.load(spark, base), CALLERS, 3)


@query("trace_first", _WITHIN + _down(CALLERS[:1], 1) + f" SELECT repo_id, caller, callee, depth FROM t1 ORDER BY depth, p.r, repo_id, root, caller, callee LIMIT 7")
def trace_first(spark: SparkSession, base: str) -> DataFrame:
    """The first edges in the order of discovery."""
    return traverse.trace(Index.load(spark, base), CALLERS[:1], 1, limit=7).select("repo_id", "caller", "callee", "depth")


@query("impact_d3", _WITHIN + _up(USED, 3) + " SELECT * FROM im")
def impact_d3(spark: SparkSession, base: str) -> DataFrame:
    return traverse.impact(Index.load(spark, base), USED, 3)


@query("trace_attribution", _WITHIN + _down(CALLERS, 2) + " SELECT repo_id, rel_path, line, caller, min(depth) AS depth, array_to_string(list_sort(list(DISTINCT root)), ',') AS hit_symbols FROM tr GROUP BY 1, 2, 3, 4")
def trace_attribution(spark: SparkSession, base: str) -> DataFrame:
    return traverse.attributed(traverse.trace(Index.load(spark, base), CALLERS, 2)).withColumn("hit_symbols", F.array_join("hit_symbols", ","))


_STEP = """
{out} AS (SELECT i.repo_id, i.rel_path, arg_min(i.raw_path, (target, raw_path)) AS import, {level} AS depth, min(target) AS parent
  FROM i JOIN (SELECT repo_id, target, lower({base}) AS b FROM {g}) g ON g.repo_id = i.repo_id AND g.b <> '' AND lower(i.raw_path) LIKE '%' || g.b || '%'
  WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.repo_id = i.repo_id AND x.rel_path = i.rel_path) GROUP BY 1, 2)"""
_IMPORTERS_D2 = f""",
g0 AS (SELECT DISTINCT repo_id, rel_path AS target FROM s WHERE name IN ('load', 'run')), none AS (SELECT repo_id, rel_path FROM f WHERE false),
{_STEP.format(out='i1', level=1, base=_BASE, g='g0', seen='none')},
g1 AS (SELECT repo_id, rel_path AS target FROM i1),
{_STEP.format(out='i2', level=2, base=_BASE, g='g1', seen='i1')}
SELECT * FROM i1 UNION ALL SELECT * FROM i2"""


@query("importers_d2", _IMPORTERS_D2)
def importers_d2(spark: SparkSession, base: str) -> DataFrame:
    return traverse.importers(Index.load(spark, base), ["load", "run"], depth=2)


# Graphs
_ID = "'n' || left(sha256({}), 16)"
_PLACES = ", pl AS (SELECT repo_id, name, arg_min(rel_path, id) AS rel_path, arg_min(kind, id) AS kind FROM s WHERE depth = 0 GROUP BY 1, 2)"
_KNOWN = "SELECT DISTINCT t.repo_id, caller, callee FROM {rows} t JOIN pl a ON a.repo_id = t.repo_id AND a.name = caller JOIN pl b ON b.repo_id = t.repo_id AND b.name = callee"
_EDGE = f"repo_id, {_ID.format('caller')} AS source, {_ID.format('callee')} AS target, 'call' AS kind, true AS resolved"


@query("graph_down_edges", _WITHIN + _down(CALLERS, 3) + _PLACES + f" SELECT {_EDGE} FROM ({_KNOWN.format(rows='tr')})")
def graph_down_edges(spark: SparkSession, base: str) -> DataFrame:
    return graph.call_graph(Index.load(spark, base), CALLERS, 3).edges


@query("graph_up_edges", _WITHIN + _up(USED, 2) + _PLACES + f" SELECT {_EDGE} FROM ({_KNOWN.format(rows='im')})")
def graph_up_edges(spark: SparkSession, base: str) -> DataFrame:
    return graph.call_graph(Index.load(spark, base), USED, 2, "up").edges


_MERGED = f""",
ge AS ({_KNOWN.format(rows='tr')} UNION {_KNOWN.format(rows='im')}),
gn AS (SELECT repo_id, caller AS name FROM ge UNION SELECT repo_id, callee FROM ge UNION SELECT repo_id, name FROM pl WHERE name IN ({_quoted(CALLERS + USED)})),
dg AS (SELECT repo_id, name, count(*) AS n FROM (SELECT repo_id, caller AS name FROM ge UNION ALL SELECT repo_id, callee FROM ge) GROUP BY 1, 2)
SELECT gn.repo_id, {_ID.format('gn.name')} AS id, gn.name AS label, pl.kind, pl.rel_path, gn.name IN ({_quoted(CALLERS + USED)}) AS root, coalesce(dg.n, 0) AS degree
FROM gn JOIN pl USING (repo_id, name) LEFT JOIN dg USING (repo_id, name)"""


@query("graph_merged", _WITHIN + _down(CALLERS, 2) + _up(USED, 2) + _PLACES + _MERGED)
def graph_merged(spark: SparkSession, base: str) -> DataFrame:
    """The nodes of a graph down and a graph up together, with the edges they have in the whole."""
    idx = Index.load(spark, base)
    whole = graph.merged([graph.call_graph(idx, CALLERS, 2), graph.call_graph(idx, USED, 2, "up")])
    return graph.degrees(whole.nodes, whole.edges)


_SCOPED = f""" SELECT {_EDGE} FROM (SELECT t.repo_id, caller, callee, a.rel_path AS p, b.rel_path AS q FROM (SELECT DISTINCT repo_id, caller, callee FROM tr) t
  JOIN pl a ON a.repo_id = t.repo_id AND a.name = caller JOIN pl b ON b.repo_id = t.repo_id AND b.name = callee)
WHERE p NOT LIKE '%.java' AND q NOT LIKE '%.java' GROUP BY ALL"""


@query("graph_scoped_edges", _WITHIN + _down(CALLERS, 3) + _PLACES + _SCOPED)
def graph_scoped_edges(spark: SparkSession, base: str) -> DataFrame:
    return graph.call_graph(Index.load(spark, base), CALLERS, 3, exclude=["*.java"]).edges


@query("import_graph_edges", _IMPORTERS_D2.replace("SELECT * FROM i1 UNION ALL SELECT * FROM i2", f"""
SELECT DISTINCT repo_id, {_ID.format('rel_path')} AS source, {_ID.format('parent')} AS target, 'import' AS kind, true AS resolved FROM (SELECT * FROM i1 UNION ALL SELECT * FROM i2)"""))
def import_graph_edges(spark: SparkSession, base: str) -> DataFrame:
    return graph.import_graph(traverse.importers(Index.load(spark, base), ["load", "run"], depth=2)).edges


_TARGETS = ["append", "Get", "checkPermit"]
_IMPLS = f""",
e AS (SELECT r_id, s_name FROM w WHERE s_kind IN ({_quoted(N.TYPE_ENCLOSERS)}) QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY span, s_id) = 1),
im AS (SELECT r.id, coalesce(e.s_name, '') AS implementer, r.name AS target, r.repo_id, r.rel_path, r.line, r.language,
  EXISTS (SELECT 1 FROM s WHERE s.repo_id = r.repo_id AND s.name = r.name AND s.kind IN ({_quoted(N.TYPE_TARGETS)})) AS resolved
FROM r LEFT JOIN e ON e.r_id = r.id WHERE r.kind = 'implements' AND r.name IN ({_quoted(_TARGETS)}))"""
_SEP = "chr(31)"


@query("conformance_edges", _WITHIN + _IMPLS + f"""
SELECT DISTINCT repo_id, {_ID.format(f"'impl' || {_SEP} || rel_path || {_SEP} || implementer")} AS source,
  {_ID.format(f"CASE WHEN resolved THEN 'sym-target' ELSE 'ext' END || {_SEP} || target")} AS target, 'implements' AS kind, resolved FROM im""")  # fmt: skip
def conformance_edges(spark: SparkSession, base: str) -> DataFrame:
    return graph.conformance_graph(lookup.implementors(Index.load(spark, base), _TARGETS)).edges


@query("impls_filtered", _WITHIN + _IMPLS + " SELECT * FROM im WHERE language = 'go' AND NOT resolved AND NOT contains(rel_path, 'vendor/') ORDER BY repo_id, rel_path, line, id LIMIT 30")
def impls_filtered(spark: SparkSession, base: str) -> DataFrame:
    return lookup.narrowed(lookup.implementors(Index.load(spark, base), _TARGETS), "go", False, exclude=["vendor/"], limit=30)


# Search
_TOKENS = """,
t AS (SELECT *, [x FOR x IN string_split_regex(lower(name || ' ' || kind), '[^\\p{L}\\p{N}]+') IF x <> ''] AS t FROM s),
c AS (SELECT *, len([x FOR x IN t IF {first}]) AS n0, len([x FOR x IN t IF starts_with(x, '{last}')]) AS n1 FROM t),
st AS (SELECT count(*) AS total, avg(len(t)) AS mean, count(*) FILTER (WHERE n0 > 0) AS h0, count(*) FILTER (WHERE n1 > 0) AS h1 FROM c),
q AS (SELECT c.*, {score} AS score, CASE WHEN lower(name) = '{query}' THEN 0 WHEN starts_with(lower(name), '{query}') THEN 1 ELSE 2 END AS tier,
        round({r0}greatest(ln((total - h1 + 0.5) / (h1 + 0.5)), 1e-6) * n1 * 2.2 / (n1 + 1.2 * (0.25 + 0.75 * len(t) / mean)), 6) AS rank FROM c, st WHERE {when} n1 > 0)"""
_R0 = "greatest(ln((total - h0 + 0.5) / (h0 + 0.5)), 1e-6) * n0 * 2.2 / (n0 + 1.2 * (0.25 + 0.75 * len(t) / mean)) + "


def _tokens(query: str, first: str, last: str, score: str) -> str:
    sql = _TOKENS
    for k, v in {"{first}": f"x = '{first}'" if first else "false", "{last}": last, "{score}": score, "{query}": query, "{r0}": _R0 if first else "", "{when}": "n0 > 0 AND" if first else ""}.items():
        sql = sql.replace(k, v)
    return sql


@query("prefix_search_words", _tokens("function replay", "function", "replay", _SCORE) + f" SELECT {_FOUND}, score, tier, rank FROM q ORDER BY tier, score DESC, rank DESC, name, repo_id, rel_path, start_line, id LIMIT 60")
def prefix_search_words(spark: SparkSession, base: str) -> DataFrame:
    """Two words that must both be there, the last as a prefix."""
    return search.prefix_search(Index.load(spark, base), "function replay", limit=60)


@query("flex_search_fallback", _tokens("replays", "", "replays", _SCORE) + f" SELECT {_FOUND}, score FROM q ORDER BY tier, score DESC, rank DESC, name, repo_id, rel_path, start_line, id LIMIT 20")
def flex_search_fallback(spark: SparkSession, base: str) -> DataFrame:
    """No name is the query, so names that begin with it are found."""
    return search.flex_search(Index.load(spark, base), "replays")


@query("ranking_metrics", f""",
k AS (SELECT name AS query, id AS item, row_number() OVER (PARTITION BY name ORDER BY {_ORDER}) AS rank FROM (SELECT *, {_SCORE} AS score FROM s WHERE depth = 0)),
x AS (SELECT name AS query, id AS item FROM s WHERE depth = 0 AND kind = 'function'),
b AS (SELECT x.query, min(k.rank) AS best FROM x LEFT JOIN k ON k.query = x.query AND k.item = x.item GROUP BY 1)
SELECT count(*) AS n_queries, avg(coalesce(1.0 / best, 0)) AS mrr, avg(CASE WHEN best = 1 THEN 1 ELSE 0 END) AS top1, median(best) AS median_rank FROM b""")  # fmt: skip
def ranking_metrics(spark: SparkSession, base: str) -> DataFrame:
    """How well the score puts functions first among the definitions of a name."""
    from pyspark.sql import Window

    top = search.scored(Index.load(spark, base).symbols.filter("depth = 0"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), *search.ORDER))
    ranked = top.select(F.col("name").alias("query"), F.col("id").alias("item"), rank.alias("rank"))
    return search.ranking_metrics(ranked, top.filter("kind = 'function'").select(F.col("name").alias("query"), F.col("id").alias("item")))


# Overview
@query("structure_top_refs", """
SELECT s.repo_id, s.name, s.rel_path, any_value(c.n) * count(*) AS n_refs, arg_min(s.kind, s.id) AS kind, arg_min(s.start_line, s.id) AS start_line
FROM s JOIN (SELECT repo_id, name, count(*) AS n FROM r GROUP BY 1, 2) c ON c.repo_id = s.repo_id AND c.name = s.name WHERE s.depth = 0 GROUP BY 1, 2, 3
ORDER BY n_refs DESC, s.name, s.repo_id, s.rel_path LIMIT 10""")  # fmt: skip
def structure_top_refs(spark: SparkSession, base: str) -> DataFrame:
    return structure.structure(Index.load(spark, base))["top_by_refs"]


@query("structure_packages", f" SELECT repo_id, {_PACKAGE} AS package, count(DISTINCT id) AS n_symbols, count(DISTINCT file_id) AS n_files FROM s GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def structure_packages(spark: SparkSession, base: str) -> DataFrame:
    return structure.structure(Index.load(spark, base))["top_packages"]


_DOTTED = """,
h AS (SELECT repo_id, split_part(rel_path, '/', 1) AS top, min(rel_path) AS head FROM f GROUP BY 1, 2),
j AS (SELECT f.file_id, f.repo_id, 'use ' || replace(h.head, '/', '.') AS raw_path FROM f JOIN h ON h.repo_id = f.repo_id AND h.top = split_part(f.rel_path, '/', 1)),
d AS (SELECT repo_id, rel_path, lower(replace(rel_path, '/', '.')) AS a FROM f),
e AS (SELECT DISTINCT repo_id, rel_path, unnest([a, replace(a, '.go', ''), replace(a, '.py', '')]) AS a FROM d)
SELECT e.repo_id, e.rel_path, count(DISTINCT j.file_id) AS n_files FROM j JOIN e ON e.repo_id = j.repo_id AND e.a <> '' AND lower(j.raw_path) LIKE '%' || e.a || '%'
GROUP BY 1, 2 HAVING count(DISTINCT j.file_id) > 1"""


@query("import_fan_in", _DOTTED)
def import_fan_in(spark: SparkSession, base: str) -> DataFrame:
    """Import fan-in where every file imports the first file of its top folder by its dotted path, as the tables' imports name no files."""
    idx = Index.load(spark, base)
    top = F.substring_index("rel_path", "/", 1).alias("top")
    heads = idx.files.groupBy("repo_id", top).agg(F.min("rel_path").alias("head"))
    rows = idx.files.select("file_id", "repo_id", "rel_path", top).join(heads, ["repo_id", "top"])
    imports = rows.select(F.col("file_id").alias("id"), "file_id", F.concat(F.lit("use "), F.replace("head", F.lit("/"), F.lit("."))).alias("raw_path"), F.lit("x").alias("language"), "repo_id", "rel_path")
    return structure.import_fan_in(Index(idx.files, idx.symbols, idx.refs, imports))


@query("directory_tree", """,
u AS (SELECT repo_id, string_split(rel_path, '/') AS p FROM f),
v AS (SELECT repo_id, p, unnest(range(1, len(p) + 1)) AS k FROM u)
SELECT DISTINCT repo_id, array_to_string(p[1:k], '/') AS path, CASE WHEN k = 1 THEN '' ELSE array_to_string(p[1:k - 1], '/') END AS parent_path, p[k] AS name, CAST(k AS INTEGER) AS depth, k < len(p) AS is_dir
FROM v WHERE k <= 3""")  # fmt: skip
def directory_tree(spark: SparkSession, base: str) -> DataFrame:
    return walk.tree(Index.load(spark, base).files, 3)


# Answers
_BUSIEST = f"""SELECT r.rel_path FROM r JOIN (SELECT DISTINCT repo_id, name FROM s WHERE kind IN ({_quoted(N.TYPE_REFS)})) t ON t.repo_id = r.repo_id AND t.name = r.name
  GROUP BY r.rel_path ORDER BY count(*) DESC, r.rel_path LIMIT 1"""


@query("type_refs_in_range", f""",
m AS (SELECT DISTINCT repo_id, name FROM r WHERE rel_path = ({_BUSIEST}) AND line BETWEEN 1 AND 3000)
SELECT s.repo_id, s.rel_path || ':' || s.language || ':' || s.kind || ':' || s.name || ':' || s.start_line AS symbol_id, min(s.id) AS id
FROM s JOIN m ON m.repo_id = s.repo_id AND m.name = s.name WHERE s.kind IN ({_quoted(N.TYPE_REFS)}) GROUP BY 1, 2""")  # fmt: skip
def type_refs_in_range(spark: SparkSession, base: str) -> DataFrame:
    """The types named in the file that names most of them."""
    idx = Index.load(spark, base)
    types = idx.symbols.filter(F.col("kind").isin(*N.TYPE_REFS)).select("repo_id", "name").distinct()
    first = idx.refs.join(types, ["repo_id", "name"]).groupBy("rel_path").count().orderBy(F.desc("count"), "rel_path").first()
    return lookup.type_refs(idx, first["rel_path"] if first else "", 1, 3000)


_ONE = f"SELECT repo_id, rel_path, start_line, end_line, name FROM (SELECT *, {_SCORE} AS score FROM s WHERE name = 'load') ORDER BY {_ORDER.replace('repo_id', 'repo_id')} LIMIT 1"


@query("context_source", _LINES + f", o AS ({_ONE}) SELECT l.line, l.content FROM o JOIN f ON f.repo_id = o.repo_id AND f.rel_path = o.rel_path JOIN l ON l.file_id = f.file_id AND l.line BETWEEN o.start_line AND o.end_line")
def context_source(spark: SparkSession, base: str) -> DataFrame:
    """The source of the likeliest definition of a name."""
    return bundles.context_of(Index.load(spark, base), load(spark, base, "file_contents"), "load")["source"]


@query("context_callers", f", o AS ({_ONE.replace(chr(39) + 'load' + chr(39), chr(39) + 'checkPermit' + chr(39))}) SELECT r.id, r.name, r.kind, r.repo_id, r.rel_path, r.line FROM r JOIN o ON o.repo_id = r.repo_id AND o.name = r.name ORDER BY r.repo_id, r.rel_path, r.line, r.id LIMIT 20")
def context_callers(spark: SparkSession, base: str) -> DataFrame:
    return bundles.context_of(Index.load(spark, base), load(spark, base, "file_contents"), "checkPermit")["callers"]


@query("outline_names", " SELECT DISTINCT repo_id, name FROM s WHERE rel_path = (SELECT min(rel_path) FROM s)")
def outline_names(spark: SparkSession, base: str) -> DataFrame:
    idx = Index.load(spark, base)
    return lookup.outline_names(idx, idx.symbols.agg(F.min("rel_path")).first()[0] or "")


@query("code_queries", r"""
SELECT DISTINCT raw_path AS query FROM i WHERE length(raw_path) >= 3 AND NOT starts_with(raw_path, '*.') AND regexp_matches(raw_path, '[\p{L}_]')
  AND (length(raw_path) - length(translate(raw_path, '\^$.|?*+()[]{}', ''))) * 2 <= length(raw_path)""")  # fmt: skip
def code_queries(spark: SparkSession, base: str) -> DataFrame:
    return Index.load(spark, base).imports.filter(N.looks_like_code(F.col("raw_path"))).select(F.col("raw_path").alias("query")).distinct()


# Refresh
@query("refreshed_symbols", """,
n AS (SELECT repo_id, CASE WHEN rel_path LIKE './%' THEN substr(rel_path, 3) ELSE rel_path END AS rel_path, mtime_ns, size, seen_at, entry_id FROM walk_entries),
ls AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY repo_id, rel_path ORDER BY seen_at DESC, entry_id DESC) = 1),
gone AS (SELECT file_id FROM f WHERE NOT EXISTS (SELECT 1 FROM ls WHERE ls.repo_id = f.repo_id AND ls.rel_path = f.rel_path)),
new AS (SELECT s.* FROM s JOIN f USING (file_id) JOIN ls ON ls.repo_id = f.repo_id AND ls.rel_path = f.rel_path
        WHERE coalesce(f.mtime_ns, 0) <> coalesce(ls.mtime_ns, 0) OR coalesce(f.size, -1) <> coalesce(ls.size, -1)),
al AS (SELECT file_id, id, name FROM s WHERE file_id NOT IN (SELECT file_id FROM gone) AND file_id NOT IN (SELECT file_id FROM new)
       UNION ALL SELECT file_id, id, upper(name) FROM new)
SELECT file_id, count(*) AS n_symbols, min(name) AS first_name FROM al GROUP BY 1""")  # fmt: skip
def refreshed_symbols(spark: SparkSession, base: str) -> DataFrame:
    """Symbols after a refresh in which changed files give their symbols in capitals and files that are gone give none."""
    idx, seen = Index.load(spark, base), refresh.latest_sights(load(spark, base, "walk_entries"))
    changed = refresh.changed_files(seen, idx.files).select("repo_id", "rel_path")
    files = idx.files.join(changed, ["repo_id", "rel_path"], "left_semi").select("file_id")
    rows = idx.symbols.select("file_id", "id", "name")
    new = rows.join(files, "file_id", "left_semi").withColumn("name", F.upper("name"))
    after = refresh.merged_rows(rows, new, refresh.stale_files(seen, idx.files))
    return after.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("name").alias("first_name"))
