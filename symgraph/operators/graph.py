"""Graphs as DataFrames of nodes and edges, and their text forms."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.names import in_scope, node_id
from symgraph.operators.traverse import impact, trace
from symgraph.sources.index import Index

#: Nodes that Mermaid still draws.
MERMAID_NODES = 500


@dataclass(frozen=True)
class Graph:
    """nodes: id, label, kind, rel_path, root; edges: source, target, kind, resolved; unresolved: source, name."""

    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame


def symbol_places(idx: Index) -> DataFrame:
    """The first top-level definition of each name; nested symbols have no place, so they are external to a graph."""
    first = F.min(F.struct("id", "rel_path", "kind")).alias("_f")
    return idx.symbols.filter("depth = 0").groupBy("repo_id", "name").agg(first).select("repo_id", "name", F.col("_f.rel_path").alias("rel_path"), F.col("_f.kind").alias("kind"))


def call_graph(
    idx: Index, names: list[str], depth: int | None = None, direction: str = "down", scope: list[str] = (), exclude: list[str] = (), include_unresolved: bool = False
) -> Graph:
    """The graph of what the names call (down), who uses them (up), or both, within the scope of paths.

    Without a depth, two levels down or one up.
    """
    depth = min(max((1 if direction == "up" else 2) if depth is None else depth, 1), 5)
    names = [n for n in names if n.strip()]
    places = symbol_places(idx)
    parts = []
    if direction in ("down", "both"):
        parts.append(trace(idx, names, depth).select("repo_id", "caller", "callee"))
    if direction in ("up", "both"):
        parts.append(impact(idx, names, depth).select("repo_id", "caller", "callee"))
    calls = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    calls = calls.distinct()
    source = places.select("repo_id", F.col("name").alias("caller"), F.col("rel_path").alias("_from"))
    target = places.select("repo_id", F.col("name").alias("callee"), F.col("rel_path").alias("_to"))
    drawn = calls.join(source, ["repo_id", "caller"]).join(target, ["repo_id", "callee"], "left").filter(in_scope(F.col("_from"), scope, exclude))
    known = drawn.filter(F.col("_to").isNotNull() & in_scope(F.col("_to"), scope, exclude))
    outside = drawn.filter(F.col("_to").isNull())
    edges = known.select("repo_id", node_id(F.col("caller")).alias("source"), node_id(F.col("callee")).alias("target"), F.lit("call").alias("kind"), F.lit(True).alias("resolved"))
    ends = known.select("repo_id", F.explode(F.array("caller", "callee")).alias("name"))
    if include_unresolved:
        far = outside.select("repo_id", node_id(F.col("caller")).alias("source"), node_id(F.concat(F.lit("ext:"), F.col("callee"))).alias("target"), F.lit("call").alias("kind"), F.lit(False).alias("resolved"))
        edges = edges.unionByName(far)
        ends = ends.unionByName(outside.select("repo_id", F.col("caller").alias("name")))
    roots = places.filter(F.col("name").isin(*names) & in_scope(F.col("rel_path"), scope, exclude)).select("repo_id", "name")
    inner = ends.unionByName(roots).distinct().join(places, ["repo_id", "name"]).select(
        "repo_id", node_id(F.col("name")).alias("id"), F.col("name").alias("label"), "kind", "rel_path", F.col("name").isin(*names).alias("root")
    )
    if include_unresolved:
        ext = outside.select("repo_id", F.concat(F.lit("ext:"), F.col("callee")).alias("_x"), "callee").distinct()
        inner = inner.unionByName(ext.select("repo_id", node_id(F.col("_x")).alias("id"), F.col("callee").alias("label"), F.lit("external").alias("kind"), F.lit("").alias("rel_path"), F.lit(False).alias("root")))
    unresolved = outside.select("repo_id", node_id(F.col("caller")).alias("source"), F.concat(F.lit("ext:"), F.col("callee")).alias("name")).distinct()
    return Graph(inner, edges.distinct(), unresolved)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("repo_id", F.explode(F.array("source", "target")).alias("id")).groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, ["repo_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def truncated(graph: Graph, limit: int) -> Graph:
    """The `limit` nodes of most edges in each repository, roots first; a last node says how many are gone, with their edges."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("root"), F.desc("degree"), "id"))
    ranked = degrees(graph.nodes, graph.edges).withColumn("_rank", rank)
    kept = ranked.filter(F.col("_rank") <= limit).drop("_rank", "degree")
    gone = ranked.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    label = F.concat(F.lit("… ("), (F.col("_n") - limit).cast("string"), F.lit(" more, truncated)"))
    mark = gone.select("repo_id", F.lit("_truncated").alias("id"), label.alias("label"), F.lit("truncated").alias("kind"), F.lit("").alias("rel_path"), F.lit(False).alias("root"))
    ids = kept.select("repo_id", "id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), ["repo_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["repo_id", "target"], "left_semi")
    return Graph(kept.unionByName(mark), edges, graph.unresolved)


def merged(graphs: list[Graph]) -> Graph:
    first, *rest = graphs
    for g in rest:
        first = Graph(first.nodes.unionByName(g.nodes), first.edges.unionByName(g.edges), first.unresolved.unionByName(g.unresolved))
    root = F.max("root").alias("root")
    nodes = first.nodes.groupBy("repo_id", "id", "label", "kind", "rel_path").agg(root)
    return Graph(nodes, first.edges.dropDuplicates(["repo_id", "source", "target", "kind"]), first.unresolved.distinct())


def import_graph(found: DataFrame) -> Graph:
    """The graph of `importers`: files, with edges from the importing file to what it imports."""
    edges = found.select("repo_id", node_id(F.col("rel_path")).alias("source"), node_id(F.col("parent")).alias("target"), F.lit("import").alias("kind"), F.lit(True).alias("resolved")).distinct()
    files = found.select("repo_id", F.explode(F.array("rel_path", "parent")).alias("rel_path")).distinct()
    nodes = files.select("repo_id", node_id(F.col("rel_path")).alias("id"), F.col("rel_path").alias("label"), F.lit("file").alias("kind"), "rel_path", F.lit(False).alias("root"))
    return Graph(nodes, edges, nodes.limit(0).select("repo_id", F.col("id").alias("source"), F.col("label").alias("name")))


def conformance_graph(found: DataFrame) -> Graph:
    """The graph of `implementors` or `implements`: targets that are known, external or implementing keep ids of their own."""
    def key(space, *parts):
        return node_id(F.concat_ws("\x1f", space, *parts))

    space = F.when(F.col("resolved"), F.lit("sym-target")).otherwise(F.lit("ext"))
    rows = found.select("repo_id", "rel_path", "implementer", "target", "resolved", key(F.lit("impl"), F.col("rel_path"), F.col("implementer")).alias("source"), key(space, F.col("target")).alias("to"))
    edges = rows.select("repo_id", "source", F.col("to").alias("target"), F.lit("implements").alias("kind"), "resolved").distinct()
    a = rows.select("repo_id", F.col("source").alias("id"), F.col("implementer").alias("label"), F.lit("implementer").alias("kind"), "rel_path", F.lit(False).alias("root"))
    b = rows.select("repo_id", F.col("to").alias("id"), F.col("target").alias("label"), F.when(F.col("resolved"), "symbol").otherwise("external").alias("kind"), F.lit("").alias("rel_path"), F.lit(True).alias("root"))
    unresolved = rows.filter("not resolved").select("repo_id", "source", F.concat(F.lit("ext:"), F.col("target")).alias("name")).distinct()
    return Graph(a.unionByName(b).distinct(), edges, unresolved)


def form_of(asked: str = "", as_json: bool = False, terminal: bool = False) -> str:
    """The form of a graph: the one asked for, else JSON where JSON is wanted, else Mermaid on a terminal and JSON in a pipe."""
    if asked and asked not in ("json", "mermaid", "dot"):
        raise ValueError(f"no form {asked}")
    return asked or ("mermaid" if terminal and not as_json else "json")


def render(graph: Graph, form: str = "json", limit: int = MERMAID_NODES) -> str:
    """The graph of one repository as JSON, Mermaid or DOT, cut to `limit` nodes before it comes to the driver.

    A graph of several repositories is refused, as its nodes are numbered within each; filter it first.
    """
    if len(graph.nodes.select("repo_id").distinct().limit(2).collect()) > 1:
        raise ValueError("more than one repository")
    shown = truncated(graph, min(limit, MERMAID_NODES) if form == "mermaid" else limit)
    nodes = [r.asDict() for r in shown.nodes.select("id", "label", "kind", "rel_path").distinct().orderBy("id", "label").collect()]
    edges = [r.asDict() for r in shown.edges.select("source", "target", "kind", "resolved").distinct().orderBy("source", "target", F.desc("resolved")).collect()]
    if form == "json":
        return json.dumps({"version": "0.1", "results": {"nodes": nodes, "edges": edges}}, indent=2, ensure_ascii=False)
    quoted = lambda x: json.dumps(x, ensure_ascii=False)
    if form == "mermaid":
        lines = ["flowchart LR"] + [f"  {n['id']}[{quoted(n['label'])}]" for n in nodes]
        lines += [f"  {e['source']} {'-->' if e['resolved'] else '-.->'} {e['target']}" for e in edges]
        return "\n".join(lines if nodes or edges else [*lines, "%% no edges"]) + "\n"
    if form == "dot":
        if not nodes and not edges:
            return "digraph g { /* no edges */ }\n"
        lines = ["digraph g {"] + [f"  {n['id']} [label={quoted(n['label'])}];" for n in nodes]
        lines += [f"  {e['source']} -> {e['target']}{'' if e['resolved'] else ' [style=dashed]'};" for e in edges]
        return "\n".join([*lines, "}"]) + "\n"
    raise ValueError(f"no form {form}")
