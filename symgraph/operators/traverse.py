"""Bounded traversals of the call graph and the import graph, for many roots at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions.names import ascii_lower, is_project_name, stem
from symgraph.operators.lookup import within
from symgraph.session import cut
from symgraph.sources.index import Index


def edges_down(idx: Index, kinds: tuple[str, ...] = ("call",), callers: DataFrame | None = None) -> DataFrame:
    """caller -> callee within a repository: any symbol around a call is its caller. The place is that of the first (symbol, ref).

    With `callers` (repo_id, at) only their symbols, in the files that hold them, are looked at.
    """
    symbols, refs = idx.symbols, idx.refs.filter(F.col("kind").isin(*kinds) & is_project_name(F.col("name")))
    if callers is not None:
        symbols = symbols.join(callers.select("repo_id", F.col("at").alias("name")).distinct(), ["repo_id", "name"], "left_semi")
    place = F.min(F.struct("s_id", "r_id", "rel_path", "r_line")).alias("_p")
    edges = within(symbols, refs).filter("s_name <> r_name").groupBy("repo_id", F.col("s_name").alias("caller"), F.col("r_name").alias("callee")).agg(place)
    return edges.select("repo_id", "caller", "callee", F.col("_p.rel_path").alias("rel_path"), F.col("_p.r_line").alias("line"), F.col("_p.r_id").alias("r_id"))


def edges_up(idx: Index, callees: DataFrame | None = None) -> DataFrame:
    """callee -> caller: the narrowest symbol around each ref of any kind is its caller; one row a ref.

    With `callees` (repo_id, at) only the refs to them are looked at.
    """
    refs = idx.refs
    if callees is not None:
        refs = refs.join(callees.select("repo_id", F.col("at").alias("name")).distinct(), ["repo_id", "name"], "left_semi")
    best = F.min(F.struct("s_span", "s_id", "s_name")).alias("_b")
    met = within(idx.symbols, refs).groupBy("r_id", "repo_id", "rel_path", "file_id", F.col("r_line").alias("line"), F.col("r_name").alias("callee")).agg(best)
    return met.withColumn("caller", F.col("_b.s_name")).filter("caller <> callee").drop("_b")


def _roots(idx: Index, names: list[str], table: str) -> DataFrame:
    return idx.pick(table, "name", names).select("repo_id", F.col("name").alias("root")).distinct().withColumn("at", F.col("root"))


def _walk(edges: Callable[[DataFrame], DataFrame], roots: DataFrame, here: str, there: str, depth: int) -> list[DataFrame]:
    """The edges met at each level from the names first reached on the level before.

    `edges` makes the edges out of a frontier, so that each level reads the tables once and keeps what the frontier needs.
    """
    # _ord is the chain of refs by which a name was first met, so rows can be put in the order of discovery.
    frontier = roots.withColumn("_ord", F.array().cast("array<bigint>"))
    seen, out = roots, []
    for level in range(1, depth + 1):
        met = frontier.join(edges(frontier).withColumnRenamed(here, "at"), ["repo_id", "at"])
        met = met.withColumns({"depth": F.lit(level), "_ord": F.concat("_ord", F.array("r_id"))})
        if level < depth:
            met = cut(met)
        out.append(met.withColumnRenamed("at", here))
        if level == depth:
            break
        new = met.groupBy("repo_id", "root", F.col(there).alias("at")).agg(F.min("_ord").alias("_ord"))
        frontier = cut(new.join(seen, ["repo_id", "root", "at"], "left_anti"))
        seen = seen.unionByName(frontier.drop("_ord"))
    return out


def _first(found: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in the order of discovery: by depth, then by the chain of refs that led there."""
    if limit:
        found = found.orderBy("depth", "_ord", "repo_id", "root", "caller", "callee").limit(limit)
    return found.drop("_ord")


def trace(idx: Index, names: list[str], depth: int = 3, kinds: tuple[str, ...] = ("call",), limit: int | None = None) -> DataFrame:
    """What the names call, down to `depth` (5 at most): all edges out of names nearer than that, each once with its least depth.

    With a limit, the first edges in the order of discovery, also within a level.
    """
    depth = min(max(depth, 1), 5)
    levels = _walk(lambda at: edges_down(idx, kinds, at), _roots(idx, names, "symbols"), "caller", "callee", depth)
    return _first(reduce(DataFrame.unionByName, levels).select("root", "repo_id", "caller", "callee", "rel_path", "line", "depth", "_ord"), limit)


def impact(idx: Index, names: list[str], depth: int = 2, limit: int | None = None) -> DataFrame:
    """Who uses the names, up to `depth` (5 at most): every (caller, file) once, with the first callee that reached it.

    With a limit, the first rows in the order of discovery, also within a level.
    """
    depth = min(max(depth, 1), 5)
    levels = _walk(lambda at: edges_up(idx, at), _roots(idx, names, "refs"), "callee", "caller", depth)
    first = F.min(F.struct("depth", "callee", "line", "r_id", "_ord")).alias("_f")
    met = reduce(DataFrame.unionByName, levels).groupBy("root", "repo_id", "caller", "rel_path").agg(first)
    met = met.select("root", "repo_id", F.col("_f.callee").alias("callee"), "caller", "rel_path", F.col("_f.line").alias("line"), F.col("_f.depth").alias("depth"), F.col("_f._ord").alias("_ord"))
    return _first(met, limit)


def attributed(hits: DataFrame) -> DataFrame:
    """The hits of several roots, one row for a call site with its least depth and the roots that hit it."""
    key = ["repo_id", "rel_path", "line", "caller"]
    return hits.groupBy(*key).agg(F.min("depth").alias("depth"), F.sort_array(F.collect_set("root")).alias("hit_symbols"))


# Import graph. `raw_path LIKE %x%` is an equi-join on the rarest piece of the pattern with the LIKE as residual.
def _pieces(text: Column, size: int) -> Column:
    """The distinct pieces of `size` characters; none of a text that is shorter."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def like_join(texts: DataFrame, text: str, patterns: DataFrame, piece: str) -> DataFrame:
    """Rows of `texts` and `patterns` of one repository where `text` holds `piece` in any ASCII case; `_` stands for any character.

    Of each pattern's pieces of three characters the one that the fewest texts of the repository have is the key, so
    what all paths of a folder have in common never joins; a pattern with a piece that no text has is dropped. Patterns
    without three characters in a row that are free of `_` and `%` use a piece of one character, and those without even
    that are compared with every text of their repository, as they match nearly all of them.
    """
    folded = ascii_lower(F.col(piece))
    like = F.concat(F.lit("%"), F.replace(folded, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    p = patterns.filter(F.col(piece) != "").withColumns({"_folded": folded, "_like": like})
    solid = lambda size: F.filter(_pieces(F.col("_folded"), size), lambda x: ~x.contains("_") & ~x.contains("%"))
    p = p.withColumns({"_p3": solid(3), "_p1": solid(1)})
    t = texts.withColumn("_low", ascii_lower(F.col(text)))
    out = None
    for size, of in ((3, p.filter(F.size("_p3") > 0)), (1, p.filter((F.size("_p3") == 0) & (F.size("_p1") > 0)))):
        words = of.select("repo_id", "_folded", F.explode(f"_p{size}").alias("_key")).distinct()
        cut_up = t.withColumn("_key", F.explode(_pieces(F.col("_low"), size)))
        counts = cut_up.groupBy("repo_id", "_key").agg(F.count(F.lit(1)).alias("_n"))
        rarest = words.join(counts, ["repo_id", "_key"], "left").groupBy("repo_id", "_folded")
        rarest = rarest.agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_key")).alias("_r")).filter("_r.n > 0").select("repo_id", "_folded", F.col("_r._key").alias("_key"))
        keyed = of.join(rarest, ["repo_id", "_folded"])
        found = cut_up.join(keyed, ["repo_id", "_key"]).filter("_low like _like").drop("_key")
        out = found if out is None else out.unionByName(found)
    every = t.join(p.filter(F.size("_p1") == 0), "repo_id").filter("_low like _like")
    return out.unionByName(every).drop("_low", "_like", "_folded", "_p1", "_p3")


def importers(idx: Index, names: list[str] = (), paths: list[str] = (), depth: int = 1) -> DataFrame:
    """Files that import the files in which the names are defined, or the paths, over up to 3 steps.

    A target is matched by its base name without extension anywhere in the import; a path also by itself at the end.
    Every importing file comes once, at its least depth, with the first target and import in order. Dot-files, whose
    base name is empty, match nothing.
    """
    depth = min(max(depth, 1), 3)
    places = idx.files.select("repo_id", "rel_path").distinct()
    starts = []
    if names:
        starts.append(idx.pick("symbols", "name", names).select("repo_id", F.col("rel_path").alias("target")).distinct())
    if paths:
        listed = F.explode(F.array(*[F.lit(p) for p in paths])).alias("target")
        starts.append(idx.files.select("repo_id").distinct().select("repo_id", listed))
    frontier = reduce(DataFrame.unionByName, starts).distinct()
    raw = idx.imports.select("repo_id", "raw_path").distinct()
    seen, out = None, None
    for level in range(1, depth + 1):
        pairs = like_join(raw, "raw_path", frontier.withColumn("_piece", stem(F.col("target"))), "_piece").select("repo_id", "raw_path", "target").distinct()
        if level == 1 and paths:
            ends = frontier.filter(F.col("target").isin(*paths)).withColumn("_piece", F.col("target"))
            tail = like_join(raw, "raw_path", ends, "_piece").filter(ascii_lower(F.col("raw_path")).endswith(ascii_lower(F.col("target"))))
            pairs = pairs.unionByName(tail.select("repo_id", "raw_path", "target")).distinct()
        first = F.min(F.struct("target", "raw_path")).alias("_f")
        met = idx.imports.join(pairs, ["repo_id", "raw_path"]).groupBy("repo_id", "rel_path").agg(first)
        met = met.select("repo_id", "rel_path", F.col("_f.raw_path").alias("import"), F.lit(level).alias("depth"), F.col("_f.target").alias("parent"))
        if seen is not None:
            met = met.join(seen, ["repo_id", "rel_path"], "left_anti")
        met = cut(met) if depth > 1 else met
        out = met if out is None else out.unionByName(met)
        frontier = met.select("repo_id", F.col("rel_path").alias("target"))
        seen = out.select("repo_id", "rel_path")
    return out.join(places, ["repo_id", "rel_path"], "left_semi")
