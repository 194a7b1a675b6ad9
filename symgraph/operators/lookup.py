"""Lookups: outlines, references, enclosing symbols, implementors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.names import TYPE_ENCLOSERS, TYPE_REFS, TYPE_TARGETS, path_allowed, symbol_id
from symgraph.sources.index import Index

#: Lines a bin of the interval join.
BIN = 64
_RESULT = ["name", "kind", "repo_id", "rel_path", "start_line", "end_line", "parent", "depth", "signature", "language"]


def outline(idx: Index, rel_path: str, repo_id: str = "") -> DataFrame:
    found = idx.symbols.filter(F.col("rel_path") == rel_path)
    if repo_id:
        found = found.filter(F.col("repo_id") == repo_id)
    return found.select("id", *_RESULT).orderBy("repo_id", "start_line", "id")


def children(idx: Index, parent: str, limit: int | None = 50, rel_path: str = "") -> DataFrame:
    """Members by the name of their parent; `rel_path` keeps namesakes apart."""
    found = idx.pick("symbols", "parent", [parent])
    if rel_path:
        found = found.filter(F.col("rel_path") == rel_path)
    found = found.select("id", *_RESULT).orderBy("repo_id", "rel_path", "start_line", "id")
    return found.limit(limit) if limit else found


def references(idx: Index, names: list[str], kinds: list[str] = (), limit: int | None = None) -> DataFrame:
    found = idx.pick("refs", "name", names)
    if kinds:
        found = found.filter(F.col("kind").isin(*kinds))
    found = found.select("id", "name", "kind", "repo_id", "rel_path", "line").orderBy("repo_id", "rel_path", "line", "id")
    return found.limit(limit) if limit else found


def file_list(idx: Index, language: str = "") -> DataFrame:
    found = idx.files.filter(F.lower(F.trim("language")) == language) if language else idx.files
    return found.select("file_id", "repo_id", "rel_path", "language", "size").orderBy("repo_id", "rel_path")


def file_imports(idx: Index, rel_path: str) -> DataFrame:
    return idx.imports.filter(F.col("rel_path") == rel_path).select("id", "repo_id", "raw_path").orderBy("repo_id", "raw_path", "id")


def within(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Every (symbol, ref) of one file with the ref's line in the symbol's range.

    Symbols are cut into bins of BIN lines, so the join is on (file, bin) and a file with very many lines and refs
    spreads over its bins. Columns of symbols have the prefix s_, of refs r_; s_span is the length.
    """
    first, last = F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN)
    s = symbols.filter("start_line <= end_line").select(
        F.col("file_id"), F.col("id").alias("s_id"), F.col("name").alias("s_name"), F.col("kind").alias("s_kind"), F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"),
        (F.col("end_line") - F.col("start_line")).alias("s_span"), F.explode(F.sequence(first, last)).alias("_bin"),
    )
    r = refs.select(
        "file_id", "repo_id", "rel_path", F.col("id").alias("r_id"), F.col("line").alias("r_line"), F.col("name").alias("r_name"), F.col("kind").alias("r_kind"),
        F.floor(F.col("line") / BIN).alias("_bin"),
    )
    return r.join(s, ["file_id", "_bin"]).filter("r_line between s_start and s_end").drop("_bin")


def enclosing(idx: Index, kinds: tuple[str, ...] = (), refs: DataFrame | None = None) -> DataFrame:
    """The narrowest symbol around each ref, the lowest id among equals: r_id, encloser."""
    symbols = idx.symbols.filter(F.col("kind").isin(*kinds)) if kinds else idx.symbols
    best = F.min(F.struct("s_span", "s_id", "s_name")).alias("_b")
    return within(symbols, idx.refs if refs is None else refs).groupBy("r_id").agg(best).select("r_id", F.col("_b.s_name").alias("encloser"))


def _targets(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("kind").isin(*TYPE_TARGETS)).select("repo_id", "name").distinct().withColumn("resolved", F.lit(True))


def implementors(idx: Index, names: list[str], limit: int | None = None) -> DataFrame:
    """Who implements the names: one row for each implements-ref, with the narrowest type around it, if any."""
    refs = idx.pick("refs", "name", names).filter(F.col("kind") == "implements")
    known = _targets(idx.pick("symbols", "name", names))
    around = enclosing(idx, TYPE_ENCLOSERS, refs)
    found = refs.join(around, refs["id"] == around["r_id"], "left").join(known, ["repo_id", "name"], "left")
    found = found.select(
        "id", F.coalesce("encloser", F.lit("")).alias("implementer"), F.col("name").alias("target"), "repo_id", "rel_path", "line", "language",
        F.coalesce("resolved", F.lit(False)).alias("resolved"),
    ).orderBy("repo_id", "rel_path", "line", "id")
    return found.limit(limit) if limit else found


def implements(idx: Index, names: list[str], limit: int | None = None) -> DataFrame:
    """What types of the names implement: the implements-refs for which such a type is the narrowest around."""
    refs = idx.pick("refs", "kind", ["implements"])
    mine = idx.symbols.filter(F.col("kind").isin(*TYPE_ENCLOSERS))
    files = idx.pick("symbols", "name", names).filter(F.col("kind").isin(*TYPE_ENCLOSERS)).select("file_id").distinct()
    pairs = within(mine.join(files, "file_id", "left_semi"), refs.join(files, "file_id", "left_semi"))
    narrow = pairs.groupBy("r_id").agg(F.min("s_span").alias("_least"))
    found = pairs.join(narrow, "r_id").filter((F.col("s_span") == F.col("_least")) & F.col("s_name").isin(*names))
    found = found.select("r_id", "s_name", "r_name", "repo_id", "rel_path", "r_line").distinct()
    found = found.join(_targets(idx.symbols).withColumnRenamed("name", "r_name"), ["repo_id", "r_name"], "left")
    found = found.select(
        F.col("r_id").alias("id"), F.col("s_name").alias("implementer"), F.col("r_name").alias("target"), "repo_id", "rel_path", F.col("r_line").alias("line"),
        F.coalesce("resolved", F.lit(False)).alias("resolved"),
    ).orderBy("repo_id", "rel_path", "line", "id", "implementer")
    return found.limit(limit) if limit else found


def narrowed(
    found: DataFrame, language: str = "", resolved: bool | None = None, include: list[str] = (), exclude: list[str] = (), limit: int | None = None
) -> DataFrame:
    """Rows of `implementors` or `implements` of one language, of targets that are known or not, and of some paths.

    The limit comes last, so filters never leave fewer rows than there are.
    """
    if language:
        found = found.filter(F.col("language") == language)
    if resolved is not None:
        found = found.filter(F.col("resolved") == resolved)
    found = found.filter(path_allowed(F.col("rel_path"), list(include), list(exclude)))
    order = [c for c in ("repo_id", "rel_path", "line", "id", "implementer") if c in found.columns]
    return found.orderBy(*order).limit(limit) if limit else found


def outline_names(idx: Index, rel_path: str, repo_id: str = "") -> DataFrame:
    """The names of a file's symbols, each once, in the order of their first line."""
    rows = outline(idx, rel_path, repo_id).groupBy("repo_id", "name").agg(F.min(F.struct("start_line", "id")).alias("_at"))
    return rows.orderBy("repo_id", "_at").select("repo_id", "name")


def type_refs(idx: Index, rel_path: str, first: int, last: int) -> DataFrame:
    """The types named between two lines of a file, each definition of the repository once."""
    names = idx.refs.filter((F.col("rel_path") == rel_path) & F.col("line").between(first, last)).select("repo_id", "name").distinct()
    found = idx.symbols.filter(F.col("kind").isin(*TYPE_REFS)).join(names, ["repo_id", "name"])
    return found.withColumn("symbol_id", symbol_id()).groupBy("repo_id", "symbol_id").agg(F.min("id").alias("id"))


def deduped_lines(refs: DataFrame, contents: DataFrame) -> DataFrame:
    """Refs with the text of their line, equal texts of a file together: rel_path, text, lines, n."""
    from symgraph.operators.search import lines_of

    texts = lines_of(contents.join(refs.select("file_id").distinct(), "file_id", "left_semi"))
    each = refs.select("repo_id", "rel_path", "file_id", "line").distinct().join(texts, ["file_id", "line"])
    grouped = each.groupBy("repo_id", "rel_path", F.trim("content").alias("text"))
    return grouped.agg(F.sort_array(F.collect_set("line")).alias("lines"), F.count(F.lit(1)).alias("n"))
