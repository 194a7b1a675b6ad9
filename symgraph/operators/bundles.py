"""Bundles: what one wants to know of a symbol, as a dict of DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from symgraph.functions.names import INVESTIGATE_TYPES, TRUNCATE_TYPES
from symgraph.operators.lookup import children, file_imports, implementors, implements, references, type_refs
from symgraph.operators.search import exact_search, flex_search, lines_of
from symgraph.operators.traverse import impact
from symgraph.sources.index import Index

SOURCE_LINES = 60


class Ambiguous(LookupError):
    """More than one symbol fits; `candidates` are the likeliest."""

    def __init__(self, name: str, candidates: list[Row]):
        super().__init__(f"{name}: {len(candidates)} symbols")
        self.candidates = candidates


def resolve(idx: Index, text: str) -> list[Row]:
    """The candidates for `file:Symbol`, `Parent.Child` or a name, the likeliest first (100 at most).

    Exact names come before loose ones. A file or parent that fits none of the candidates is ignored.
    """
    path, _, name = text.rpartition(":")
    parent, dot, child = name.partition(".")
    name, parent = (child, parent) if dot and child else (name, "")
    found = exact_search(idx, [name], limit=100).collect() or flex_search(idx, name, 20).collect()
    if path:
        found = [r for r in found if r.rel_path.endswith(path) or path in r.rel_path] or found
    if parent and len(found) > 1:
        found = [r for r in found if r.parent.lower() == parent.lower() or parent in r.rel_path] or found
    return found


def source_of(idx: Index, contents: DataFrame, symbol: Row, context: int = 0, most: int | None = None) -> DataFrame:
    """The lines of a symbol, with `context` lines around; of at most `most` lines, the rest is named in one more."""
    place = idx.files.filter((F.col("repo_id") == symbol.repo_id) & (F.col("rel_path") == symbol.rel_path)).select("file_id")
    first, last = max(1, symbol.start_line - context), symbol.end_line + context
    lines = lines_of(contents.join(F.broadcast(place), "file_id")).filter(F.col("line").between(first, last)).select("line", "content")
    if most is None or last - first < most:
        return lines.orderBy("line")
    more = lines.sparkSession.createDataFrame([(first + most, f"... ({last - first + 1 - most} more lines)")], "line int, content string")
    return lines.filter(F.col("line") < first + most).unionByName(more).orderBy("line")


def context_of(idx: Index, contents: DataFrame, name: str, callers: int = 20) -> dict[str, DataFrame]:
    """The likeliest definition with its source, the types it names, its callers, the imports of its file and what conforms."""
    found = resolve(idx, name)
    if not found:
        raise LookupError(f"symbol not found: {name}")
    best, spark = found[0], idx.symbols.sparkSession
    own = idx.symbols.filter(F.col("repo_id") == best.repo_id)
    local = Index(idx.files.filter(F.col("repo_id") == best.repo_id), own, idx.refs.filter(F.col("repo_id") == best.repo_id), idx.imports.filter(F.col("repo_id") == best.repo_id))
    out = {
        "symbol": spark.createDataFrame([best]),
        "matches": exact_search(idx, [best.name], limit=100),
        "source": source_of(idx, contents, best),
        "type_refs": type_refs(local, best.rel_path, best.start_line, best.end_line),
        "callers": references(local, [best.name], limit=callers),
        "file_imports": file_imports(local, best.rel_path),
    }
    if best.kind in INVESTIGATE_TYPES:
        out |= {"implementors": implementors(local, [best.name], 20), "implements": implements(local, [best.name], 20)}
    return out


def investigate(idx: Index, contents: DataFrame, name: str) -> dict[str, DataFrame]:
    """What matters of a symbol by its kind: uses and impact of a function, members and conformance of a type, uses of the rest."""
    found = resolve(idx, name)
    if not found:
        raise LookupError(f"symbol not found: {name}")
    if len(found) > 1:
        raise Ambiguous(name, found)
    best = found[0]
    local = Index(*(t.filter(F.col("repo_id") == best.repo_id) for t in (idx.files, idx.symbols, idx.refs, idx.imports)))
    most = SOURCE_LINES if best.kind in TRUNCATE_TYPES else None
    out = {"symbol": idx.symbols.sparkSession.createDataFrame([best]), "source": source_of(idx, contents, best, most=most), "refs": references(local, [best.name], limit=20)}
    if best.kind in ("function", "method"):
        out["impact"] = impact(local, [best.name], 2).orderBy("depth", "rel_path", "line").limit(20)
    elif best.kind in INVESTIGATE_TYPES:
        out |= {"members": children(local, best.name, 50, best.rel_path), "implementors": implementors(local, [best.name], 20), "implements": implements(local, [best.name], 20)}
    return out


def with_context(hits: DataFrame, contents: DataFrame, around: int) -> DataFrame:
    """Each hit (file_id, line) with its line and the lines around it, cut at the ends of the file."""
    near = hits.select("file_id", "line").distinct().withColumn("_at", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)))
    texts = lines_of(contents.join(hits.select("file_id").distinct(), "file_id", "left_semi")).select("file_id", F.col("line").alias("_at"), F.rtrim("content").alias("content"))
    pairs = near.join(texts, ["file_id", "_at"]).groupBy("file_id", "line").agg(F.sort_array(F.collect_list(F.struct("_at", "content"))).alias("_c"))
    return hits.join(pairs, ["file_id", "line"], "left").withColumn("context", F.col("_c.content")).drop("_c")


def hunks_in(diff: DataFrame, first: int, last: int) -> DataFrame:
    """The lines of a unified diff (pos, text) in hunks whose new range meets [first, last], after its headers.

    A hunk of no new lines is a point. The number of a hunk is the running count of its headers.
    """
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    order = Window.orderBy("pos")  # the diff of one file
    rows = diff.withColumn("hunk", F.sum(F.col("text").rlike(header).cast("int")).over(order))
    start, size = F.regexp_extract("text", header, 1), F.regexp_extract("text", header, 2)
    ranges = rows.filter(F.col("text").rlike(header)).select("hunk", start.cast("int").alias("_a"), F.when(size == "", 1).otherwise(size.cast("int")).alias("_n"))
    meets = ranges.filter((F.col("_a") <= last) & (F.greatest(F.col("_a"), F.col("_a") + F.col("_n") - 1) >= first)).select("hunk")
    kept = rows.join(meets, "hunk", "left_semi")
    heads = rows.filter("hunk = 0")
    any_kept = kept.limit(1).select(F.lit(True).alias("_any"))
    return heads.join(any_kept, F.lit(True), "left_semi").unionByName(kept).orderBy("pos")


def diff_of(idx: Index, diff: DataFrame, name: str) -> DataFrame:
    """The hunks of a file's diff (pos, text) that meet the definition of a name. The name must be unique."""
    found = resolve(idx, name)
    if not found:
        raise LookupError(f"symbol not found: {name}")
    if len(found) > 1:
        raise Ambiguous(name, found)
    return hunks_in(diff, found[0].start_line, found[0].end_line)


def diff_stat(hunks: DataFrame) -> DataFrame:
    """Added and removed lines of hunks, one row."""
    body = lambda mark, head: F.count_if(F.col("text").startswith(mark) & ~F.col("text").startswith(head))
    return hunks.agg(body("+", "+++ ").alias("added"), body("-", "--- ").alias("removed"))


def parse_range(text: str) -> tuple[str, int, int] | None:
    """`path:10-20`, `path:10`, `path:L10-L20` as (path, first, last)."""
    m = re.fullmatch(r"(.+):L?(\d+)(?:-L?(\d+))?", text)
    return (m[1], int(m[2]), int(m[3] or m[2])) if m else None
