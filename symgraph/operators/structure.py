"""Overviews: counts, entry points, most referenced symbols, most imported files, largest packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.names import ascii_lower, package_key
from symgraph.operators.traverse import like_join
from symgraph.sources.index import Index


def language_counts(idx: Index) -> DataFrame:
    return idx.files.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n_files"))


def repo_stats(idx: Index) -> DataFrame:
    """A row for each repository: files, symbols and the number of languages."""
    symbols = idx.symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    files = idx.files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("language").alias("n_languages"))
    return files.join(symbols, "repo_id", "left").select("repo_id", "n_files", F.coalesce("n_symbols", F.lit(0).cast("long")).alias("n_symbols"), "n_languages")


def entry_points(idx: Index) -> DataFrame:
    named = F.col("name").isin("main", "init", "Main", "Init")
    capital = F.col("name").rlike("^[A-Z]") & (F.col("kind") == "function") & ascii_lower(F.col("rel_path")).contains("main")
    top = idx.symbols.filter((F.col("depth") == 0) & F.col("kind").isin("function", "method") & (named | capital))
    return top.select("id", "repo_id", "name", "kind", "rel_path", "start_line")


def top_by_refs(idx: Index) -> DataFrame:
    """Refs to each (name, file) that defines the name at the top: refs of the name times its definitions there.

    Both sides are counted before they meet, so a hot name never fans out.
    """
    refs = idx.refs.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("_r"))
    first = F.min(F.struct("id", "kind", "start_line")).alias("_f")
    own = idx.symbols.filter("depth = 0").groupBy("repo_id", "name", "rel_path").agg(F.count(F.lit(1)).alias("_d"), first)
    return own.join(refs, ["repo_id", "name"]).select(
        "repo_id", "name", "rel_path", (F.col("_r") * F.col("_d")).alias("n_refs"), F.col("_f.kind").alias("kind"), F.col("_f.start_line").alias("start_line")
    )


def import_fan_in(idx: Index) -> DataFrame:
    """Files that more than one other file imports by their dotted path (with or without .go or .py)."""
    dotted = F.replace("rel_path", F.lit("/"), F.lit("."))
    forms = F.array_distinct(F.array(dotted, F.replace(dotted, F.lit(".go"), F.lit("")), F.replace(dotted, F.lit(".py"), F.lit(""))))
    patterns = idx.files.select("repo_id", "rel_path", F.explode(forms).alias("_piece"))
    raw = idx.imports.select("repo_id", "raw_path").distinct()
    pairs = like_join(raw, "raw_path", patterns, "_piece").select("repo_id", "raw_path", "rel_path").distinct()
    by = idx.imports.select("repo_id", "raw_path", "file_id").distinct()
    return by.join(pairs, ["repo_id", "raw_path"]).groupBy("repo_id", "rel_path").agg(F.countDistinct("file_id").alias("n_files")).filter("n_files > 1")


def top_packages(idx: Index) -> DataFrame:
    rows = idx.symbols.select("repo_id", package_key(F.col("rel_path")).alias("package"), "id", "file_id")
    return rows.groupBy("repo_id", "package").agg(F.countDistinct("id").alias("n_symbols"), F.countDistinct("file_id").alias("n_files"))


def structure(idx: Index, limit: int = 10) -> dict[str, DataFrame]:
    """The overview of all repositories, `limit` rows of each list in a total order."""
    return {
        "stats": repo_stats(idx),
        "languages": language_counts(idx),
        "entry_points": entry_points(idx).orderBy("name", "repo_id", "rel_path", "id").limit(limit),
        "top_by_refs": top_by_refs(idx).orderBy(F.desc("n_refs"), "name", "repo_id", "rel_path").limit(limit),
        "top_by_import_fan": import_fan_in(idx).orderBy(F.desc("n_files"), "repo_id", "rel_path").limit(limit),
        "top_packages": top_packages(idx).orderBy(F.desc("n_symbols"), "repo_id", "package").limit(limit),
    }
