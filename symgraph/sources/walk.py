"""Walking a folder: a listing, what is left out of it, and its tree."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.functions.names import LARGE_FILE, is_generated, path_matches
from symgraph.sources.languages import SKIPPED, language_of

#: Nodes of a tree that the driver draws.
MOST_NODES = 100_000
_SCHEMA = "repo_id string, path string, rel_path string, language string, size long, mtime_ns long"


def repo_id(root: str) -> str:
    return hashlib.sha256(os.path.abspath(root).encode()).hexdigest()[:16]


def _entries(root: str, languages: set[str] | None) -> Iterator[tuple]:
    top = os.path.abspath(root)
    name = repo_id(top)
    for folder, folders, names in os.walk(top):
        folders[:] = sorted(d for d in folders if d not in SKIPPED and not d.startswith(".") and not os.path.islink(os.path.join(folder, d)))
        for base in sorted(names):
            lang, path = language_of(base), os.path.join(folder, base)
            if lang is None or (languages and lang not in languages) or os.path.islink(path):
                continue
            try:
                s = os.stat(path)
            except OSError:
                continue
            yield name, path, os.path.relpath(path, top).replace(os.sep, "/"), lang, s.st_size, s.st_mtime_ns


def listing(spark: SparkSession, root: str, languages: set[str] | None = None) -> DataFrame:
    """The files of known languages below a folder that the driver sees, in the order of their paths.

    Symbolic links, folders that begin with a dot and those in SKIPPED are left out.
    """
    return spark.createDataFrame(list(_entries(root, languages)), _SCHEMA).orderBy("rel_path")


def excluded(exclude: list[str] = (), generated: bool = False, large: bool = False):
    """The condition under which a file is left out: its globs, its size, or being generated."""
    out = path_matches(F.col("rel_path"), list(exclude))
    if not large:
        out = out | (F.col("size") > LARGE_FILE)
    return out if generated else out | is_generated(F.col("rel_path"))


def find_root(path: str) -> str | None:
    """The folder of the repository that holds a path: the nearest one above with `.git`."""
    at = os.path.abspath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above
    return at


def guarded(root: str, path: str) -> str:
    """The real place of a path below `root`; PermissionError if it leaves the folder, by links too, or is in `.git`."""
    top, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([top, real]) != top or ".git" in os.path.relpath(real, top).split(os.sep):
        raise PermissionError(f"{path} is not in the repository")
    return real


def with_content(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The listed files with their text, each read once by the executors from a folder that they share.

    Only listed paths are opened. A file that can't be read has null content.
    """
    columns = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # texts in memory at once
                part, texts = batch.slice(k, 64), []
                for path in part.column("path").to_pylist():
                    try:
                        with open(path, "rb") as f:
                            texts.append(f.read().decode("utf-8", "replace"))
                    except OSError:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*columns, "content"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.StringType())])
    return files.repartition(tasks).mapInArrow(read, schema)


def git_diff(spark: SparkSession, root: str, path: str, base: str = "HEAD") -> DataFrame:
    """The lines of the difference of one file to a commit, as git says it: pos, text. Run by the driver."""
    guarded(root, path)
    command = ["git", "-C", root, "diff", "--no-ext-diff", "--no-color", base, "--", path]
    text = subprocess.run(command, capture_output=True, text=True, check=True, errors="replace").stdout
    return spark.createDataFrame(list(enumerate(text.splitlines())), "pos int, text string")


def tree(files: DataFrame, depth: int = 0) -> DataFrame:
    """The folders and files of a listing: path, parent_path, name, depth, is_dir. A depth of 0 is all."""
    parts = F.split("rel_path", "/")
    each = files.select("repo_id", F.size(parts).alias("_n"), F.posexplode(parts).alias("_k", "name"), parts.alias("_p"))
    rows = each.select(
        "repo_id", F.array_join(F.slice("_p", F.lit(1), F.col("_k") + 1), "/").alias("path"), F.array_join(F.slice("_p", F.lit(1), F.col("_k")), "/").alias("parent_path"),
        "name", (F.col("_k") + 1).alias("depth"), (F.col("_k") + 1 < F.col("_n")).alias("is_dir"),
    ).distinct()
    return rows.filter(F.col("depth") <= depth) if depth else rows


def render_tree(rows: DataFrame) -> str:
    """The tree of one repository as text, for what a person can read; above MOST_NODES nodes ask for less depth."""
    below: dict[str, list] = {}
    found = rows.limit(MOST_NODES + 1).collect()
    if len(found) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    for r in sorted(found, key=lambda r: r.name.encode()):
        below.setdefault(r.parent_path, []).append(r)

    def lines(path: str, indent: str) -> Iterator[str]:
        rows = below.get(path, [])
        for k, r in enumerate(rows):
            last = k == len(rows) - 1
            yield f"{indent}{'└── ' if last else '├── '}{r.name}{'/' if r.is_dir else ''}"
            yield from lines(r.path, indent + ("    " if last else "│   "))

    return "\n".join(lines("", "")) + "\n"
