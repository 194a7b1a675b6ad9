"""The life cycle of a stored index: walk, extract what changed, replace, prune, and commit as one version."""

from __future__ import annotations

import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators.incremental import CommitLog
from symgraph.sources import extract, walk
from symgraph.sources.index import Index
from symgraph.streaming.refresh import changed_files, merged_rows, stale_files

TABLES = ("files", "symbols", "refs", "imports")
_FILES = "file_id long, repo_id string, path string, rel_path string, language string, hash string, indexed_at timestamp, mtime_ns long, size long"


@dataclass(frozen=True)
class Options:
    """What is left out of an index; kept with it and used again by later refreshes."""

    exclude: tuple[str, ...] = ()
    include_generated: bool = False
    include_large_files: bool = False


class Store:
    """Indexes of folders at a path that all executors share. Every refresh commits a whole version or nothing.

    A version names its tables, its options and its values (meta); readers open the last one. Of two refreshes at once
    one wins. Old versions stay until `vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def meta(self, key: str, default=None):
        """A value kept with the index."""
        return self.log.last()[1].get("meta", {}).get(key, default)

    def set_meta(self, key: str, value) -> bool:
        """Sets a value in a version that is otherwise the same; False if another change came first."""
        number, entry = self.log.last()
        entry = {k: v for k, v in entry.items() if k != "folders"}
        return self.log.commit(number + 1, entry | {"meta": entry.get("meta", {}) | {key: value}}, self.log.last()[1].get("folders", []))

    def options(self) -> Options:
        kept = self.log.last()[1].get("options", {})
        return Options(**(kept | {"exclude": tuple(kept.get("exclude", ()))}))

    def table(self, name: str) -> DataFrame | None:
        data = self.log.last()[1].get("data")
        return self.spark.read.parquet(f"{data}/{name}") if data else None

    def index(self) -> Index:
        """The last version; an error if there is none."""
        found = [self.table(t) for t in TABLES]
        if found[0] is None:
            raise LookupError("nothing is indexed here")
        return Index.of(*found)

    def repositories(self) -> DataFrame:
        """Each repository with its root, files and symbols; those without a root are left out."""
        idx = self.index()
        roots = self.meta("roots", {})
        named = self.spark.createDataFrame(list(roots.items()), "repo_id string, root string").filter("root <> ''")
        symbols = idx.symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_symbols"))
        files = idx.files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"))
        out = named.join(files, "repo_id").join(symbols, "repo_id", "left")
        return out.select("repo_id", "root", "n_files", F.coalesce("n_symbols", F.lit(0).cast("long")).alias("n_symbols"))

    def refresh(self, root: str, options: Options | None = None, force: bool = False) -> dict:
        """Brings the index of a folder up to date and says what was done.

        Files with the same path, mtime_ns and size as stored are not read (unless `force`). Rows of changed files are
        replaced, those of files that are gone or newly left out are dropped. Options that are given are kept for later
        refreshes. A file that can't be read or parsed is counted and keeps no rows. Other repositories stay as they are.
        """
        number, entry = self.log.last()
        options = options or self.options()
        home = walk.repo_id(root)
        listed = walk.listing(self.spark, root)
        out = walk.excluded(list(options.exclude), options.include_generated, options.include_large_files)
        left_out = listed.filter(out).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
        listed = listed.filter(~out)
        before = self.table("files") if entry.get("data") else self.spark.createDataFrame([], _FILES)
        own = before.filter(F.col("repo_id") == home)
        changed = changed_files(listed, own, force).withColumn("file_id", F.xxhash64("repo_id", "rel_path"))
        gone = stale_files(listed, own)
        n_changed, n_listed, n_gone = changed.count(), listed.count(), gone.count()
        if entry.get("data") and not n_changed and not n_gone and options == self.options():
            none = dict.fromkeys(("files_indexed", "files_unsup", "parse_errors", "symbols_found", "stale_removed"), 0)
            return none | {"files_skipped": n_listed, "files_excluded": left_out["n"], "bytes_excluded": left_out["b"]}
        folder = f"{self.log.path}/data/{number + 1:012d}-{uuid.uuid4().hex}"
        texts = walk.with_content(self.spark, changed)
        extract.parsed(texts).write.parquet(f"{folder}/rows")
        rows = self.spark.read.parquet(f"{folder}/rows")
        changed = changed.select("file_id", "repo_id", "path", "rel_path", "language", "mtime_ns", "size")
        hashes = rows.groupBy("file_id").agg(F.max("hash").alias("hash"))
        fresh = changed.join(hashes, "file_id", "left").select(
            "file_id", "repo_id", "path", "rel_path", "language", F.coalesce("hash", F.lit("")).alias("hash"), F.current_timestamp().alias("indexed_at"), "mtime_ns", "size"
        )
        new = dict(zip(TABLES, (fresh, *extract.tables(rows)), strict=True))
        ids = changed.select("file_id")
        for name in TABLES:
            old = self.table(name) if entry.get("data") else new[name].limit(0)
            replaced = merged_rows(old, new[name], gone.select("file_id").union(ids))
            replaced.write.parquet(f"{folder}/{name}")
        failed = rows.filter("tag = 'error'").select("file_id").distinct()
        done = rows.agg(F.count_if(F.col("tag") == "symbol").alias("symbols"), F.count_distinct("file_id").alias("files")).first()
        stats = {
            "files_indexed": done["files"], "files_skipped": n_listed - n_changed, "files_unsup": n_changed - done["files"], "files_excluded": left_out["n"], "bytes_excluded": left_out["b"],
            "parse_errors": failed.count(), "symbols_found": done["symbols"], "stale_removed": n_gone,
        }
        meta = entry.get("meta", {})
        meta = meta | {"roots": meta.get("roots", {}) | {home: os.path.abspath(root)}}
        if not self.log.commit(number + 1, {"low": None, "upto": None, "data": folder, "options": asdict(options), "meta": meta}, [folder]):
            raise RuntimeError("another refresh came first")
        return stats

    def fresh(self, path: str) -> Index:
        """The index of the repository that holds `path`, refreshed before use; made if there is none.

        A refresh that fails is passed over if there is an older version: a stale answer beats none.
        """
        root = walk.find_root(path) or path
        try:
            self.refresh(root)
        except Exception:
            if not self.log.last()[1].get("data"):
                raise
        return self.index()

    def vacuum(self) -> int:
        """Removes the folders that the last version does not name; how many."""
        fs, path = self.log._fs, self.log._path
        data = self.log.last()[1].get("data", "")
        folder = path(f"{self.log.path}/data")
        old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() != data.rsplit("/", 1)[-1]] if fs.exists(folder) else []
        for p in old:
            fs.delete(p, True)
        return len(old)
