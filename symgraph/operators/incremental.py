"""Processing only what is new or changed: pending entries, and slices committed together with their watermark."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """A path without its leading `./`."""
    return F.when(path.startswith("./"), path.substr(F.lit(3), F.length(path))).otherwise(path)


def last_sights(walk: DataFrame) -> DataFrame:
    """The last sight of every path: by seen_at, then entry_id. Repeats fall together.

    Null seen_at sorts first. Null keys are keys of their own.
    """
    seen = walk.select("entry_id", "repo_id", clean_path(F.col("rel_path")).alias("rel_path"), "mtime_ns", "size", "hash", "seen_at")
    last = F.max(F.struct("seen_at", "entry_id", "mtime_ns", "size", "hash")).alias("_last")
    return seen.groupBy("repo_id", "rel_path").agg(last).select("repo_id", "rel_path", "_last.*")


def committed_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest row of every (repo_id, rel_path) that a successful run committed.

    A row is committed if its indexed_at lies within a run of its repository whose status is ok in any letter case.
    Runs are cut into days, so the equi-join is on (repo_id, day) and a repository that holds a third of all rows
    spreads over its days. Runs without an end commit nothing.
    """
    ok = (
        runs.filter(F.lower("status") == "ok")
        .filter(F.col("started_at") <= F.col("finished_at"))
        .select("repo_id", "started_at", "finished_at")
        .distinct()
        .withColumn("_day", F.explode(F.sequence(F.to_date("started_at"), F.to_date("finished_at"))))
    )
    stored = files.select("repo_id", "rel_path", "hash", "mtime_ns", "size", "indexed_at", F.to_date("indexed_at").alias("_day"))
    within = F.col("f.indexed_at").between(F.col("r.started_at"), F.col("r.finished_at"))
    same = (F.col("f.repo_id") == F.col("r.repo_id")) & (F.col("f._day") == F.col("r._day"))
    kept = stored.alias("f").join(ok.alias("r"), same & within, "left_semi")
    last = F.max(F.struct("indexed_at", "hash", "mtime_ns", "size")).alias("_last")
    return kept.groupBy("repo_id", "rel_path").agg(last).select("repo_id", "rel_path", "_last.*")


def _compared(last: DataFrame, stored: DataFrame) -> DataFrame:
    """Of the last sights those that differ from what is stored: entry_id, repo_id, rel_path and the reason `why`."""
    w, f = last.alias("w"), stored.alias("f")
    same = F.col("w.repo_id").eqNullSafe(F.col("f.repo_id")) & F.col("w.rel_path").eqNullSafe(F.col("f.rel_path"))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    hashed = has("w.hash") & has("f.hash")
    stat = (F.coalesce("w.mtime_ns", F.lit(0)) != F.coalesce("f.mtime_ns", F.lit(0))) | ~F.col("w.size").eqNullSafe(F.col("f.size"))
    why = (
        F.when(F.col("f.indexed_at").isNull(), "new")
        .when(hashed & (F.col("w.hash") != F.col("f.hash")), "bytes")
        .when(~hashed & stat, "stat")
    )
    return w.join(f, same, "left").select("w.entry_id", "w.repo_id", "w.rel_path", why.alias("why")).filter("why is not null")


def pending_entries(walk: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """The entries pending at this moment, without a log, with the reason: new, bytes or stat.

    Entries compare by hash where both sides have one, else by mtime_ns (null is 0) and size. Rows of null entry_id have
    no place in the sequence and are left out. Empty tables: without files everything is new, without entries nothing.
    """
    return _compared(last_sights(walk.filter("entry_id is not null")), committed_files(files, runs))


class Slice(NamedTuple):
    """What one run processes: the rows above the watermark `low` up to the limit `upto`, and the folder for its output."""

    number: int
    low: int | None
    upto: int
    rows: DataFrame
    out: str


class CommitLog:
    """Slices of a monotonic sequence, each committed atomically with its watermark.

    A run reads the last commit for its low watermark, fixes the highest sequence number at its start as upper limit,
    writes the output of exactly that slice to a folder of its own, and then creates the next numbered commit file,
    which names both the folder and the new watermark. The file is made complete under another name and renamed to its
    number, which fails if the number exists; so of two runs one wins, a run that dies before leaves an orphan folder
    that no reader sees, and no record is skipped or repeated.

    The rename must be exclusive, as on HDFS and local file systems; object stores that copy and overwrite are not safe.
    A commit names all folders in force, so readers open one file; `compact` writes them anew as one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _entry(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/commits/{name}"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """(number of the last commit, what it says), (0, nothing) before the first."""
        names = self._commits()
        return (int(names[-1][:-5]), self._entry(names[-1])) if names else (0, {})

    def watermark(self) -> tuple[int, int | None]:
        """(number of the last commit, highest committed sequence number), (0, None) before the first."""
        number, entry = self.last()
        return number, entry.get("upto")

    def slice(self, source: DataFrame, seq: str) -> Slice | None:
        """The rows to be processed now, None if there are none. Only what is above the watermark is scanned.

        The limit is a number before any plan is made, so rows that arrive during the run belong to the next one. Rows
        without a sequence number can't be placed in the sequence and are refused by an error.
        """
        number, low = self.watermark()
        new = source if low is None else source.filter((F.col(seq) > low) | F.col(seq).isNull())
        top = new.agg(F.max(seq).alias("upto"), F.count_if(F.col(seq).isNull()).alias("bad")).first()
        if top["bad"]:
            raise ValueError(f"{top['bad']} rows without {seq}")
        if top["upto"] is None:
            return None
        part = source.filter(F.col(seq) <= top["upto"])
        if low is not None:
            part = part.filter(F.col(seq) > low)
        return Slice(number + 1, low, top["upto"], part, f"{self.path}/data/{number + 1:012d}-{uuid.uuid4().hex}")

    def finish(self, part: Slice) -> dict | None:
        """Commits the slice's folder with its watermark; None if another run won."""
        entry = {"low": part.low, "upto": part.upto, "data": part.out}
        return entry if self.commit(part.number, entry) else None

    def run(self, source: DataFrame, seq: str, step: Callable[[DataFrame], DataFrame]) -> dict | None:
        """Processes what is new in `source` with `step`; the commit, or None if nothing is new or another run won."""
        part = self.slice(source, seq)
        if part is None:
            return None
        step(part.rows).write.parquet(part.out)
        return self.finish(part)

    def commit(self, number: int, entry: dict, folders: list[str] | None = None) -> bool:
        if folders is None:
            folders = [*self.last()[1].get("folders", []), entry["data"]]
        target = self._path(f"{self.path}/commits/{number:012d}.json")
        half = self._path(f"{self.path}/commits/.{number:012d}-{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(half, False)
        stream.write(bytearray(json.dumps(entry | {"folders": folders}).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(half, target):
            self._fs.delete(half, False)
            return False
        return True

    def read(self, part: str = "") -> DataFrame | None:
        """All committed output, or its `part`, a folder below each output. None before the first commit."""
        folders = self.last()[1].get("folders", [])
        return self.spark.read.parquet(*[f"{f}/{part}".rstrip("/") for f in folders]) if folders else None

    def compact(self, parts: tuple[str, ...] = ("",)) -> bool:
        """Writes all committed output as one folder and commits it under the same watermark; False if a run came first."""
        number, entry = self.last()
        if len(entry.get("folders", [])) < 2:
            return True
        out = f"{self.path}/data/{number + 1:012d}-{uuid.uuid4().hex}"
        for part in parts:
            self.read(part).write.parquet(f"{out}/{part}".rstrip("/"))
        return self.commit(number + 1, {"low": entry["low"], "upto": entry["upto"], "data": out}, [out])


def process_pending(log: CommitLog, walk: DataFrame, files: DataFrame, runs: DataFrame) -> dict | None:
    """One run over what is new in `walk`: the commit, or None if nothing is new or another run won.

    The run takes the entries above the committed watermark up to the limit fixed at its start. The last sights of their
    paths (part `sights`) and those of them that must be processed (part `pending`, with the reason and the number `run`)
    are written, and come into force together with the new watermark. A late entry that is older than a sight committed
    earlier is no last sight, so it is not pending. Only earlier sights of the slice's own paths are looked up.

    Rows of null entry_id have no place in the sequence and are left out. Repeats fall together.
    """
    part = log.slice(walk.filter("entry_id is not null"), "entry_id")
    if part is None:
        return None
    last = last_sights(part.rows)
    earlier = log.read("sights")
    if earlier is not None:
        a, b = earlier.alias("a"), last.alias("b")
        same = F.col("a.repo_id").eqNullSafe(F.col("b.repo_id")) & F.col("a.rel_path").eqNullSafe(F.col("b.rel_path"))
        last = last_sights(last.unionByName(a.join(b, same, "left_semi"))).filter(F.col("entry_id") > part.low)
    last.write.parquet(f"{part.out}/sights")
    sights = log.spark.read.parquet(f"{part.out}/sights")
    found = _compared(sights, committed_files(files, runs))
    found.withColumn("run", F.lit(part.number).cast("long")).write.parquet(f"{part.out}/pending")
    return log.finish(part)


def pending_of(log: CommitLog) -> DataFrame:
    """The pending entries of all committed runs: entry_id, repo_id, rel_path, why, run; none before the first commit."""
    done = log.read("pending")
    return done if done is not None else log.spark.createDataFrame([], "entry_id long, repo_id string, rel_path string, why string, run long")
