"""Queries of the general problems (2 and 5) with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators.incremental import CommitLog, pending_of, process_pending
from symgraph.operators.skew import heavy_values, imbalance
from symgraph.session import load, shared_dir

FIELDS = (("refs.name", "refs", "name"), ("imports.raw_path", "imports", "raw_path"))


def _values(spark: SparkSession, base: str) -> DataFrame:
    parts = [imbalance(load(spark, base, t), c, "file_id").select(F.lit(f).alias("field"), "*") for f, t, c in FIELDS]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    parts = [heavy_values(load(spark, base, t), c).select(F.lit(f).alias("field"), "val") for f, t, c in FIELDS]
    return parts[0].unionByName(parts[1])


def p2_values(spark: SparkSession, base: str) -> DataFrame:
    return _values(spark, base).select("field", "val", "n_rows", "n_members", "hot")


def _log(spark: SparkSession) -> CommitLog:
    """A new log in the shared folder."""
    return CommitLog(spark, f"{shared_dir(spark)}/commits-{uuid.uuid4().hex}")


def _tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, base, "walk_entries"), load(spark, base, "files"), load(spark, base, "index_runs")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return p5_pending(spark, base).select("entry_id")


def p5_pending(spark: SparkSession, base: str) -> DataFrame:
    """What the next run must process, as a run over a new log commits it."""
    log = _log(spark)
    process_pending(log, *_tables(spark, base))
    return pending_of(log).drop("run")


def p5_runs(spark: SparkSession, base: str) -> DataFrame:
    """Pending entries by run and repository when the entries arrive in two parts: no record twice, none left out."""
    walk, files, runs = _tables(spark, base)
    log, top = _log(spark), walk.agg(F.max("entry_id")).first()[0] or 0
    for part in (walk.filter(F.col("entry_id") <= top // 2), walk):
        process_pending(log, part, files, runs)
    log.compact(("sights", "pending"))
    return pending_of(log).groupBy("run", "repo_id").agg(F.count(F.lit(1)).alias("n_pending"), F.countDistinct("entry_id").alias("n_entries"), F.max("entry_id").alias("last_entry"))


_VALUES_SQL = """
  SELECT '{f}' AS field, {c} AS val, count(*) AS n_rows, count(DISTINCT file_id) AS n_members,
         coalesce({c} <> '' AND count(*) >= 0.02 * (SELECT count(*) FROM {t}), false) AS hot
  FROM {t} GROUP BY {c}"""
_VALUES = " UNION ALL ".join(_VALUES_SQL.format(f=f, t=t, c=c) for f, t, c in FIELDS)

_SIGHTS = """
    SELECT *, CASE WHEN rel_path LIKE './%' THEN substr(rel_path, 3) ELSE rel_path END AS p FROM walk_entries
    WHERE entry_id <= {upto}"""
_COMPARED = """
  WITH w AS ({sights}),
  w1 AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY repo_id, p ORDER BY seen_at DESC, entry_id DESC) = 1),
  f1 AS (
    SELECT f.* FROM files f
    WHERE EXISTS (SELECT 1 FROM index_runs r WHERE r.repo_id = f.repo_id AND lower(r.status) = 'ok'
                  AND f.indexed_at BETWEEN r.started_at AND r.finished_at)
    QUALIFY row_number() OVER (PARTITION BY f.repo_id, f.rel_path ORDER BY f.indexed_at DESC) = 1),
  j AS (
    SELECT w1.entry_id, w1.repo_id, w1.p AS rel_path,
      CASE WHEN f1.indexed_at IS NULL THEN 'new'
           WHEN coalesce(w1.hash, '') <> '' AND coalesce(f1.hash, '') <> '' THEN
             CASE WHEN w1.hash <> f1.hash THEN 'bytes' END
           WHEN coalesce(w1.mtime_ns, 0) <> coalesce(f1.mtime_ns, 0) OR w1.size IS DISTINCT FROM f1.size THEN 'stat' END AS why
    FROM w1 LEFT JOIN f1 ON f1.repo_id = w1.repo_id AND f1.rel_path = w1.p)
  SELECT entry_id, repo_id, rel_path, why FROM j WHERE why IS NOT NULL"""
_TOP = "(SELECT max(entry_id) FROM walk_entries)"
_PENDING = _COMPARED.format(sights=_SIGHTS.format(upto=_TOP))
_FIRST = _COMPARED.format(sights=_SIGHTS.format(upto=f"{_TOP} // 2"))
_RUNS = f"""
  SELECT run, repo_id, count(*) AS n_pending, count(DISTINCT entry_id) AS n_entries, max(entry_id) AS last_entry
  FROM (SELECT CAST(1 AS BIGINT) AS run, * FROM ({_FIRST})
        UNION ALL SELECT CAST(2 AS BIGINT), * FROM ({_PENDING}) WHERE entry_id > {_TOP} // 2)
  GROUP BY run, repo_id"""

QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p5_found": p5_found, "p5_pending": p5_pending, "p5_runs": p5_runs}
SQL = {
    "p2_found": f"SELECT field, val FROM ({_VALUES}) WHERE hot",
    "p2_values": _VALUES,
    "p5_found": f"SELECT entry_id FROM ({_PENDING})",
    "p5_pending": _PENDING,
    "p5_runs": _RUNS,
}
