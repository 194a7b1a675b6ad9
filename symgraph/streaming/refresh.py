"""Incremental refresh of an index: what changed, what went away, and a streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.operators.incremental import clean_path


def changed_files(listing: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Files of the listing that are not stored with the same mtime_ns and size (null mtime_ns is 0, null size -1)."""
    if force:
        return listing
    old = stored.select("repo_id", "rel_path", F.coalesce("mtime_ns", F.lit(0)).alias("_m"), F.coalesce("size", F.lit(-1)).alias("_s"))
    new = listing.withColumns({"_m": F.coalesce("mtime_ns", F.lit(0)), "_s": F.coalesce("size", F.lit(-1))})
    return new.join(old, ["repo_id", "rel_path", "_m", "_s"], "left_anti").drop("_m", "_s")


def stale_files(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that the listing no longer has: deleted, renamed or newly excluded."""
    return stored.join(listing.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_anti")


def merged_rows(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """Child rows after a refresh: those of files that changed or went away are replaced."""
    out_of_date = new.select("file_id").union(gone.select("file_id")).distinct()
    return old.join(out_of_date, "file_id", "left_anti").unionByName(new)


def latest_sights(stream: DataFrame) -> DataFrame:
    """The last sight of every path of a stream or table of walk entries."""
    last = F.max(F.struct("seen_at", "entry_id", "mtime_ns", "size", "hash")).alias("_last")
    return stream.groupBy("repo_id", clean_path(F.col("rel_path")).alias("rel_path")).agg(last).select("repo_id", "rel_path", "_last.*")


def follow(entries: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Runs `each(batch, number)` over what is new in a streaming source of walk entries, then stops.

    Within a batch only the last sight of a path is left; the checkpoint remembers what is done.
    """
    step = lambda batch, number: each(latest_sights(batch), number)
    return entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
