"""Most frequent items with bounded memory: Misra-Gries summaries per partition, merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longer values are counted under their SHA-256, so a summary has a size bound: counters x (LONG + 1) bytes.
LONG = 256
#: Summaries merged at once, and levels of the tree: enough for FAN_IN ** LEVELS (16 million) partitions.
FAN_IN, LEVELS = 256, 3
_SCHEMA = "part int, key string, est long, n_rows long"


def shrink(table: pa.Table, counters: int) -> pa.Table:
    """Adds up the counters of equal keys; beyond `counters` of them, the next-largest is subtracted from all.

    Every counter then is too low by at most n / (counters + 1), n being the rows summarised so far.
    """
    table = table.group_by("key").aggregate([("est", "sum")]).rename_columns(["key", "est"])
    if len(table) <= counters:
        return table
    place = len(table) - counters - 1
    cut = np.partition(table["est"].to_numpy(), place)[place]
    table = table.set_column(1, "est", pc.subtract(table["est"], pa.scalar(int(cut), pa.int64())))
    return table.filter(pc.greater(table["est"], 0))


def _empty() -> pa.Table:
    return pa.table({"key": pa.array([], pa.string()), "est": pa.array([], pa.int64())})


def _emit(part: int, table: pa.Table, n: int) -> pa.Table:
    """The summary with a row of null key for the number of rows seen."""
    size = len(table)
    return pa.table(
        {
            "part": pa.array([part] * (size + 1), pa.int32()),
            "key": pa.concat_arrays([table["key"].combine_chunks().cast(pa.string()), pa.array([None], pa.string())]),
            "est": pa.concat_arrays([table["est"].combine_chunks().cast(pa.int64()), pa.array([0], pa.int64())]),
            "n_rows": pa.array([0] * size + [n], pa.int64()),
        }
    )


def _key(text: Column) -> Column:
    return F.when(F.octet_length(text) <= LONG, F.concat(F.lit("="), text)).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def summaries(df: DataFrame, column: str, counters: int) -> DataFrame:
    """A Misra-Gries summary of `column` for each partition: part, key, est and (in the row of null key) n_rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept, open_, size, n = _empty(), [], 0, 0
        for batch in batches:
            n += batch.num_rows
            counts = pc.value_counts(batch.column(0).drop_null())
            open_.append(pa.table({"key": counts.field("values"), "est": counts.field("counts")}))
            size += len(counts)
            if size > 8 * counters:
                kept, open_, size = shrink(pa.concat_tables([kept, *open_]), counters), [], 0
        kept = shrink(pa.concat_tables([kept, *open_]), counters)
        if n:
            yield from _emit(TaskContext.get().partitionId(), kept, n).to_batches()

    text = F.col(column)
    return df.select(F.when(text != "", _key(text)).alias("key")).mapInArrow(summarise, _SCHEMA)


def merged(parts: DataFrame, counters: int) -> DataFrame:
    """One summary of all. No task gets more than FAN_IN summaries, however many partitions there are."""

    def merge(table: pa.Table) -> pa.Table:
        keyed = table.filter(pc.is_valid(table["key"])).select(["key", "est"])
        n = pc.sum(table["n_rows"]).as_py() or 0
        return _emit(table["part"][0].as_py(), shrink(keyed, counters), n)

    for _ in range(LEVELS):
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("part").applyInArrow(merge, _SCHEMA)
    return parts


def frequent_values(df: DataFrame, column: str, share: float = 0.004, counters: int = 2000) -> DataFrame:
    """Values of `column` in at least `share` of all rows: val, n_rows (exact), est (the summary's count), part.

    Pass 1 keeps at most `counters` counters a partition, whatever the number of distinct values, and merges them by
    subtracting the next-largest counter; every value above n / (counters + 1) rows is sure to be in the result. Pass 2
    counts the few candidates exactly, against a broadcast of at most `counters` keys of LONG + 65 bytes at most.

    All rows count for the share, those with null or empty values too, but these are no values themselves. Values
    that differ in letter case or spaces differ. Repeated rows count each. An empty table gives no rows. Other columns
    are ignored. Ties at the threshold are all in the result.
    """
    if counters * share <= 2:
        raise ValueError("counters must exceed 2 / share")
    summary = merged(summaries(df, column, counters), counters)
    one = Window.partitionBy("part")  # at most counters + 1 rows
    slack = share - 1.0 / (counters + 1)
    picked = (
        summary.withColumn("_n", F.max("n_rows").over(one))
        .filter(F.col("key").isNotNull() & (F.col("est") >= F.col("_n") * slack))
        .select(F.col("key").alias("_key"), F.col("est").alias("_est"), "_n")
    )
    text = F.col(column)
    rows = df.select(text.alias("val"), _key(text).alias("_key")).filter("val != ''")
    exact = rows.join(F.broadcast(picked), "_key").groupBy("val", "_est", "_n").agg(F.count(F.lit(1)).alias("n_rows"))
    part = F.col("n_rows") / F.col("_n")
    return exact.filter(part >= share).select("val", "n_rows", F.col("_est").alias("est"), part.alias("part"))
