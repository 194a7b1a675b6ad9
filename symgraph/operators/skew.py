"""Per-key results where a handful of keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_value(df: DataFrame, key: str, member: str) -> DataFrame:
    """Rows and distinct members per value of `key`: columns val, n_rows, n_members.

    Both aggregates are algebraic and combined on the map side. The first groups by (value, member), so the rows of a
    hot value spread over all tasks; the second receives at most one compact row a value and map task. No task holds
    a whole key.

    Nulls in `key` form a group of their own (val null), so do empty strings; null members count as rows but not as
    members. Repeated rows count. An empty table gives no rows. Other columns, whatever they are called, are ignored.
    """
    pairs = (
        df.select(F.col(key).alias("val"), F.col(member).alias("_member"))
        .groupBy("val", "_member")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return pairs.groupBy("val").agg(F.sum("_n").alias("n_rows"), F.count("_member").alias("n_members"))


def rows_per_value(df: DataFrame, key: str) -> DataFrame:
    """The rows of each value of `key`: val, n_rows; a count combined on the map side, so no task holds a whole key."""
    return df.groupBy(F.col(key).alias("val")).agg(F.count(F.lit(1)).alias("n_rows"))


def table_rows(df: DataFrame) -> Column:
    """The number of all rows, as a scalar subquery (no collect, no join)."""
    return df.select(F.count(F.lit(1))).scalar()


def imbalance(df: DataFrame, key: str, member: str, share: float = 0.02) -> DataFrame:
    """`per_value` with the share of all rows and whether the value causes the imbalance (share or more of all rows).

    Null and empty values get their rows but are never named as hot, as they are no values.
    """
    part = F.col("n_rows") / table_rows(df)
    return per_value(df, key, member).select("val", "n_rows", "n_members", part.alias("part"), _hot(part, share).alias("hot"))


def heavy_values(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """The values that cause the imbalance, with their rows: val, n_rows. Members aren't counted, so only values shuffle."""
    part = F.col("n_rows") / table_rows(df)
    return rows_per_value(df, key).filter(_hot(part, share))


def _hot(part: Column, share: float) -> Column:
    return F.coalesce(F.col("val") != "", F.lit(False)) & (part >= share)
