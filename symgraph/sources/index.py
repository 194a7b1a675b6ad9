"""The index: files, symbols, refs and imports as DataFrames that agree with each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.session import load


def latest_files(files: DataFrame) -> DataFrame:
    """The last stored row of each file; repeats and superseded rows fall away."""
    last = F.max(F.struct("indexed_at", "repo_id", "path", "rel_path", "language", "hash", "mtime_ns", "size")).alias("_last")
    return files.groupBy("file_id").agg(last).select("file_id", "_last.*")


_text = lambda c: F.coalesce(c, F.lit("")).alias(c)
_PLAIN = {
    "symbols": lambda: ["id", "file_id", _text("name"), _text("kind"), "language", "start_line", "end_line", "start_col", "end_col", _text("parent"), "depth", _text("signature")],
    "refs": lambda: ["id", "file_id", "line", _text("name"), "language", F.when(F.coalesce("kind", F.lit("")) == "", "use").otherwise(F.col("kind")).alias("kind")],
    "imports": lambda: ["id", "file_id", _text("raw_path"), "language"],
}


@dataclass(frozen=True)
class Index:
    """Rows know their repository and path, as names are resolved within a repository and every result shows the path.

    Exact repeats are dropped; null names, parents and signatures are empty; a ref without a kind is a `use`.
    `stored` has the tables as they are stored, for conditions that should reach them.
    """

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    imports: DataFrame
    stored: dict[str, DataFrame] | None = None

    @classmethod
    def of(cls, files: DataFrame, symbols: DataFrame, refs: DataFrame, imports: DataFrame) -> Index:
        kept = latest_files(files)
        raw = {"symbols": symbols, "refs": refs, "imports": imports, "place": kept.select("file_id", "repo_id", "rel_path")}
        return cls(kept, *(_joined(t, raw[t], raw["place"]) for t in _PLAIN), raw)

    @classmethod
    def load(cls, spark: SparkSession, base: str) -> Index:
        return cls.of(*(load(spark, base, t) for t in ("files", "symbols", "refs", "imports")))

    def pick(self, table: str, column: str, values: list[str]) -> DataFrame:
        """The rows of a table whose column has one of the values. The condition is on the stored column, so that it
        reaches the files, and few rows are left before repeats are dropped; an empty value means null as well."""
        values = list(values)
        if self.stored is None:
            return getattr(self, table).filter(F.col(column).isin(*values))
        condition = F.col(column).isin(*values)
        if "" in values:
            condition = condition | F.col(column).isNull()
        return _joined(table, self.stored[table].filter(condition), self.stored["place"])

    def save(self, path: str) -> None:
        """Writes the index. Symbols and refs are clustered by name, so that a lookup by name opens few row groups, and a
        name that holds a third of the rows still spreads over files."""
        for name, order in (("files", ["repo_id", "rel_path"]), ("symbols", ["name", "repo_id"]), ("refs", ["name", "repo_id"]), ("imports", ["repo_id", "raw_path"])):
            table = getattr(self, name)
            table.repartitionByRange(*order, "file_id").sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        """An index as `save` wrote it."""
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("files", "symbols", "refs", "imports")))


def _joined(table: str, rows: DataFrame, place: DataFrame) -> DataFrame:
    return rows.select(*_PLAIN[table]()).distinct().join(place, "file_id")
