"""Source files that do not parse, with all their errors and the rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.handwritten import current_files

#: The parseable languages by extension, and other spellings of their names.
EXTENSIONS = {
    "go": "go", "py": "python", "pyw": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "rs": "rust", "java": "java", "c": "c", "h": "c",
}
SPELLINGS = {"golang": "go", "py": "python", "python3": "python", "js": "javascript", "ecmascript": "javascript", "ts": "typescript", "rs": "rust"}
LANGUAGES = ("c", "go", "java", "javascript", "python", "rust", "typescript")
_SCHEMA = "file_id long, repo_id string, language string, valid boolean, first_line int, first_cause string, errors array<struct<line:int,cause:string>>"


def language_of(language: Column, path: Column) -> Column:
    """The language in its usual spelling; where it is null, that of the extension. Null if it has no parser here."""
    name = F.lower(F.trim(language))
    spelled = F.coalesce(F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])[name], name)
    ends = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[F.regexp_extract(path, r"\.([^./]*)$", 1)]
    found = F.when(language.isNull(), ends).otherwise(spelled)
    return F.when(found.isin(*LANGUAGES), found)


def parse_reports(files: DataFrame, contents: DataFrame) -> DataFrame:
    """A row for every file with content and a known language: file_id, repo_id, language, valid, first_line, first_cause, errors.

    Each text is parsed whole by recursive descent with precedence climbing; after an error the parser goes on in panic
    mode, so all errors are kept, in the order of lines. Empty and comment-only files are valid; what is nested beyond
    the stack is neither valid nor invalid (null).

    Files without content (null, or no row) or of another language give no row. Repeated and superseded rows of files
    count once; of several contents of a file the largest is taken. Empty tables give no rows. Other columns are ignored.
    """
    known = current_files(files).select("file_id", "repo_id", language_of(F.col("language"), F.col("rel_path")).alias("language"))
    texts = contents.select("file_id", "content").filter("content is not null").groupBy("file_id").agg(F.max("content").alias("content"))
    rows = known.filter("language is not null").join(texts, "file_id")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from symgraph.llm.syntax import check

        cause = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))
        for batch in batches:
            ids, repos, languages = batch.column(0), batch.column(1), batch.column(2)
            valid, lines, causes, errors = [], [], [], []
            for language, text in zip(languages.to_pylist(), batch.column(3).to_pylist(), strict=True):
                report = check(text, language)
                valid.append(report.valid)
                first = report.errors[0] if report.errors else (None, None)
                lines.append(first[0])
                causes.append(first[1])
                errors.append([{"line": n, "cause": c} for n, c in report.errors])
            columns = [ids, repos, languages, pa.array(valid, pa.bool_()), pa.array(lines, pa.int32()), pa.array(causes, pa.string()), pa.array(errors, cause)]
            yield pa.RecordBatch.from_arrays(columns, ["file_id", "repo_id", "language", "valid", "first_line", "first_cause", "errors"])

    return rows.select("file_id", "repo_id", "language", "content").mapInArrow(parse, _SCHEMA)


def parse_rates(reports: DataFrame, stats: DataFrame) -> DataFrame:
    """For each repository and language: files, invalid files, acceptance rate, and the parse errors once reported for the repository.

    Exact repeats of `stats` count once. Repositories without statistics have null there.
    """
    invalid = F.count_if(~F.col("valid"))
    rates = reports.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"), invalid.alias("n_invalid"), F.sum(F.size("errors")).alias("n_errors"), F.avg(F.col("valid").cast("int")).alias("accepted")
    )
    reported = stats.select("stat_id", "repo_id", "parse_errors").distinct().groupBy("repo_id").agg(F.sum("parse_errors").alias("reported"))
    return rates.join(reported, "repo_id", "left")
