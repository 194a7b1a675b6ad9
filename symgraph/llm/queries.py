"""Queries of the problems tagged llm, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm.frequent import frequent_values
from symgraph.llm import handwritten as H
from symgraph.llm import validity as V
from symgraph.llm.handwritten import not_handwritten
from symgraph.llm.leaks import leaks
from symgraph.llm.packing import SHARD, pack
from symgraph.llm.subjects import SHARE, subject_shares
from symgraph.llm.validity import parse_rates, parse_reports
from symgraph.session import load

FIELDS = (("refs.name", "refs", "name"), ("imports.raw_path", "imports", "raw_path"))


def p1_values(spark: SparkSession, base: str) -> DataFrame:
    parts = [frequent_values(load(spark, base, t), c).select(F.lit(f).alias("field"), "val", "n_rows") for f, t, c in FIELDS]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return p1_values(spark, base).select("field", "val")


def p3_reports(spark: SparkSession, base: str) -> DataFrame:
    return parse_reports(load(spark, base, "files"), load(spark, base, "file_contents"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return p3_reports(spark, base).filter("not valid").select("file_id")


def p3_rates(spark: SparkSession, base: str) -> DataFrame:
    return parse_rates(p3_reports(spark, base), load(spark, base, "index_stats"))


def p4_files(spark: SparkSession, base: str) -> DataFrame:
    return not_handwritten(load(spark, base, "files"), load(spark, base, "file_contents"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return p4_files(spark, base).select("file_id")


def p6_pack(spark: SparkSession, base: str) -> DataFrame:
    return pack(load(spark, base, "documents"), load(spark, base, "pack_sizes"))


def p6_check(spark: SparkSession, base: str) -> DataFrame:
    """What every packing must keep: all documents whole, none split without need, no container above its capacity, and
    at most one container in a hundred (and one a shard) more than the tokens need."""
    docs, sizes = load(spark, base, "documents"), load(spark, base, "pack_sizes")
    packed = p6_pack(spark, base).join(sizes.groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity")), "pack_name")
    filled = packed.groupBy("pack_name", "capacity", "container").agg(F.sum("tokens").alias("fill"))
    by_pack = filled.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fill") > F.col("capacity")).alias("n_over"))
    whole = packed.groupBy("pack_name", "capacity", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p"))
    need = F.ceil(F.sum("t") / F.max("capacity")).alias("need")
    split = F.count_if((F.col("p") > 1) & (F.col("t") <= F.col("capacity"))).alias("n_split")
    found = whole.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("n_tokens"), split, need).join(by_pack, "pack_name")
    shards = -(-docs.count() // SHARD)
    return found.select("pack_name", "n_docs", "n_tokens", "n_split", "n_over", (F.col("n") <= F.col("need") * 1.01 + shards).alias("tight"))


def p3_blank(spark: SparkSession, base: str) -> DataFrame:
    """The reports of texts without any visible character, which are valid."""
    blank = load(spark, base, "file_contents").filter(r"content rlike '^\\s*$'").select("file_id")
    return p3_reports(spark, base).join(blank, "file_id", "left_semi").select("file_id", "language", "valid")


def p4_by_place(spark: SparkSession, base: str) -> DataFrame:
    """The files that size, place or name show, with the rule."""
    rules = ("large", "vendored place", "generated place", "generated name", "minified name")
    return p4_files(spark, base).filter(F.col("rule").isin(*rules)).select("file_id", "rule")


def p7_verbatim(spark: SparkSession, base: str) -> DataFrame:
    """The leaks in which the item stands in the document letter by letter."""
    pairs = p7_leaks(spark, base).select("doc_id", "item_id")
    both = pairs.join(load(spark, base, "documents").select("doc_id", "text"), "doc_id").join(load(spark, base, "eval_items").select("item_id", F.col("text").alias("item")), "item_id")
    return both.filter(F.col("text").contains(F.col("item"))).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, base: str) -> DataFrame:
    return leaks(load(spark, base, "documents"), load(spark, base, "eval_items"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return p7_leaks(spark, base).select("doc_id", "item_id")


def p7_items(spark: SparkSession, base: str) -> DataFrame:
    """For each leaked item the documents that hold it and the longest passage."""
    return p7_leaks(spark, base).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("words").alias("words"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return subject_shares(*(load(spark, base, t) for t in ("documents", "doc_labels", "subjects")))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return p8_shares(spark, base).filter(F.col("share") >= SHARE).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, base: str) -> DataFrame:
    """The composition of the corpus: documents of each subject and their sentences."""
    found = p8_shares(spark, base).filter(F.col("share") >= SHARE)
    return found.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


_FREQUENT = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {c} AS val, count(*) AS n_rows FROM {t} WHERE {c} <> '' GROUP BY {c} HAVING count(*) >= 0.004 * (SELECT count(*) FROM {t})"
    for f, t, c in FIELDS
)

QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p3_found": p3_found, "p3_reports": p3_reports, "p3_rates": p3_rates, "p4_found": p4_found, "p4_files": p4_files, "p6_pack": p6_pack, "p6_check": p6_check, "p3_blank": p3_blank, "p4_by_place": p4_by_place, "p7_verbatim": p7_verbatim, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_items": p7_items, "p8_found": p8_found, "p8_shares": p8_shares, "p8_composition": p8_composition}
_CHECK = r"""
  WITH z AS (SELECT doc_id, max(coalesce(CASE WHEN n_tokens >= 0 THEN n_tokens END, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')), 0)) AS t
             FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
  SELECT p.pack_name, count(*) AS n_docs, CAST(sum(z.t) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_over, true AS tight
  FROM z, (SELECT DISTINCT pack_name FROM pack_sizes WHERE capacity_tokens > 0) p GROUP BY 1"""
_LAST = "WITH f AS (SELECT * FROM files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC, repo_id DESC, rel_path DESC) = 1)"
_case = lambda pairs: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
_BLANK = f"""{_LAST},
  l AS (SELECT file_id, CASE WHEN language IS NULL THEN CASE regexp_extract(rel_path, '\\.([^./]*)$', 1) {_case(V.EXTENSIONS)} END
                             ELSE CASE lower(trim(language)) {_case(V.SPELLINGS)} ELSE lower(trim(language)) END END AS language FROM f)
  SELECT file_id, language, true AS valid FROM l JOIN file_contents c USING (file_id)
  WHERE regexp_full_match(c.content, '\\s*') AND language IN ({', '.join(f"'{x}'" for x in V.LANGUAGES)})"""
_FOLDER = "'/' || lower(regexp_replace(rel_path, '[^/]*$', ''))"
_BASE = "lower(string_split(rel_path, '/')[-1])"
_segments = lambda names: "/(" + "|".join(names) + ")/"
_PLACES = f"""{_LAST},
  r AS (SELECT file_id, CASE WHEN size > {H.LARGE} THEN 'large' WHEN regexp_matches({_FOLDER}, '{_segments(H.VENDORED_PLACES)}') THEN 'vendored place'
    WHEN regexp_matches({_FOLDER}, '{_segments(H.GENERATED_PLACES)}') THEN 'generated place' WHEN regexp_matches({_BASE}, '{H.GENERATED_NAMES}') THEN 'generated name'
    WHEN regexp_matches({_BASE}, '{H.MINIFIED_NAMES}') THEN 'minified name' END AS rule FROM f)
  SELECT file_id, rule FROM r WHERE rule IS NOT NULL"""
_VERBATIM = "SELECT DISTINCT doc_id, item_id FROM documents d, eval_items i WHERE contains(d.text, i.text)"

SQL = {"p1_found": f"SELECT field, val FROM ({_FREQUENT})", "p1_values": _FREQUENT, "p6_check": _CHECK, "p3_blank": _BLANK, "p4_by_place": _PLACES, "p7_verbatim": _VERBATIM}
