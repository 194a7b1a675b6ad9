"""Symbol and text search."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.names import ascii_lower, path_allowed, symbol_id, symbol_score
from symgraph.sources.index import Index

RESULT = ["name", "kind", "repo_id", "rel_path", "start_line", "end_line", "parent", "depth", "signature", "language"]
ORDER = ["name", "repo_id", "rel_path", "start_line", "id"]


def scored(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("score", symbol_score(F.col("kind"), F.col("rel_path")))


def exact_search(
    idx: Index, names: list[str], kind: str = "", language: str = "", ignore_case: bool = False, limit: int | None = 20,
    include: list[str] = (), exclude: list[str] = (),
) -> DataFrame:
    """Definitions of the names, the likeliest first. Names reach the stored table; ties are broken by place and id."""
    if ignore_case:
        wanted = [n.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for n in names]
        found = idx.symbols.filter(ascii_lower(F.col("name")).isin(*wanted))
    else:
        found = idx.pick("symbols", "name", names)
    if kind:
        found = found.filter(F.col("kind") == kind)
    if language:
        found = found.filter(F.col("language") == language)
    found = scored(found.filter(path_allowed(F.col("rel_path"), include, exclude))).orderBy(F.desc("score"), *ORDER)
    return (found.limit(limit) if limit else found).select("id", *RESULT, "score")


def _unaccented() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, made by rule."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, b) for c, b in pairs if b != c and b.isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _unaccented()


def query_phrases(query: str) -> list[list[str]]:
    """The words of a query: parts between spaces are phrases that must all be there, their words stand in a row."""
    folded = query.lower().translate(str.maketrans(_MARKED, _PLAIN))
    return [words for part in folded.split() if (words := [t for t in re.split(r"[\W_]+", part) if t])]


def prefix_search(idx: Index, query: str, kind: str = "", language: str = "", limit: int | None = 20, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Symbols in whose name or kind all phrases of the query stand, the last word of the last one as a prefix.

    `handle request` are two phrases, `handle_request` is one of two words. Case and marks on letters do not matter.
    The order is tier (0 the name itself, 1 a name that begins with the query, 2 the rest), then BM25 within the tier
    beyond the score: tier, score, rank, place. Text that is no word separates words and is never an error.
    """
    phrases = query_phrases(query)
    if not phrases:
        return scored(idx.symbols.limit(0)).select("id", *RESULT, "score", F.lit(0).alias("tier"), F.lit(0.0).alias("rank"))
    folded = F.translate(F.lower(F.concat_ws(" ", "name", "kind")), _MARKED, _PLAIN)
    tokens = F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    every = idx.symbols.select("id", "file_id", "repo_id", "rel_path", "name", "kind", "language", "start_line", "end_line", "parent", "depth", "signature", tokens.alias("_t"))

    def times(words: list[str], prefix: bool) -> Column:
        n, last = len(words), words[-1]
        end = lambda i: F.element_at("_t", i + (n - 1)).startswith(last) if prefix else F.element_at("_t", i + (n - 1)) == last
        holds = lambda i: _all([F.element_at("_t", i + k) == w for k, w in enumerate(words[:-1])] + [end(i)])
        return F.when(F.size("_t") >= n, F.size(F.filter(F.sequence(F.lit(1), F.size("_t") - (n - 1)), holds))).otherwise(0)

    some = range(len(phrases))
    counted = every.withColumns({f"_f{k}": times(words, k == len(phrases) - 1) for k, words in enumerate(phrases)})
    stats = counted.agg(F.count(F.lit(1)).alias("_rows"), F.avg(F.size("_t")).alias("_mean"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_hits{k}") for k in some])
    # One row of statistics beside the hits.
    hits = counted.filter(_all([F.col(f"_f{k}") > 0 for k in some])).join(F.broadcast(stats), F.lit(True))
    rank = F.lit(0.0)
    for k in some:
        n, f = F.col(f"_hits{k}"), F.col(f"_f{k}")
        idf = F.greatest(F.log((F.col("_rows") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        rank = rank + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.size("_t") / F.col("_mean")))
    low, plain = ascii_lower(F.col("name")), query.lower()
    tier = F.when(low == plain, 0).when(low.startswith(plain), 1).otherwise(2)
    found = scored(hits.withColumns({"rank": F.round(rank, 6), "tier": tier}))
    if kind:
        found = found.filter(F.col("kind") == kind)
    if language:
        found = found.filter(F.col("language") == language)
    found = found.filter(path_allowed(F.col("rel_path"), include, exclude)).orderBy("tier", F.desc("score"), F.desc("rank"), *ORDER)
    return (found.limit(limit) if limit else found).select("id", *RESULT, "score", "tier", "rank")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def flex_search(idx: Index, query: str, limit: int = 20) -> DataFrame:
    """Exact search without case; where that finds nothing, prefix search. One plan, no probing."""
    exact = exact_search(idx, [query], ignore_case=True, limit=limit).withColumn("_way", F.lit(0))
    loose = prefix_search(idx, query, limit=limit).drop("tier", "rank").withColumn("_way", F.lit(1))
    best = Window.partitionBy(F.lit(0))  # at most 2 x limit rows
    both = exact.unionByName(loose).withColumn("_best", F.min("_way").over(best))
    return both.filter("_way = _best").drop("_way", "_best")


def multi_search(idx: Index, queries: list[str], limit: int = 20, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """The hits of several queries, `limit` each, every symbol once under the first query that finds it."""
    first_place = {q: queries.index(q) for q in queries}
    order = F.create_map(*[F.lit(x) for pair in first_place.items() for x in pair])
    found = scored(idx.pick("symbols", "name", queries).filter(path_allowed(F.col("rel_path"), include, exclude)))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), *ORDER))
    kept = found.withColumns({"query_no": order[F.col("name")], "rank": rank, "symbol_id": symbol_id()}).filter(F.col("rank") <= limit)
    first = F.row_number().over(Window.partitionBy("repo_id", "symbol_id").orderBy("query_no", "rank"))
    return kept.withColumn("_first", first).filter("_first = 1").select("query_no", "rank", "symbol_id", *RESULT, "score")


def listed(args: list[str], text: str = "") -> list[str]:
    """Names given as arguments and in the lines of a text, each once in the order met; blank lines and `#` lines are skipped."""
    lines = [x.strip() for x in text.splitlines()]
    return list(dict.fromkeys([*[a.strip() for a in args if a.strip()], *[x for x in lines if x and not x.startswith("#")]]))


def ranking_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """How well a ranking (query, item, rank from 1) puts what is expected (query, item) first: one row.

    n_queries with something expected, mrr (mean reciprocal of the best rank, 0 if none is found), top1 (share of
    queries whose first item is expected) and the median best rank among the queries that find any.
    """
    found = expected.distinct().join(ranked, ["query", "item"], "left").groupBy("query").agg(F.min("rank").alias("_best"))
    return found.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce(1 / F.col("_best"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce((F.col("_best") == 1).cast("int"), F.lit(0))).alias("top1"), F.median("_best").alias("median_rank"),
    )


def lines_of(contents: DataFrame) -> DataFrame:
    """Every line of the texts: file_id, line (from 1), content. A carriage return at the end and an empty last piece are dropped."""
    pieces = contents.select("file_id", F.posexplode(F.split("content", "\n")).alias("pos", "content"), F.size(F.split("content", "\n")).alias("_n"))
    kept = pieces.filter((F.col("content") != "") | (F.col("pos") + 1 < F.col("_n")))
    return kept.select("file_id", (F.col("pos") + 1).alias("line"), F.regexp_replace("content", "\r$", "").alias("content"))


def text_search(files: DataFrame, contents: DataFrame, query: str, language: str = "", limit: int | None = 50, regex: bool = False) -> DataFrame:
    """Lines that hold the query: a case-sensitive piece of text or a regular expression. Texts without it are dropped before they are split."""
    if not regex:
        contents = contents.filter(F.col("content").contains(query))
    hit = F.col("content").rlike(query) if regex else F.col("content").contains(query)
    place = files.filter(F.col("language") == language) if language else files
    found = lines_of(contents).filter(hit).join(place.select("file_id", "repo_id", "rel_path"), "file_id")
    found = found.select("repo_id", "rel_path", "line", F.substring("content", 1, 200).alias("snippet")).orderBy("repo_id", "rel_path", "line")
    return found.limit(limit) if limit else found
