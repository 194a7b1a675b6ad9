"""Files that are not hand-written source: generated, minified, vendored, data saved as code, or too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.session import stored

#: Fixed value: files above this size are left out of an index.
LARGE = 3 * 1024 * 1024 + 256 * 1024
GENERATED_PLACES = ("generated", "__generated__", "autogen", "auto_generated", "gen", "dist", "build")
VENDORED_PLACES = (
    "vendor", "vendored", "_vendor", "third_party", "thirdparty", "third-party", "3rdparty", "node_modules",
    "bower_components", "external", "extern", "deps", "pods", "carthage", "godeps", "site-packages",
)
GENERATED_NAMES = r"(_generated\.[^./]+|\.generated\.[^./]+|\.gen\.[^./]+|_gen\.go|\.pb\.(go|cc|h)|_pb2(_grpc)?\.py|_pb\.(d\.ts|js)|\.g\.dart|\.designer\.cs)$"
MINIFIED_NAMES = r"[.-](min|bundle)\.(js|mjs|cjs|css)$"
#: What a generator says of the file in a comment line of its head; text about generators does not say it.
GENERATED_BANNER = (
    r"\W*(code generated by\b|generated (from|by|with)\b|auto-?generated\b|<auto-generated|@generated\b"
    r"|(this|the) (file|code) (is|was|has been) (automatically |auto-?)?generated\b|automatically (created|generated) (by|from)\b)"
)
VENDORED_BANNER = (
    r".*?(\breleased under the\b.*\blicen[cs]e\b|\bredistribution is allowed\b|\bpermissive licen[cs]e\b|\blicen[cs]ed under the\b"
    r"|\bpermission is hereby granted\b|\bspdx-license-identifier\b|\bredistribution and use in source\b)"
)
#: The head of a file: its first lines, and all lines before the first one of code.
HEAD_LINES = 12
MARK = r"(?=[/#*<-])(//|#(?![\[!]|\s*(include|define|if|ifdef|ifndef|else|endif|undef|pragma|error)\b)|/\*|\*(?!\w)|--|<!--)"
#: Blanks at the start of a line and the mark of a comment.
COMMENT = r"^[ \t\f\x0B\r]*+" + MARK
#: Literals; the look ahead passes over all other places fast.
LITERAL = r"(?=[\"'`\d])(?:\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`|\b0[xX][0-9a-fA-F]+\b|\b\d[\d_.]*\b)"

#: A line is rare if at most this share of the distinct files has it, or RARE_LINES files.
RARE_SHARE, RARE_LINES = 0.005, 20
#: A file is a copy if this share of its rare lines, of which it has at least FEWEST, stands in one file of another repository.
CONTAINED, FEWEST = 0.6, 6
#: Groups of repositories, of whose holders of a line the first and the last are proposed before all others; holders of a line in one task.
HUBS, HOT = 4, 2000


def current_files(files: DataFrame) -> DataFrame:
    """The latest row of each file_id; repeats and superseded rows fall away."""
    last = F.max(F.struct("indexed_at", "repo_id", "rel_path", "language", "size")).alias("_last")
    return files.filter("file_id is not null").groupBy("file_id").agg(last).select("file_id", "_last.*")


def _any_segment(path: Column, names: tuple[str, ...]) -> Column:
    folder = F.concat(F.lit("/"), F.lower(F.regexp_replace(path, r"[^/]*$", "")))
    return folder.rlike("/(" + "|".join(n.replace(".", r"\.") for n in names) + ")/")


def text_features(contents: DataFrame) -> DataFrame:
    """What the text of each file shows, made where the text is read, so that texts are never shuffled.

    class is a hash of the code lines without spacing and comments, so it stays the same under another banner.
    """
    rows = contents.select("file_id", F.regexp_replace("content", r"\r\n?", "\n").alias("content")).filter("file_id is not null")
    text = F.col("content")
    sub = lambda column, pattern, by="": F.regexp_replace(column, pattern, by)
    # The text before the first line that has something other than a comment.
    before = F.regexp_instr(text, F.lit(r"(?md)^[^\S\n]*(?!" + MARK + r")\S"))
    leading = F.when(before > 0, F.substring(text, F.lit(1), before - 1)).otherwise(text)
    head = F.concat_ws("\n", F.substring_index(text, "\n", HEAD_LINES), leading)
    says = lambda banner: head.rlike("(?imd)" + COMMENT + banner)
    plain = sub(sub(sub(text, "(?md)" + COMMENT + ".*$"), r"[ \t\f\x0B\r]+"), r"\n{2,}", "\n")
    long = F.aggregate(F.split(text, "\n"), F.lit(0), lambda n, x: n + F.when(F.length(x) > 400, F.length(x)).otherwise(0))
    rows = rows.select(
        "file_id", F.length(text).alias("_chars"), says(GENERATED_BANNER).alias("_generated"), says(VENDORED_BANNER).alias("_vendored"),
        F.trim(plain, F.lit("\n")).alias("_plain"), F.length(sub(text, r"[ \t\n\f\x0B\r]+")).alias("_black"), sub(sub(text, LITERAL), r"[ \t\n\f\x0B\r]+").alias("_code"),
        F.when(text.rlike(r"(?md)^[^\n]{401}"), long).otherwise(0).alias("_long"),
    )
    # The shapes of lines of code: numbers are one zero.
    shapes = F.filter(F.split(sub(F.col("_plain"), r"\d+", "0"), "\n"), lambda x: F.length(x) > 5)
    rows = rows.withColumns({"_code": F.length("_code"), "_words": F.length(sub(F.col("_code"), r"[,;\[\]{}()]+")), "_shapes": shapes})
    data = F.col("_black") - F.col("_code")
    share = data / (data + F.col("_words") + 1)
    enough = F.col("_chars") >= 150
    hashes = F.array_distinct(F.transform(F.filter(F.split("_plain", "\n"), lambda x: F.length(x) >= 12), lambda x: F.xxhash64(x)))
    rows = rows.select(
        "file_id", "_chars", F.substring(F.unhex(F.sha2("_plain", 256)), 1, 16).alias("class"), hashes.alias("hashes"),
        "_generated", "_vendored", (enough & (share >= 0.87)).alias("_data"),
        (enough & (F.col("_long") > 0.8 * F.col("_chars")) & (share < 0.6) & (F.col("_black") > 0.92 * F.col("_chars"))).alias("_dense"),
        ((F.size("_shapes") >= 12) & (F.size(F.array_distinct("_shapes")) < 0.4 * F.size("_shapes"))).alias("_repeats"),
    )
    seen = F.max(F.struct("_chars", "class", "hashes", "_generated", "_vendored", "_data", "_dense", "_repeats")).alias("_t")
    return rows.groupBy("file_id").agg(seen).select("file_id", "_t.*")


def described(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row a file: the rule it falls under by itself (`rule`, null if none), its class and its line hashes."""
    rows = current_files(files).join(text_features(contents), "file_id", "left")
    path = F.col("rel_path")
    script = F.lower(path).rlike(r"\.(js|mjs|cjs|jsx|ts|tsx|mts|cts|css)$")
    name = F.lower(F.regexp_extract(path, r"[^/]*$", 0))
    rule = (
        F.when(F.col("size") > LARGE, "large")
        .when(_any_segment(path, VENDORED_PLACES), "vendored place")
        .when(_any_segment(path, GENERATED_PLACES), "generated place")
        .when(name.rlike(GENERATED_NAMES), "generated name")
        .when(name.rlike(MINIFIED_NAMES), "minified name")
        .when(F.col("_generated"), "generated banner")
        .when(F.col("_vendored"), "vendored banner")
        .when(F.col("_data"), "data")
        .when(script & F.col("_dense"), "minified")
        .when(F.col("_repeats"), "repeated code")
    )
    return rows.select("file_id", "repo_id", "language", rule.alias("rule"), "class", "hashes")


def _signature(lines: Column) -> list[Column]:
    """128 bits, in two numbers: one bit for each line."""
    part = lambda k: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(_bit(x, k)))
    return [part(0), part(64)]


def _bit(line: Column, half: int) -> Column:
    """The bit of a line in one half of a signature."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), line.bitwiseAND(F.lit(63)).cast("int"))
    return F.when(line.bitwiseAND(F.lit(64)) == half, bit).otherwise(F.lit(0).cast("long"))


def copies(rows: DataFrame) -> DataFrame:
    """Classes of files (of `described`) whose code stands in another repository: class, share.

    Files of the same class are one entry of the inverted index, however many there are. The containment is exact and
    every holder of a line counts: a class can only be contained in one that has one of its rarest lines, as many as
    could be missing and one more, so just these are looked up, and most classes have no such line that others have.
    Each is first compared with some holders (hubs); only what is not found with them is compared with all holders of
    these lines, which are dealt out in parts of HOT, so that no task holds a hot line. Compared are whole sets of lines,
    after pairs that can't share enough by the bits of their signatures have been left out.

    Two shares count: of the rare lines, so that common ones can't hide or feign a copy; and of all lines, with at least
    FEWEST of them shared, so that a library whose lines are common because of its many edited copies is found as well.
    The same class in two repositories is a copy whatever its lines are.
    """
    heads = rows.filter(F.size("hashes") > 0).groupBy("class").agg(
        F.min("file_id").alias("rep"), F.min("repo_id").alias("low"), F.max("repo_id").alias("high"), F.max("hashes").alias("hashes")
    )
    heads = stored(heads)
    limit = max(RARE_LINES, heads.count() * RARE_SHARE)
    dealt = heads.select("rep", F.explode("hashes").alias("line")).repartition("line")
    often = dealt.groupBy("line").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1")
    bits = [F.bit_or(_bit(F.col("line"), half)).alias(f"_h{k}") for k, half in enumerate((0, 64))]
    shared = dealt.join(often, "line").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("shared"), *bits)
    home = F.when(F.col("low") == F.col("high"), F.xxhash64("low"))
    own = heads.filter("low is not null").select("rep", "class", home.alias("home"), F.size("hashes").alias("n_lines"))
    held = stored(own.join(shared, "rep"))

    rare = F.filter("shared", lambda x: x["n"] <= limit)
    n_rare = F.col("n_lines") - F.size("shared") + F.size(rare)
    part = lambda n: F.ceil(n * CONTAINED - 1e-9).cast("int")
    of_rare = F.when(n_rare >= FEWEST, F.struct(rare.alias("lines"), n_rare.alias("n"), part(n_rare).alias("need")))
    need = F.greatest(F.lit(FEWEST), part(F.col("n_lines")))
    of_all = F.when(n_rare < F.col("n_lines"), F.struct(F.col("shared").alias("lines"), F.col("n_lines").alias("n"), need.alias("need")))
    ways = F.filter(F.array_compact(F.array(of_rare, of_all)), lambda x: F.size(x["lines"]) >= x["need"])
    probes = held.filter("home is not null").select("rep", "class", "home", F.explode(ways).alias("_x"))
    probes = stored(probes.select("rep", "class", "home", "_x.*"))
    first = F.slice("lines", F.lit(1), F.size("lines") - F.col("need") + 1)
    s0, s1 = _signature(F.col("lines.line"))
    # Each shared line is a shared bit, but for those of its own lines that fall on one bit.
    wanted = probes.select("rep", "home", "need", F.size("lines").alias("_m"), s0.alias("_s0"), s1.alias("_s1"), F.explode(first).alias("_x"))
    least = F.col("need") - F.col("_m") + F.bit_count("_s0") + F.bit_count("_s1")
    wanted = stored(wanted.select("rep", "home", "_s0", "_s1", least.alias("_least"), "_x.n", "_x.line"))
    index = held.select(F.col("home").alias("_home"), F.col("rep").alias("hub"), "_h0", "_h1", F.explode("shared.line").alias("line"))
    index = stored(index.join(wanted.select("line").distinct(), "line", "left_semi"))
    alike = F.bit_count(F.col("_s0").bitwiseAND(F.col("_h0"))) + F.bit_count(F.col("_s1").bitwiseAND(F.col("_h1"))) >= F.col("_least")
    elsewhere = (F.col("rep") != F.col("hub")) & ~F.col("home").eqNullSafe(F.col("_home"))

    def contained(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(elsewhere & alike).select("rep", "hub").distinct()
        far = held.select(F.col("rep").alias("hub"), F.col("shared.line").alias("_far"))
        both = probes.select("rep", "class", F.col("lines.line").alias("_near"), "n", "need").join(pairs, "rep").join(far, "hub")
        common = F.size(F.array_intersect("_near", "_far"))
        return both.filter(common >= F.col("need")).groupBy("rep", "class").agg(F.max(common / F.col("n")).alias("share"))

    bucket = F.pmod(F.coalesce("_home", F.lit(0)), F.lit(HUBS))
    ends = [f(F.when(bucket == k, F.struct("_home", "hub", "_h0", "_h1"))) for k in range(HUBS) for f in (F.min, F.max)]
    hubs = index.groupBy("line").agg(F.array_distinct(F.array_compact(F.array(*ends))).alias("_hubs"))
    near = wanted.join(hubs, "line").withColumn("_x", F.explode("_hubs")).select("rep", "home", "_s0", "_s1", "_least", "_x.*")
    near = stored(contained(near))
    parts = F.ceil(F.col("n") / HOT).cast("int")
    left = wanted.join(near, "rep", "left_anti").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    every = index.join(wanted.select("line", "n").distinct(), "line").withColumn("_part", F.pmod(F.xxhash64("hub"), parts).cast("int")).drop("n")
    found = near.unionByName(contained(left.join(every, ["line", "_part"])))
    whole = heads.filter("low != high").select("class", F.lit(1.0).alias("share"))
    return found.select("class", "share").unionByName(whole).groupBy("class").agg(F.max("share").alias("share"))


def not_handwritten(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Every file that is not hand-written source of its repository: file_id, repo_id, language, rule.

    First the inverted index of rare line hashes finds code that stands in other repositories, under whatever spacing
    or banner; then place, name, banner and composition of the tokens decide on the rest. `rule` names what a file
    itself shows, else `copy`.

    Files without a row in `contents`, or with null or empty content, are judged by path and size alone. Repeated rows
    and superseded rows count once; of several contents of a file the longest is taken. Null paths, sizes and
    repositories show nothing. Empty tables give no rows. Other columns are ignored.
    """
    rows = stored(described(files, contents))
    found = copies(rows)
    rule = F.coalesce("rule", F.when(F.col("share").isNotNull(), "copy"))
    return rows.join(found, "class", "left").select("file_id", "repo_id", "language", rule.alias("rule")).filter("rule is not null")
