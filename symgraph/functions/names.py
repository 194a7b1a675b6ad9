"""Column expressions over names and paths."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups of kinds, which differ from query to query.
TYPE_TARGETS = ("class", "struct", "enum", "interface", "protocol", "trait", "record", "object", "mixin", "actor")
TYPE_ENCLOSERS = (*TYPE_TARGETS, "impl")
TYPE_REFS = ("struct", "interface", "class", "type", "enum", "trait")
INVESTIGATE_TYPES = ("class", "struct", "type", "interface", "trait", "enum", "object", "mixin", "extension", "protocol", "record", "actor")
TRUNCATE_TYPES = ("class", "struct", "type", "interface", "trait", "enum", "object", "mixin", "extension")

# Names that are no symbols of a project.
BUILTINS = (
    "len cap make append close delete copy new panic recover int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 "
    "float32 float64 string bool byte rune error nil Errorf Sprintf Fprintf Printf Println Error String Close Read Write "
    "Lock Unlock RLock RUnlock Add Load Store Done Wait Begin Commit Rollback Exec Query QueryRow Scan Now Since Sleep "
    "Join Split Contains HasPrefix HasSuffix TrimPrefix TrimSuffix Open Create Remove Stat Lstat ReadFile WriteFile "
    "Abs Dir Base Ext Rel Go Next Rows"
).split()

# What each kind and each part of a path adds to the score of a definition.
KIND_SCORES = {
    60: ("class", "struct", "interface", "type"), 50: ("function",), 40: ("method",), 30: ("enum",), 20: ("constructor",), 15: ("impl",),
    10: ("variable", "constant"),
}
PATH_SCORES = (
    (-80, ("/test/", "/tests/", "/testing/", "_test.go", "_test.", "_spec.", ".test.", ".spec.", "/testdata/", "/testutil/", "/testutils/")),
    (-70, ("/playground/", "/example/", "/examples/", "/demo/", "/demos/", "/sample/", "/samples/", "/fixture/", "/fixtures/")),
    (-60, ("/docs/", "/docs_src/", "/doc/", "/documentation/")),
    (-90, ("/vendor/", "/node_modules/", "/third_party/", "/external/", "/deps/")),
    (-50, ("/generated/", "/gen/")),
    (15, ("/src/", "/pkg/", "/lib/", "/crates/", "/packages/", "/internal/", "/cmd/")),
)
PLATFORM_FOLDERS = ("android/", "guava-gwt/")
GENERATED_ENDS = (
    ".pb.go", "_pb2.py", "_pb2_grpc.py", "_generated.go", "_gen.go", ".gen.go", ".generated.ts", ".generated.js", ".gen.ts", "__generated__",
    "_pb.d.ts", "_grpc.pb.go", ".g.dart",
)
# Base names and folders of files that the walker takes for generated.
GENERATED_SUFFIXES = (
    ".pb.go", "_pb2.py", "_pb2_grpc.py", "_generated.go", "_gen.go", ".gen.go", ".generated.go", ".generated.ts", ".generated.js", ".gen.ts",
    "_pb.d.ts", "_grpc.pb.go", ".g.dart", ".min.js",
)
LARGE_FILE = 3 * 1024 * 1024 + 256 * 1024


def ascii_lower(text: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its extension; empty for a dot-file."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def package_key(path: Column) -> Column:
    """`.` for a file at the root, else the first two parts of the path (which may be folder and file)."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.substring_index(path, "/", 2))


def symbol_id() -> Column:
    return F.concat_ws(":", "rel_path", "language", "kind", "name", F.col("start_line").cast("string"))


def node_id(name: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.sha2(name, 256), 1, 16))


def is_project_name(name: Column) -> Column:
    return ~name.isin(*BUILTINS) & (F.octet_length(name) > 2)


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in parts))


def symbol_score(kind: Column, path: Column) -> Column:
    """How likely a definition is the canonical one; each group of rules counts at most once."""
    p = F.lower(path)
    score = F.lit(0)
    for value, kinds in KIND_SCORES.items():
        score = score + F.when(kind.isin(*kinds), value).otherwise(0)
    for value, parts in PATH_SCORES:
        score = score + F.when(_contains_any(p, parts), value).otherwise(0)
    platform = _contains_any(p, tuple("/" + f for f in PLATFORM_FOLDERS)) | p.rlike("^(" + "|".join(map(re.escape, PLATFORM_FOLDERS)) + ")")
    generated = p.rlike("(" + "|".join(map(re.escape, GENERATED_ENDS)) + ")($|/)")
    score = score + F.when(platform, -50).otherwise(0) + F.when(generated, -70).otherwise(0)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return (score - 3 * slashes - F.floor(F.octet_length(path) / 10)).cast("int")


def is_generated(path: Column) -> Column:
    """Whether the walker leaves the file out as generated."""
    p = F.concat(F.lit("/"), F.lower(path))
    ends = "(" + "|".join(map(re.escape, GENERATED_SUFFIXES)) + ")$"
    return p.rlike("/(generated|__generated__)/") | p.rlike(ends) | p.rlike(r"_generated\.[^/]*$") | p.rlike(r"/src/(.*/)?parser(_abi[^/]*)?\.c$")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob in which ** is any number of parts and * ? [..] stay within a part."""
    parts = [p for p in pattern.strip("/").split("/")]
    out, k = "", 0
    while k < len(parts):
        part = parts[k]
        if part == "**":
            while k + 1 < len(parts) and parts[k + 1] == "**":
                k += 1
            out += "(?:[^/]+/)*" if k + 1 < len(parts) else "(?:[^/]+(?:/[^/]+)*)?"
        else:
            out += segment_regex(part) + ("/" if k + 1 < len(parts) else "")
        k += 1
    if out.endswith("/(?:[^/]+(?:/[^/]+)*)?"):  # a/** holds a itself
        out = out[: -len("/(?:[^/]+(?:/[^/]+)*)?")] + "(?:/[^/]+)*"
    return f"^{out}$"


def segment_regex(part: str) -> str:
    out, k = "", 0
    while k < len(part):
        c = part[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in part[k + 2 :]:
            end = part.index("]", k + 2)
            inner = part[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "^!" else inner).replace("[", r"\[") + "]"
            k = end
        elif c == "\\" and k + 1 < len(part):
            k += 1
            out += re.escape(part[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def path_matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches any pattern: a glob, or a piece of the path if there is nothing to glob. Blank patterns are ignored."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
    found = F.lit(False)
    for pattern in patterns:
        pattern = pattern.strip().replace("\\", "/").removeprefix("./")
        if not pattern:
            continue
        if not re.search(r"[*?\[]", pattern):
            found = found | clean.contains(pattern)
        found = found | F.regexp_replace(clean, "^/+|/+$", "").rlike(glob_regex(pattern))
    return found


def path_allowed(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    include = [p for p in include if p.strip()]
    return (path_matches(path, include) if include else F.lit(True)) & ~path_matches(path, list(exclude))


def in_scope(path: Column, scope: list[str] = (), exclude: list[str] = ()) -> Column:
    """The graphs' own rule: globs on the whole path or the base name, without ** or pieces. Null paths are in."""

    def matches(globs: list[str]) -> Column:
        found = F.lit(False)
        for g in globs:
            one = "^" + "/".join(segment_regex(s) for s in g.split("/")) + "$"
            found = found | path.rlike(one) | base_name(path).rlike(one)
        return found

    inside = ~matches(list(exclude)) & (matches(list(scope)) if scope else F.lit(True))
    return path.isNull() | inside


def looks_like_code(query: Column) -> Column:
    """Whether a search text may name code: three characters or more, no `*.` pattern, a letter or underscore, and at
    most half of it marks of regular expressions. Null is none."""
    marks = F.length(query) - F.length(F.translate(query, "\\^$.|?*+()[]{}", ""))
    return F.coalesce((F.length(query) >= 3) & ~query.startswith("*.") & query.rlike(r"[\p{L}_]") & (marks * 2 <= F.length(query)), F.lit(False))
