"""The registry of languages, as a table and as a lookup."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages that can be parsed, with their extensions.
PARSEABLE = {
    "go": ".go", "python": ".py .pyw", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx .mts .cts", "rust": ".rs", "ruby": ".rb .rake .gemspec",
    "java": ".java", "c": ".c .h", "cpp": ".cpp .cc .hpp .cxx .hxx .hh", "csharp": ".cs", "dart": ".dart", "swift": ".swift", "kotlin": ".kt .kts",
    "lua": ".lua", "php": ".php", "bash": ".sh .bash .zsh", "scala": ".scala .sc", "yaml": ".yaml .yml", "elixir": ".ex .exs",
    "hcl": ".tf .hcl .tfvars", "protobuf": ".proto",
}
# Languages that are only recognised.
RECOGNISED = {
    "apex": ".cls .trigger", "zig": ".zig", "toml": ".toml", "json": ".json", "markdown": ".md", "sql": ".sql", "erlang": ".erl", "haskell": ".hs",
    "ocaml": ".ml .mli", "r": ".r .R", "perl": ".pl .pm", "vue": ".vue", "svelte": ".svelte",
}
BY_NAME = {"Makefile": "make", "makefile": "make", "GNUmakefile": "make", "Dockerfile": "dockerfile", "Jenkinsfile": "groovy", "CMakeLists.txt": "cmake"}
# Folders that a walk does not enter.
SKIPPED = ".git node_modules vendor .venv venv __pycache__ .tox .mypy_cache dist build .next .nuxt target .idea .vscode".split()

EXTENSIONS = {e: name for table in (PARSEABLE, RECOGNISED) for name, ends in table.items() for e in ends.split()}


def language(path: Column) -> Column:
    """The language of a path by its extension, then by its file name; null if neither is known. Case counts."""
    base = F.element_at(F.split(path, "/"), -1)
    lookup = lambda table, key: F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]
    return F.coalesce(lookup(EXTENSIONS, F.regexp_extract(base, r"(\.[^.]*)$", 1)), lookup(BY_NAME, base))


def language_of(base: str) -> str | None:
    dot = base.rfind(".")
    return EXTENSIONS.get(base[dot:] if dot >= 0 else "") or BY_NAME.get(base)


def registry(spark: SparkSession) -> DataFrame:
    """language, key (extension or file name), by_name, parseable."""
    rows = [(name, e, False, e in " ".join(PARSEABLE.values()).split()) for e, name in EXTENSIONS.items()]
    rows += [(name, base, True, False) for base, name in BY_NAME.items()]
    return spark.createDataFrame(rows, "language string, key string, by_name boolean, parseable boolean")
