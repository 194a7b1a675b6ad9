"""Text forms of results: a versioned JSON envelope and front matter."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

VERSION = "0.1"
_SPECIAL = ("#", "-", "?", ":", "{", "[", "&", "*", "!", "|", ">", "@", "`")


def envelope(df: DataFrame, limit: int = 10_000) -> str:
    """The rows as JSON, for what a person or a tool reads. More than `limit` rows say so by `"more": true`; whole
    tables are written by `write_json`."""
    rows = [json.loads(r) for r in df.limit(limit + 1).toJSON().collect()]
    more = {"more": True} if len(rows) > limit else {}
    return json.dumps({"version": VERSION, "results": rows[:limit], **more}, indent=2, ensure_ascii=False)


def write_json(df: DataFrame, path: str) -> None:
    """All rows as lines of JSON, written by the executors."""
    df.write.json(path)


def plain_value(value: str) -> str:
    """A value of front matter, quoted where it would not stand for itself."""
    risky = value.strip() != value or value.startswith(_SPECIAL) or any(x in value for x in ("\r", "\n", "\t", ": ", " #")) or value in ("", "---", "...")
    return json.dumps(value, ensure_ascii=False) if risky else value


def front_matter(meta: list[tuple[str, str]], content: str = "") -> str:
    head = "".join(["---\n", *[f"{k}: {plain_value(v)}\n" for k, v in meta], "---\n"])
    return head + content + ("\n" if content and not content.endswith("\n") else "")


def human_size(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            break
        size /= 1024
    return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"
