"""Checks one source text."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from typing import NamedTuple

from symgraph.llm.syntax.base import Fault, Parser, brackets, kinds_of
from symgraph.llm.syntax.clike import C, C_LEXER, GO_LEXER, JAVA_LEXER, Go, Java, preprocess
from symgraph.llm.syntax.python import PYTHON_LEXER, Python
from symgraph.llm.syntax.rust import RUST_LEXER, Rust
from symgraph.llm.syntax.script import SCRIPT_LEXER, Script, Typed

_LEXERS = {"c": C_LEXER, "go": GO_LEXER, "java": JAVA_LEXER, "python": PYTHON_LEXER, "rust": RUST_LEXER, "javascript": SCRIPT_LEXER, "typescript": SCRIPT_LEXER}
_PARSERS: dict[str, type[Parser]] = {"c": C, "go": Go, "java": Java, "python": Python, "rust": Rust, "javascript": Script, "typescript": Typed}
LANGUAGES = frozenset(_PARSERS)


class Report(NamedTuple):
    """Whether a text is valid (None: it is nested too deeply to tell), and its errors in order: (line, cause)."""

    valid: bool | None
    errors: list[tuple[int, str]]


def check(text: str, language: str) -> Report:
    """Parses `text`; a text without tokens is valid. Raises KeyError for a language without a parser."""
    lexer = _LEXERS[language]
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    early: list[tuple[int, str]] = []
    source = text
    if "\0" in text and language in ("python", "go"):
        early.append((text.count("\n", 0, text.index("\0")) + 1, "null byte"))
    if language == "c":
        source, found = preprocess(text)
        early += [(text.count("\n", 0, at) + 1, cause) for at, cause in found]
    codes = lexer.codes(source)
    kinds = kinds_of(codes)
    partner, faults = brackets(codes)
    parser = _PARSERS[language](kinds, codes, partner, getattr(lexer, "fresh", "") if language in ("javascript", "typescript") else "")
    parser.file()
    found = {*faults, *parser.faults}
    if not (found or early or parser.deep):
        return Report(True, [])
    script = language in ("javascript", "typescript")
    if script:
        lexer.kinds(source)
    places = None if script else lexer.places(source)
    starts = lexer.at if script else lexer.offsets(source)
    breaks = [m.start() for m in re.finditer("\n", source)]

    def line(fault: Fault) -> int:
        k = min(fault.token, len(kinds) - 1)
        if script:
            at = starts[min(k, len(starts) - 1)]
        else:
            number = places[k] if places else k
            at = starts[number] if number < len(starts) else len(source)
        return bisect_left(breaks, at) + 1

    if not found and not early:
        return Report(None, [(line(parser.deep), parser.deep.cause)])
    return Report(False, sorted(early + [(line(f), f.cause) for f in found]))
