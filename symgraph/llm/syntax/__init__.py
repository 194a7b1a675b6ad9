"""Parsers that say whether a source file is syntactically valid: recursive descent with panic-mode recovery."""

from symgraph.llm.syntax.check import Report, check

__all__ = ["Report", "check"]
