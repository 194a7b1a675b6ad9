"""Symbols, imports and refs out of source text: a table function for whole files.

Python is read with its own parser. The other languages are read from text in which strings and comments are blanked:
declarations by a table of patterns for each language, spans by the brackets or `end`s that close them, parents by the
spans that hold them, calls by names before a bracket. No types are resolved.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.sources.languages import language


class Row(NamedTuple):
    """tag is symbol, import, ref or error; of the rest, what the tag needs is set."""

    tag: str
    name: str
    kind: str = ""
    start_line: int = 0
    end_line: int = 0
    start_col: int = 0
    end_col: int = 0
    parent: str = ""
    depth: int = 0
    signature: str = ""


class Rules(NamedTuple):
    symbols: list[tuple[str, str]]
    imports: str = ""
    conforms: str = ""
    closed_by: str = "brace"
    skip: frozenset[str] = frozenset()


_WORD = r"[A-Za-z_$][\w$]*"
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|export|default|readonly|virtual|partial|inline|data|suspend|lateinit|const|case|implicit|lazy|fileprivate|mutating|external|synchronized|native|declare)\s+)*"
_CONTROL = frozenset("if for while switch return catch when match do else try new throw typeof sizeof await yield in not and or super this self assert case with using".split())
#: Further words that are no names of calls, by language.
_KEYWORDS = {
    "go": frozenset("func import go defer select range type var const map chan interface struct".split()),
    "rust": frozenset("fn pub unsafe".split()),
    "kotlin": frozenset(["fun"]), "swift": frozenset(["func", "guard", "init"]), "ruby": frozenset(["def", "elsif", "unless", "until"]), "lua": frozenset(["function", "elseif", "until"]),
    "php": frozenset("function fn array isset empty list echo print foreach elseif".split()), "javascript": frozenset(["function", "constructor"]), "typescript": frozenset(["function", "constructor"]),
    "csharp": frozenset("lock foreach nameof".split()), "java": frozenset(["synchronized"]), "scala": frozenset(["def"]), "bash": frozenset(["function"]),
}

#: What declares a symbol, imports and conformance, by language. The group `n` is the name.
RULES: dict[str, Rules] = {
    "go": Rules(
        [
            (r"^func\s*\([^)]*\)\s*(?P<n>\w+)\s*(?:\[[^\]]*\])?\(", "method"), (r"^func\s+(?P<n>\w+)\s*(?:\[[^\]]*\])?\(", "function"),
            (r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b", "struct"), (r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b", "interface"),
            (r"^type\s+(?P<n>\w+)\s+=?\s*(?!struct\b|interface\b)[\w*\[(]", "type"), (r"^\s*const\s+(?P<n>\w+)", "constant"), (r"^\s*var\s+(?P<n>\w+)", "variable"),
        ],
        r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$',
    ),
    "javascript": Rules(
        [
            (rf"^\s*{_MODIFIERS}class\s+(?P<n>{_WORD})", "class"), (rf"^\s*{_MODIFIERS}function\s*\*?\s*(?P<n>{_WORD})", "function"),
            (rf"^\s*{_MODIFIERS}interface\s+(?P<n>{_WORD})", "interface"), (rf"^\s*{_MODIFIERS}type\s+(?P<n>{_WORD})\s*(?:<[^=]*>)?\s*=", "type"),
            (rf"^\s*{_MODIFIERS}(?:const\s+)?enum\s+(?P<n>{_WORD})", "enum"),
            (rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<n>{_WORD})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_WORD})\s*(?::[^=]+)?=>", "function"),
            (rf"^\s+{_MODIFIERS}(?:get\s+|set\s+|\*\s*)?(?P<n>{_WORD}|constructor)\s*(?:<[^>]*>)?\([^;{{]*\)\s*(?::[^{{;]+)?{{", "method"),
        ],
        r"""(?:^\s*import\b[^'"\n]*|^\s*export\b[^'"\n]*\bfrom\s*|\brequire\(\s*)['"`]([^'"`\n]+)['"`]""",
        r"(?:class|interface)\s+[\w$]+(?:<[^{]*?>)?\s*(?:extends\s+(?P<a>[^{]+?))?\s*(?:implements\s+(?P<b>[^{]+?))?\s*\{",
    ),
    "rust": Rules(
        [
            (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<n>\w+)", "function"),
            (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)", "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)", "enum"),
            (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)", "trait"), (r"^\s*(?:unsafe\s+)?impl(?:\s*<[^>{]*>)?\s+(?:[\w:<>, ']+\s+for\s+)?(?:\w+::)*(?P<n>\w+)", "impl"),
            (r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)", "type"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<n>[A-Z_]\w*)\s*:", "constant"),
            (r"^\s*(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(?P<n>\w+)\s*:", "variable"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)", "module"),
        ],
        r"^\s*((?:pub\s+)?use\s[^;]+;)", r"\bimpl(?:\s*<[^>{]*>)?\s+(?P<a>[\w:]+(?:<[^{]*?>)?)\s+for\s",
    ),
    "java": Rules(
        [
            (rf"^\s*{_MODIFIERS}class\s+(?P<n>\w+)", "class"), (rf"^\s*{_MODIFIERS}@?interface\s+(?P<n>\w+)", "interface"), (rf"^\s*{_MODIFIERS}enum\s+(?P<n>\w+)", "enum"),
            (r"^\s*(?:public|private|protected)\s+(?P<n>[A-Z]\w*)\s*\([^;{]*\)\s*(?:throws\s+[\w., ]+)?\{", "constructor"),
            (rf"^\s*{_MODIFIERS}(?:<[^>]+>\s+)?(?!return\b|throw\b|new\b|else\b)\w[\w.<>\[\], ?]*\s+(?P<n>\w+)\s*\([^;{{]*\)\s*(?:throws\s+[\w., ]+)?[{{;]", "method"),
            (r"^\s*(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w.<>\[\], ?]+\s+(?P<n>\w+)\s*(?:=[^;]*)?;", "field"),
        ],
        r"^\s*(import\s[^;]+;)", r"(?:class|interface)\s+\w+(?:<[^{]*?>)?\s*(?:extends\s+(?P<a>[^{]+?))?\s*(?:implements\s+(?P<b>[^{]+?))?\s*\{",
    ),
    "c": Rules(
        [
            (r"^(?!\s*(?:return|else|typedef|if|for|while|switch)\b)[A-Za-z_][\w\s*]*?[\s*](?P<n>\w+)\s*\([^;{}]*\)\s*\{", "function"), (r"^\s*(?:typedef\s+)?struct\s+(?P<n>\w+)\s*\{", "struct"),
            (r"^\s*(?:typedef\s+)?enum\s+(?P<n>\w+)\s*\{", "enum"), (r"^\s*typedef\s[^;{}]*?(?P<n>\w+)\s*;", "type"),
        ],
        r'^\s*#\s*include\s*[<"]([^>"\n]+)[>"]',
    ),
    "csharp": Rules(
        [(rf"^\s*{_MODIFIERS}{k}\s+(?P<n>[\w.]+)", k) for k in ("namespace", "class", "struct", "interface", "enum", "record")]
        + [(rf"^\s*{_MODIFIERS}delegate\s+[\w<>\[\]?]+\s+(?P<n>\w+)", "delegate"), (rf"^\s*{_MODIFIERS}[\w.<>\[\], ?]+\s+(?P<n>\w+)\s*\([^;{{]*\)\s*(?:where[^{{]+)?(?:{{|=>)", "method"),
           (rf"^\s*{_MODIFIERS}[\w.<>\[\]?]+\s+(?P<n>\w+)\s*{{\s*(?:get|set|init)", "property"), (r"^\s*(?:(?:public|private|protected|static|readonly)\s+)+[\w.<>\[\]?]+\s+(?P<n>\w+)\s*(?:=[^;]*)?;", "field")],
        r"^\s*(?:global\s+)?using\s+(?:static\s+|\w+\s*=\s*)?([\w.]+)\s*;", r"(?:class|struct|interface|record)\s+\w+(?:<[^{]*?>)?\s*:\s*(?P<a>[^{]+?)\s*\{",
    ),
    "kotlin": Rules(
        [(rf"^\s*{_MODIFIERS}enum\s+class\s+(?P<n>\w+)", "enum"), (rf"^\s*{_MODIFIERS}(?:annotation\s+)?class\s+(?P<n>\w+)", "class"), (rf"^\s*{_MODIFIERS}interface\s+(?P<n>\w+)", "interface"),
         (rf"^\s*{_MODIFIERS}(?:companion\s+)?object\s+(?P<n>\w+)", "object"), (rf"^\s*{_MODIFIERS}fun\s+(?:<[^>]+>\s*)?(?:[\w.<>?]+\.)?(?P<n>\w+)\s*\(", "function"),
         (r"^\s*const\s+val\s+(?P<n>\w+)", "constant"), (rf"^\s*{_MODIFIERS}va[lr]\s+(?P<n>\w+)", "variable"), (r"^\s*typealias\s+(?P<n>\w+)", "type")],
        r"^\s*import\s+([\w.*]+)", r"(?:class|interface|object)\s+\w+(?:<[^>]*>)?\s*(?:\([^)]*\))?\s*:\s*(?P<a>[^{\n]+)",
    ),
    "scala": Rules(
        [(rf"^\s*{_MODIFIERS}class\s+(?P<n>\w+)", "class"), (rf"^\s*{_MODIFIERS}trait\s+(?P<n>\w+)", "interface"), (rf"^\s*{_MODIFIERS}object\s+(?P<n>\w+)", "object"),
         (rf"^\s*{_MODIFIERS}def\s+(?P<n>\w+)", "function"), (rf"^\s*{_MODIFIERS}va[lr]\s+(?P<n>\w+)", "variable")],
        r"^\s*(import\s[^\n;]+)", r"(?:class|trait|object)\s+\w+[^{\n]*?\bextends\s+(?P<a>[^{\n]+)",
    ),
    "swift": Rules(
        [(rf"^\s*{_MODIFIERS}{k}\s+(?P<n>\w+)", k) for k in ("struct", "class", "actor", "enum", "extension", "protocol")]
        + [(rf"^\s*{_MODIFIERS}func\s+(?P<n>\w+)", "function"), (rf"^\s*{_MODIFIERS}(?P<n>init)\s*[?!]?\(", "constructor"), (r"^\s*(?P<n>deinit)\s*\{", "destructor"),
           (rf"^\s*{_MODIFIERS}let\s+(?P<n>\w+)", "constant"), (rf"^\s*{_MODIFIERS}var\s+(?P<n>\w+)", "variable"), (r"^\s*typealias\s+(?P<n>\w+)", "type")],
        r"^[ \t]*import[ \t]+(?:\w+[ \t]+)?([\w.]+)", r"(?:struct|class|actor|enum|extension|protocol)\s+\w+(?:<[^{]*?>)?\s*:\s*(?P<a>[^{]+?)\s*\{",
    ),
    "dart": Rules(
        [(rf"^\s*{_MODIFIERS}class\s+(?P<n>\w+)", "class"), (r"^\s*enum\s+(?P<n>\w+)", "enum"), (r"^\s*mixin\s+(?P<n>\w+)", "mixin"), (r"^\s*extension\s+(?P<n>\w+)", "extension"),
         (r"^\s*typedef\s+(?P<n>\w+)", "type"), (r"^\s*[\w<>?, ]+\s+get\s+(?P<n>\w+)", "getter"), (r"^\s*set\s+(?P<n>\w+)", "setter"), (rf"^\s*{_MODIFIERS}[\w<>?]+\s+(?P<n>\w+)\s*\([^;{{]*\)\s*(?:async\s*)?(?:{{|=>)", "function")],
        r"""^\s*(?:import|export|part)\s+['"]([^'"]+)['"]""", r"class\s+\w+(?:<[^{]*?>)?\s*(?:extends\s+(?P<a>[\w<>., ]+?))?\s*(?:with\s+(?P<c>[\w<>., ]+?))?\s*(?:implements\s+(?P<b>[^{]+?))?\s*\{",
    ),
    "php": Rules(
        [(rf"^\s*{_MODIFIERS}{k}\s+(?P<n>[\w\\]+)", k) for k in ("namespace", "class", "interface", "trait", "enum")]
        + [(rf"^\s*{_MODIFIERS}function\s+&?(?P<n>\w+)", "function"), (rf"^\s*{_MODIFIERS}const\s+(?P<n>\w+)", "constant")],
        r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)", r"(?:class|interface|enum)\s+\w+\s*(?:extends\s+(?P<a>[^{]+?))?\s*(?:implements\s+(?P<b>[^{]+?))?\s*\{",
    ),
    "ruby": Rules(
        [(r"^\s*def\s+(?:self\.)?(?P<n>\w+[?!=]?)", "method"), (r"^\s*class\s+(?:\w+::)*(?P<n>\w+)", "class"), (r"^\s*module\s+(?:\w+::)*(?P<n>\w+)", "module")],
        r"""^\s*require(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]""", r"(?:class\s+\w+\s*<\s*(?P<a>[\w:]+)|^\s*(?:include|extend|prepend)\s+(?P<b>[\w:]+))", "end",
    ),
    "lua": Rules(
        [(r"^\s*(?:local\s+)?function\s+(?:\w+\.)*\w+:(?P<n>\w+)", "method"), (r"^\s*(?:local\s+)?function\s+(?:\w+\.)*(?P<n>\w+)\s*\(", "function"), (r"^\s*(?:local\s+)?(?:\w+\.)*(?P<n>\w+)\s*=\s*function\b", "function")],
        r"""\brequire\s*\(?\s*['"]([^'"]+)['"]""", "", "end", frozenset(["require"]),
    ),
    "elixir": Rules(
        [(r"^\s*defmodule\s+(?:\w+\.)*(?P<n>\w+)", "module"), (r"^\s*defmacrop?\s+(?P<n>\w+[?!]?)", "macro"), (r"^\s*defp?\s+(?P<n>\w+[?!]?)", "function"), (r"^\s*defprotocol\s+(?P<n>\w+)", "interface")],
        r"^\s*(?:alias|import|use|require)\s+([\w.]+)", "", "end", frozenset("def defp defmodule defmacro defmacrop defprotocol defstruct alias import use require".split()),
    ),
    "bash": Rules([(r"^\s*(?:function\s+)?(?P<n>[\w-]+)\s*\(\s*\)\s*\{", "function"), (r"^\s*function\s+(?P<n>[\w-]+)\s*\{", "function")], r"^\s*(?:source|\.)\s+([^\s;]+)"),
    "hcl": Rules(
        [(r'^\s*resource\s+"(?P<n>[^"]+"\s+"[^"]+)"', "resource"), (r'^\s*(?:module|provider)\s+"(?P<n>[^"]+)"', "module"), (r'^\s*(?:variable|output)\s+"(?P<n>[^"]+)"', "variable"),
         (r'^\s*data\s+"(?P<n>[^"]+"\s+"[^"]+)"', "variable"), (r"^\s*(?P<n>terraform)\s*\{", "module"), (r"^\s*(?P<n>locals)\s*\{", "variable")],
    ),
    "protobuf": Rules([(r"^\s*message\s+(?P<n>\w+)", "struct"), (r"^\s*enum\s+(?P<n>\w+)", "enum"), (r"^\s*service\s+(?P<n>\w+)", "interface"), (r"^\s*rpc\s+(?P<n>\w+)", "method")], r'^\s*import\s+(?:public\s+|weak\s+)?"([^"]+)"'),
}
RULES["typescript"] = RULES["javascript"]
RULES["cpp"] = RULES["c"]._replace(conforms=r"(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*(?P<a>[^{;]+?)\s*\{")
SUPPORTED = frozenset([*RULES, "python"])
_HASH_COMMENTS = frozenset(["ruby", "bash", "elixir", "hcl", "php"])
_DOTTED = frozenset(["hcl", "protobuf"])

_WITH_PARAMETERS = frozenset("function method constructor macro getter setter delegate destructor".split())

_BLANK = {
    "slash": re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`[^`]*`", re.S),
    "script": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S),
    "hash": re.compile(r"#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", re.S),
    "dash": re.compile(r"--\[\[.*?\]\]|--[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S),
}


def blanked(text: str, lang: str) -> str:
    """The text with strings and comments as spaces; lines and columns stay."""
    way = "script" if lang in ("javascript", "typescript", "dart") else "dash" if lang == "lua" else "hash" if lang in _HASH_COMMENTS else "slash"
    return _BLANK[way].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def call_name(text: str, lang: str) -> str:
    """The name of a call: what follows the last dot (for C also -> and ::); Rust paths stay whole."""
    name = text.strip()
    if lang in ("c", "cpp"):
        name = re.split(r"\.|->|::", name)[-1]
    elif lang == "lua":
        name = re.split(r"[.:]", name)[-1]
    else:
        name = name.rsplit(".", 1)[-1]
    return "" if re.search(r"[()\[\]{}]", name) else name


def type_name(text: str) -> str:
    name = re.split(r"[<\[(]", text.strip())[0].strip()
    return re.split(r"\.|::|\\", name)[-1].strip().removeprefix("public ").removeprefix("private ").strip()


def extract(text: str, lang: str) -> Iterator[Row]:
    """The rows of one file, in the order of the text. Languages without rules give nothing."""
    if lang == "python":
        yield from _python(text)
    elif lang in RULES:
        yield from _scanned(text, lang, RULES[lang])


def _scanned(text: str, lang: str, rules: Rules) -> Iterator[Row]:
    clean = blanked(text, lang)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    last = len(clean.rstrip()) - 1
    partner = _partners(clean) if rules.closed_by != "end" else {}

    def line(at: int) -> int:
        return bisect_right(starts, at)

    found: list[tuple[int, int, str, str]] = []
    taken: set[int] = set()
    keywords = _CONTROL | _KEYWORDS.get(lang, frozenset())
    for pattern, kind in rules.symbols:
        for m in re.finditer(pattern, text if lang == "hcl" else clean, re.M):
            at = m.start("n")
            if at in taken or m.group("n") in keywords - {"constructor", "init"}:
                continue
            taken.add(at)
            name = re.sub(r'"\s+"', ".", m.group("n"))
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            found.append((begin, _closing(clean, m.end("n"), rules.closed_by, lang, partner, last), name, kind))
    found.sort()
    rows: list[tuple[int, Row]] = []
    open_: list[tuple[int, str]] = []
    for begin, end, name, kind in found:
        while open_ and open_[-1][0] < begin:
            open_.pop()
        a, z = line(begin), line(end)
        stop = _HEAD_END.search(text, begin, end + 1)
        head = text[begin : stop.start() if stop else end + 1].strip()
        signature = head[:120] if kind in ("struct", "class", "interface", "trait", "object", "enum", "mixin", "extension") else _parameters(text, clean, begin, end) if kind in _WITH_PARAMETERS else ""
        rows.append((begin, Row("symbol", name, kind, a, z, begin - starts[a - 1], end - starts[z - 1] + 1, open_[-1][1] if open_ else "", len(open_), signature)))
        open_.append((end, name))
    if rules.imports:
        for m in re.finditer(rules.imports, text, re.M):
            if lang != "go" or "import" in m.group() or _in_imports(clean, m.start()):
                rows.append((m.start(), Row("import", m.group(1).strip(), start_line=line(m.start(1)))))
    if rules.conforms:
        for m in re.finditer(rules.conforms, clean, re.M):
            for part in filter(None, m.groupdict().values()):
                for base in re.split(r",(?![^<]*>)|\bwith\b", part):
                    if name := type_name(base):
                        rows.append((m.start(), Row("ref", name, "implements", line(m.start()))))
    interfaces = [(b, e) for b, e, _, k in found if k == "interface"]
    if lang not in _DOTTED:
        joiner = r"(?:::|\.)" if lang != "rust" else r"(?:\.|::)"
        for m in re.finditer(rf"(?<![\w$])({_WORD}(?:\s*(?:{joiner}|->|:)\s*{_WORD})*)\s*(?:::<[^>()]*>|<[\w, ]+>)?\(", clean):
            word = m.group(1)
            at = m.start(1) + len(word) - len(re.split(r"[.:>]", word)[-1].lstrip())
            name = call_name(re.sub(r"\s+", "", word), lang)
            if not name or name in keywords or name in rules.skip or at in taken or (lang == "java" and _after_new(clean, m.start())):
                continue
            if lang == "go" and not clean[starts[line(m.start()) - 1] : m.start()].strip() and any(b < m.start() < e for b, e in interfaces):
                continue  # a method that an interface asks for
            rows.append((m.start(), Row("ref", name, "call", line(m.start()))))
    if lang == "kotlin" and not _balanced(clean):
        known = {(name, kind) for _, _, name, kind in found}
        told = {(r.name, r.start_line) for _, r in rows if r.kind == "implements"}
        for at, name, kind, head, bases in _top_types(clean):
            n, end = line(at), clean.find("\n", at)
            if (name, kind) not in known:
                rows.append((at, Row("symbol", name, kind, n, n, at - starts[n - 1], (end if end >= 0 else len(clean)) - starts[n - 1], signature=head)))
            rows += [(at, Row("ref", b, "implements", n)) for b in bases if (b, n) not in told]
    if lang == "go":
        for m in re.finditer(r"(?:[&=(,:{]|return)\s*(?:\w+\.)?([A-Z]\w*)\{", clean):
            rows.append((m.start(1), Row("ref", m.group(1), "use", line(m.start(1)))))
    rows.sort(key=lambda r: r[0])
    yield from (r for _, r in rows)


#: A type declared on a line of Kotlin, after annotations and modifiers.
_KOTLIN_TYPE = re.compile(
    r"[ \t]*(?P<before>(?:@[^\s(]+(?:\([^)]*\))?\s+|(?:public|private|protected|internal|abstract|final|open|sealed|data|value|inline|annotation|enum|fun)\s+)*)"
    r"(?P<k>interface|object|class)[ \t]+(?P<n>\w+)"
)


def _balanced(clean: str) -> bool:
    """Whether all brackets of a text close in order; a damaged text mostly has some that don't."""
    open_, of = [], {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", clean):
        c = m.group()
        if c in "([{":
            open_.append(c)
        elif not open_ or open_.pop() != of[c]:
            return False
    return not open_


def _top_types(clean: str) -> Iterator[tuple[int, str, str, str, list[str]]]:
    """The types of a damaged Kotlin text that begin on a line outside all braces: place, name, kind, head, supertypes."""
    depth = at = 0
    for text in clean.split("\n"):
        m = _KOTLIN_TYPE.match(text) if depth == 0 else None
        if m:
            kind = "enum" if m["k"] == "class" and "enum" in m["before"].split() else m["k"]
            yield at + len(text) - len(text.lstrip()), m["n"], kind, text.split("{", 1)[0].strip(), _supertypes(text[m.end() :])
        depth = max(0, depth + text.count("{") - text.count("}"))
        at += len(text) + 1


def _supertypes(rest: str) -> list[str]:
    """The types after the colon of a declaration; colons and commas within brackets are none of these."""
    parts, level, begun = [""], 0, False
    for c in re.split(r"\bwhere\b", rest.split("{", 1)[0])[0]:
        level += (c in "(<[") - (c in ")>]" and level > 0)
        if level == 0 and c == ":" and not begun:
            begun = True
        elif level == 0 and c == "," and begun:
            parts.append("")
        elif begun:
            parts[-1] += c
    return [name for p in parts if (name := type_name(re.split(r"\bby\b", p)[0]))]


def _in_imports(clean: str, at: int) -> bool:
    start = clean.rfind("import", 0, at)
    return start >= 0 and clean.find(")", start, at) < 0 and clean.find("(", start, at) >= 0


def _after_new(clean: str, at: int) -> bool:
    while at and clean[at - 1].isspace():
        at -= 1
    return clean.endswith("new", 0, at)


_HEAD_END = re.compile(r"[\n{]")
_BRACE = re.compile(r"[{}]")
_ENDS = re.compile(r"\b(end|do|def|class|module|if|unless|case|begin|while|until|for|function|repeat|fn|defmodule|defp|defmacro|defprotocol)\b|\n")
_MARKS = re.compile(r"[(){}\[\];\n]")
_GOES_ON = re.compile(r"\s*(\{|extends|implements|where|:|=>|throws)")
_PARAMETERS_END = re.compile(r"[{;]|=>|\)[ \t]*\n")


def _partners(clean: str) -> dict[int, int]:
    """Where each brace closes, found in one pass."""
    out, open_ = {}, []
    for m in _BRACE.finditer(clean):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def _closing(clean: str, at: int, way: str, lang: str, partner: dict[int, int], last: int) -> int:
    """Where the declaration that goes on at `at` ends; `last` is where the text does."""
    depth = 0
    if way == "end":
        for m in _ENDS.finditer(clean, at):
            w = m.group()
            if w == "end":
                if depth == 0:
                    return m.end() - 1
                depth -= 1
            elif w in ("if", "unless"):
                depth += not clean[clean.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
            elif w in ("do", "function", "case", "begin", "def", "class", "module", "fn") and not (w == "do" and lang == "elixir" and depth == 0):
                depth += 1
        return last
    for m in _MARKS.finditer(clean, at):
        c = m.group()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{" and depth <= 0:
            return partner.get(m.start(), last)
        elif c == ";" and depth <= 0 or (c == "\n" and depth <= 0 and not _GOES_ON.match(clean, m.end())):
            return max(at, m.start() - (c == "\n"))
        elif c == "}":
            return max(at, m.start() - 1)
    return last


def _parameters(text: str, clean: str, begin: int, end: int) -> str:
    a = clean.find("(", begin, end + 1)
    if a < 0:
        return ""
    stop = _PARAMETERS_END.search(clean, a, end + 1)
    return " ".join(text[a : stop.start() + (stop.group()[0] == ")") if stop else end + 1].split())[:120]


def _python(text: str) -> Iterator[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield Row("error", str(e))
        return
    yield from _python_nodes(tree, _LINE.findall(text), [])


#: Lines as the parser counts them.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$")


def _segment(lines: list[str], node: ast.AST) -> str:
    """The source of a node; columns count bytes."""
    cut = [x.encode() for x in lines[node.lineno - 1 : node.end_lineno]]
    cut[-1] = cut[-1][: node.end_col_offset]
    cut[0] = cut[0][node.col_offset :]
    return b"".join(cut).decode()


def _python_nodes(node: ast.AST, lines: list[str], holders: list[str]) -> Iterator[Row]:
    for child in ast.iter_child_nodes(node):
        inner = holders
        if isinstance(child, ast.Import | ast.ImportFrom):
            yield Row("import", _segment(lines, child), start_line=child.lineno)
        if isinstance(child, ast.Call):
            f = child.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
            if name:
                yield Row("ref", name, "call", child.lineno)
        if isinstance(child, ast.ClassDef):
            for base in child.bases:
                b = base.value if isinstance(base, ast.Subscript) else base
                name = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else ""
                if name:
                    yield Row("ref", name, "implements", child.lineno)
        if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
            if isinstance(child, ast.ClassDef):
                kind, signature = "class", (lines[child.lineno - 1].strip().rstrip(":"))[:120]
            else:
                kind, signature = "function", f"({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
            yield Row("symbol", child.name, kind, first, child.end_lineno or first, child.col_offset, child.end_col_offset or 0, holders[-1] if holders else "", len(holders), signature)
            inner = [*holders, child.name]
        yield from _python_nodes(child, lines, inner)


_SCHEMA = (
    "file_id long, seq int, tag string, name string, kind string, start_line int, end_line int, start_col int, end_col int, parent string, depth int, "
    "signature string, language string, hash string"
)


_KINDS = {c.split()[0]: {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in _SCHEMA.split(", ")}


def parsed(files: DataFrame) -> DataFrame:
    """The tagged rows of files (file_id, language, content), with the order in the file (seq) and the SHA-256 of the text.

    One pass reads, parses and hashes. A file that fails gives an `error` row, one without rows a `file` row. Files of
    null content or of a language without rules are left out. Parsing takes far longer than the texts' size tells, so
    they are spread over spark.sql.shuffle.partitions tasks, which are not joined again.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = files.select("file_id", "language", "content").filter(F.col("content").isNotNull() & F.col("language").isin(*sorted(SUPPORTED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                try:
                    got = [Row("file", ""), *extract(text, lang)]
                except Exception as e:  # noqa: BLE001 - one file must not end the job
                    got = [Row("error", f"{type(e).__name__}: {e}")]
                rows += [(file_id, seq, *row, lang, digest) for seq, row in enumerate(got)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS.values(), strict=True)], list(_KINDS))

    return wanted.repartition(tasks, "file_id").mapInArrow(run, _SCHEMA)


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols, refs and imports out of tagged rows.

    Ids keep the order within a file and stay the same from run to run: 43 bits of the file, 20 of the place in it.
    """
    key = (F.shiftleft(F.pmod("file_id", F.lit(1 << 43)), 20) + F.col("seq")).alias("id")
    symbols = rows.filter("tag = 'symbol'").select(key, "file_id", "name", "kind", "language", "start_line", "end_line", "start_col", "end_col", "parent", "depth", "signature")
    refs = rows.filter("tag = 'ref'").select(key, "file_id", F.col("start_line").alias("line"), "name", "language", "kind")
    return symbols, refs, rows.filter("tag = 'import'").select(key, "file_id", F.col("name").alias("raw_path"), "language")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language(F.col("rel_path")))
