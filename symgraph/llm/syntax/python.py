"""Python 3.12."""

from __future__ import annotations

import re

from symgraph.llm.syntax.base import CODES, END, NAME, NUMBER, TEXT, Bad, Fault, Lexer, Parser, brackets, coded
from symgraph.llm.syntax.clike import levels

_PREFIX = r"(?:[rR][bB]|[bB][rR]|[rRbBuU])?"
_FPREFIX = r"(?:[fF][rR]|[rR][fF]|[fF])"
_FIELD = r"\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\}"
_FIELD3 = r"\{(?:[^{}]|\{[^{}]*\})*\}"


def _quoted(q: str, prefix: str, field: str = "") -> str:
    inner = "{" if field else ""
    extra = rf"|\{{\{{|{field}|\{{" if field else ""
    return rf"{prefix}{q}(?:[^{q}\\\n\r{inner}]|\\(?:\r\n|.){extra})*+{q}"


def _tripled(q: str, prefix: str, field: str = "") -> str:
    inner = "{" if field else ""
    extra = rf"|\{{\{{|{field}|\{{" if field else ""
    return rf"{prefix}{q * 3}(?:[^{q}\\{inner}]|\\.|{q}(?!{q * 2}){extra})*+{q * 3}"


_STRINGS = "|".join(
    [_tripled('"', _FPREFIX, _FIELD3), _tripled("'", _FPREFIX, _FIELD3), _quoted('"', _FPREFIX, _FIELD), _quoted("'", _FPREFIX, _FIELD)]
    + [_tripled('"', _PREFIX), _tripled("'", _PREFIX), _quoted('"', _PREFIX), _quoted("'", _PREFIX)]
)
_SPLIT_FIELD = re.compile(r"\{\{|\}\}|\{|\}|[^{}]+")


class PythonLexer(Lexer):
    def kind(self, token: str) -> str:
        c = token[:1]
        if c in ("\n", "\r"):
            return "line"
        if len(token) > 1 and token[-1] in "\"'":
            head = token[: token.index(token[-1])].lower() if token[-1] in token[:-1] else token
            if head.isalpha() or not head:
                if "f" in head and not self.fields(token, head):
                    return "damage f-string"
                return TEXT
        if c.isdigit() and re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", token):
            return "damage number"
        return super().kind(token)

    def special(self, token: str) -> str:
        if token[0] in "\"'":
            return f"unterminated {token[0]}"
        return super().special(token)

    def fields(self, token: str, head: str) -> bool:
        """Whether the fields of an f-string hold expressions."""
        q = len(head) + (3 if token[len(head) : len(head) + 3] in ('"""', "'''") and len(token) >= len(head) + 6 else 1)
        return _good_fields(token[q : len(token) - (q - len(head))], "r" not in head)

    def kinds(self, text: str) -> list[str]:
        self.known = known = self.fresh_known()
        kind, out, places = self.kind, [], []
        indents, depth, pending, blank = [(0, 0)], 0, "", True
        last_line = False
        for n, t in enumerate(self.pattern.findall("\n" + text)):
            k = known.get(t)
            if k is None:
                k = kind(t)
                if len(t) < 60:
                    known[t] = k
            if k == "line":
                if depth <= 0:
                    if not blank:
                        out.append("newline")
                        places.append(n)
                        blank = True
                    pending, last_line = t, True
                continue
            if k == END and not blank:
                out.append("newline")
                places.append(n)
            if last_line or k == END:
                last_line = False
                tail = pending.lstrip("\r\n").rpartition("\f")[2] if k != END else ""
                column = len(tail.expandtabs(8)), len(tail.expandtabs(1))
                if k == END:
                    column = (0, 0)
                if column != indents[-1]:
                    if column[0] > indents[-1][0] and column[1] > indents[-1][1]:
                        indents.append(column)
                        out.append("indent")
                        places.append(n)
                    elif (column[0] - indents[-1][0]) * (column[1] - indents[-1][1]) <= 0:
                        out.append("damage tabs")
                        places.append(n)
                    else:
                        while column[0] < indents[-1][0]:
                            indents.pop()
                            out.append("dedent")
                            places.append(n)
                        if column != indents[-1]:
                            out.append("damage indentation")
                            places.append(n)
            if k in ("(", "[", "{"):
                depth += 1
            elif k in (")", "]", "}"):
                depth -= 1
            blank = False
            out.append(k)
            places.append(n)
        self.placed = places
        return out

    def codes(self, text: str) -> str:
        return coded(self.kinds(text))

    def places(self, text: str) -> list[int]:
        self.kinds(text)
        return self.placed

    def offsets(self, text: str) -> list[int]:
        return [max(0, x - 1) for x in super().offsets("\n" + text)]


PYTHON_LEXER = PythonLexer(
    r"(?:\r\n|\r|\n)[ \t\f]*|[^\W\d]\w*+(?![\"'])|" + _STRINGS + r"|(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)|[^\W\d]\w*",
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not "
    "or pass raise return try while with yield",
    "( ) [ ] { } + - * ** / // % @ << >> & | ^ ~ := < > <= >= == != -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= , : . ; = ... !",
    r"[ \t\f﻿]+|\\(?:\r\n|\n|\r)|#[^\n\r]*",
    "match case type _",
)


def _good_fields(body: str, escapes: bool) -> bool:
    k, n = 0, len(body)
    while k < n:
        c = body[k]
        if c == "\\" and escapes:
            k += 2
            if body.startswith("N{", k - 1) and "}" in body[k:]:
                k = body.index("}", k) + 1
            continue
        if c == "}":
            if not body.startswith("}}", k):
                return False
            k += 2
            continue
        if c != "{":
            k += 1
            continue
        if body.startswith("{{", k):
            k += 2
            continue
        depth, start, k = 0, k + 1, k + 1
        cut = -1
        quote = ""
        while k < n:
            c = body[k]
            if quote:
                if c == quote:
                    quote = ""
            elif c in "\"'":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "}":
                if depth == 0:
                    break
                depth -= 1
            elif c in ":!" and depth == 0 and cut < 0 and body[k + 1 : k + 2] != "=":
                cut = k
                if c == ":" or re.match(r"![rsa]\s*:", body[k:]):
                    # the rest is a format, in which only fields count
                    d = 0
                    while k < n and not (body[k] == "}" and d == 0):
                        d += (body[k] == "{") - (body[k] == "}")
                        k += 1
                    break
            k += 1
        if k >= n:
            return False
        end = cut if cut >= 0 else k
        part = re.sub(r"(?<![=!<>])=\s*$", "", body[start:end])
        if not part.strip() or not is_expression(part):
            return False
        if cut >= 0:
            rest = body[cut:k]
            form = rest.partition(":")
            if form[0] not in ("", "!r", "!s", "!a") and not re.fullmatch(r"![rsa]\s*", form[0]):
                return False
            if form[2] and not _good_fields(form[2], escapes):
                return False
        k += 1
    return True


def is_expression(text: str) -> bool:
    lexer = PythonLexer.__new__(PythonLexer)
    lexer.__dict__.update(PYTHON_LEXER.__dict__)
    kinds = lexer.kinds(f"({text})\n")
    codes = coded(kinds)
    partner, faults = brackets(codes)
    parser = Python(kinds, codes, partner)
    parser.file()
    return not faults and not parser.faults


_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_NEWLINE, _INDENT = CODES["newline"], CODES["indent"]
#: What an expression is to an assignment.
ONE, MANY, STAR, NONE = "one", "many", "star", "none"


class Python(Parser):
    BINARY = levels("|", "^", "&", "<< >>", "+ -", "* / // % @")
    seen: dict[str, int] = {}

    def remembered(self, name: str, rule) -> None:
        p, codes = self.p, self.codes
        q = codes.find(_NEWLINE, p)
        if q >= 0 and codes[q + 1 : q + 2] == _INDENT:
            q = self.partner.get(q + 1, -1)
        if q < 0 or q - p > 4000:
            rule()
            return
        key = name + codes[p : q + 2]
        size = self.seen.get(key)
        if size is not None:
            self.p = p + size
            return
        before = len(self.faults)
        rule()
        if self.p <= q + 1 and len(self.faults) == before:
            if len(self.seen) > self.MEMORY:
                self.seen.clear()
            self.seen[key] = self.p - p

    def skip(self, start: int) -> None:
        """To the next line; over the block that hangs on the broken one."""
        while not self.at("newline", "dedent", END):
            self.p += 1
        self.eat("newline")
        if self.at("indent"):
            self.p = self.closes()
            self.eat("dedent")
        if self.p == start and not self.at(END):
            self.p += 1

    def unit(self) -> None:
        if self.eat("newline"):
            return
        self.statement()

    def block(self) -> None:
        self.need(":")
        if self.eat("newline"):
            if not self.eat("indent"):
                self.bad("indented block expected")
            while not self.at("dedent", END):
                self.tolerant("statement", self.unit)
            self.need("dedent")
        else:
            self.line()

    def statement(self) -> None:
        k = self.k[self.p]
        if k == "@":
            while self.eat("@"):
                self.named()
                self.need("newline")
            if not self.at("def", "class", "async"):
                self.bad("def or class expected")
            self.statement()
        elif k == "async":
            self.p += 1
            if not self.at("def", "for", "with"):
                self.bad("def expected")
            self.statement()
        elif k == "def":
            self.p += 1
            self.need(NAME)
            self.type_parameters()
            self.need("(")
            self.parameters(")", True)
            self.need(")")
            if self.eat("->"):
                self.expressions()
            self.block()
        elif k == "class":
            self.p += 1
            self.need(NAME)
            self.type_parameters()
            if self.eat("("):
                self.arguments()
            self.block()
        elif k in ("if", "while"):
            self.p += 1
            self.named()
            self.block()
            while k == "if" and self.eat("elif"):
                self.named()
                self.block()
            if self.eat("else"):
                self.block()
        elif k == "for":
            self.p += 1
            self.targets()
            self.need("in")
            self.star_expressions()
            self.block()
            if self.eat("else"):
                self.block()
        elif k == "try":
            self.p += 1
            self.block()
            n, bare = 0, False
            while self.eat("except"):
                n += 1
                if bare:
                    self.bad("the bare except comes last")
                star = self.eat("*")
                if not self.at(":"):
                    self.expression()
                    if self.at(","):
                        self.bad("exceptions need brackets")
                    if self.eat("as"):
                        self.need(NAME)
                elif star:
                    self.bad("exception expected")
                else:
                    bare = True
                self.block()
            if n and self.eat("else"):
                self.block()
            if self.eat("finally"):
                self.block()
            elif not n:
                self.bad("except or finally expected")
        elif k == "with":
            self.p += 1
            self.with_()
            self.block()
        elif k == NAME and self.word() == "match" and self.match_here():
            self.match()
        else:
            self.line()

    def with_(self) -> None:
        p = self.p
        if self.at("(") and self.k[self.partner.get(p, p) + 1] == ":":
            try:
                self.p += 1
                self.separated(self.with_item, ")", empty=False)
                return
            except Bad:
                self.p = p
        self.with_item()
        while self.eat(","):
            self.with_item()

    def with_item(self) -> None:
        self.expression()
        if self.eat("as"):
            if self.star_target() not in (ONE, MANY):
                self.bad("target expected")

    def type_parameters(self) -> None:
        if self.eat("["):
            self.separated(self.type_parameter, "]", empty=False)

    def type_parameter(self) -> None:
        if not self.eat("*"):
            self.eat("**")
        self.need(NAME)
        if self.eat(":"):
            self.expression()
        if self.eat("="):
            self.star_expression()

    def parameters(self, end: str, annotated: bool) -> None:
        """Up to, but without, `end`."""
        defaults = star = False
        n = 0
        while not self.at(end):
            if self.eat("**"):
                self.need(NAME)
                if annotated and self.eat(":"):
                    self.expression()
                self.eat(",")
                if not self.at(end):
                    self.bad("** comes last")
                return
            if self.eat("*"):
                if star:
                    self.bad("second *")
                star = True
                if self.at(NAME):
                    self.p += 1
                    if annotated and self.eat(":"):
                        self.star_expression()
                elif not (self.at(",") and self.peek() in (NAME,)):
                    self.bad("name expected")
            elif self.eat("/"):
                if star or not n:
                    self.bad("/ out of place")
            else:
                self.need(NAME)
                if annotated and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                    defaults = True
                elif defaults and not star:
                    self.bad("parameter without a default after one with")
            n += 1
            if not self.at(end):
                self.need(",")

    def line(self) -> None:
        self.simple()
        while self.eat(";"):
            if self.at("newline"):
                break
            self.simple()
        if not self.eat("newline"):
            self.bad("end of line expected")

    def simple(self) -> None:
        k = self.k[self.p]
        if k in ("pass", "break", "continue"):
            self.p += 1
        elif k == "return":
            self.p += 1
            if not self.at("newline", ";"):
                self.star_expressions()
        elif k == "raise":
            self.p += 1
            if not self.at("newline", ";"):
                self.expression()
                if self.eat("from"):
                    self.expression()
        elif k in ("global", "nonlocal"):
            self.p += 1
            self.need(NAME)
            while self.eat(","):
                self.need(NAME)
        elif k == "del":
            self.p += 1
            if self.star_expressions() not in (ONE, MANY):
                self.bad("target expected")
        elif k == "assert":
            self.p += 1
            self.expression()
            if self.eat(","):
                self.expression()
        elif k == "import":
            self.p += 1
            self.dotted_as()
            while self.eat(","):
                self.dotted_as()
        elif k == "from":
            self.p += 1
            dots = False
            while self.at(".", "..."):
                dots = True
                self.p += 1
            if not (dots and self.at("import")):
                self.dotted()
            self.need("import")
            if self.eat("*"):
                return
            if self.eat("("):
                self.separated(self.name_as, ")", empty=False)
            else:
                self.name_as()
                while self.eat(","):
                    self.name_as()
        elif k == NAME and self.word() == "type" and self.peek() == NAME and self.peek(2) in ("=", "["):
            self.p += 2
            self.type_parameters()
            self.need("=")
            self.expression()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.need(NAME)
        while self.eat("."):
            self.need(NAME)

    def dotted_as(self) -> None:
        self.dotted()
        if self.eat("as"):
            self.need(NAME)

    def name_as(self) -> None:
        self.need(NAME)
        if self.eat("as"):
            self.need(NAME)

    def assignment(self) -> None:
        p = self.p
        what = self.right() if self.at("yield") else self.star_expressions()
        if self.at(":") and what == ONE:
            self.p += 1
            self.expression()
            if self.eat("="):
                self.right()
            return
        if self.k[self.p] in _AUGMENTED:
            if what != ONE or self.k[p] == "(" and self.closes_at(p):
                pass
            if what != ONE:
                self.bad("target expected")
            self.p += 1
            self.right()
            return
        while self.at("="):
            if what not in (ONE, MANY):
                self.bad("target expected")
            self.p += 1
            what = self.right()
        if what == STAR and self.k[self.p - 1] != ",":
            self.bad("starred expression alone")

    def closes_at(self, p: int) -> bool:
        return self.partner.get(p) == self.p - 1

    def right(self) -> str:
        if self.at("yield"):
            self.yield_()
            return NONE
        return self.star_expressions()

    def yield_(self) -> None:
        self.need("yield")
        if self.eat("from"):
            self.expression()
        elif not self.at("newline", ")", "]", "}", ";", "=", ":", ","):
            self.star_expressions()

    def targets(self) -> None:
        """The targets of a loop, up to `in`."""
        n = 0
        while True:
            if self.star_target() not in (ONE, MANY):
                self.bad("target expected")
            n += 1
            if not self.eat(",") or self.at("in"):
                return

    def star_target(self) -> str:
        self.eat("*")
        return self.primary_or_group()

    def primary_or_group(self) -> str:
        return self.await_()

    # expressions; each gives what it is to an assignment
    def star_expressions(self) -> str:
        what = self.star_expression()
        if not self.at(","):
            return what
        good = what in (ONE, MANY, STAR)
        while self.eat(","):
            if self.at("newline", ")", "]", "}", "=", ":", ";", END) or self.k[self.p] in _AUGMENTED:
                break
            good = self.star_expression() in (ONE, MANY, STAR) and good
        return MANY if good else NONE

    def star_expression(self) -> str:
        if self.eat("*"):
            p = self.p
            self.binary()
            return STAR if self.k[p] in (NAME, "(", "[") else NONE
        return self.expression()

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            if self.at("newline", ")", "]", "}", ":", "="):
                return
            self.expression()

    def named(self) -> str:
        if self.at(NAME) and self.peek() == ":=":
            self.p += 2
            self.expression()
            return NONE
        return self.expression()

    def star_named(self) -> str:
        if self.at("*"):
            return self.star_expression()
        return self.named()

    def expression(self) -> str:
        if self.eat("lambda"):
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return NONE
        what = self.disjunction()
        if self.eat("if"):
            self.disjunction()
            self.need("else")
            self.expression()
            return NONE
        return what

    def disjunction(self) -> str:
        what = self.inversion()
        while self.at("or", "and"):
            self.p += 1
            self.inversion()
            what = NONE
        return what

    def inversion(self) -> str:
        if self.eat("not"):
            self.inversion()
            return NONE
        what = self.binary()
        while True:
            k = self.k[self.p]
            if k in ("<", ">", "<=", ">=", "==", "!=", "in"):
                self.p += 1
            elif k == "is":
                self.p += 1
                self.eat("not")
            elif k == "not" and self.peek() == "in":
                self.p += 2
            else:
                return what
            self.binary()
            what = NONE

    def binary(self, least: int = 1) -> str:
        what = self.unary()
        while (power := self.BINARY.get(self.k[self.p], 0)) >= least:
            self.p += 1
            self.binary(power + 1)
            what = NONE
        return what

    def unary(self) -> str:
        if self.at("+", "-", "~"):
            self.p += 1
            self.unary()
            return NONE
        what = self.await_()
        if self.eat("**"):
            self.unary()
            return NONE
        return what

    def await_(self) -> str:
        if self.eat("await"):
            self.primary()
            return NONE
        return self.primary()

    def primary(self) -> str:
        what = self.atom()
        while True:
            if self.eat("."):
                self.need(NAME)
                what = ONE
            elif self.eat("("):
                self.arguments()
                what = NONE
            elif self.eat("["):
                self.slice()
                while self.eat(","):
                    if self.at("]"):
                        break
                    self.slice()
                self.need("]")
                what = ONE
            else:
                return what

    def slice(self) -> None:
        if not self.at(":"):
            self.star_named()
        n = 0
        while n < 2 and self.eat(":"):
            n += 1
            if not self.at(":", "]", ","):
                self.expression()

    def arguments(self) -> None:
        """After the bracket."""
        named = unpacked = False
        n = 0
        while not self.eat(")"):
            n += 1
            if self.eat("**"):
                self.expression()
                unpacked = True
            elif self.eat("*"):
                if unpacked:
                    self.bad("* after **")
                self.expression()
            elif self.at(NAME) and self.peek() == "=":
                self.p += 2
                self.expression()
                named = True
            else:
                p = self.p
                self.named()
                if self.at("for", "async"):
                    self.comprehension()
                    if not self.at(")") and not (self.at(",") and self.peek() == ")" and n == 1) or n > 1:
                        self.bad("generator needs brackets")
                elif named or unpacked:
                    raise Bad(p, "positional argument after a named one")
            if not self.at(")"):
                self.need(",")

    def comprehension(self) -> None:
        while self.at("for", "async"):
            if self.eat("async") and not self.at("for"):
                self.bad("for expected")
            self.p += 1
            self.targets()
            self.need("in")
            self.disjunction()
            while self.eat("if"):
                if self.at("lambda"):
                    self.expression()
                elif self.at(NAME) and self.peek() == ":=":
                    self.named()
                else:
                    self.disjunction()

    def atom(self) -> str:
        k = self.k[self.p]
        if k == NAME:
            self.p += 1
            return ONE
        if k == NUMBER or k in ("True", "False", "None", "..."):
            self.p += 1
            return NONE
        if k == TEXT:
            while self.eat(TEXT):
                pass
            return NONE
        if k == "(":
            self.p += 1
            if self.eat(")"):
                return MANY
            if self.at("yield"):
                self.yield_()
                self.need(")")
                return NONE
            return self.group(")")
        if k == "[":
            self.p += 1
            if self.eat("]"):
                return MANY
            return self.group("]")
        if k == "{":
            self.p += 1
            self.braces()
            return NONE
        self.bad("expression expected")
        return NONE

    def group(self, end: str) -> str:
        what = self.star_named()
        if self.at("for", "async"):
            if what == STAR:
                self.bad("unpacking in a comprehension")
            self.comprehension()
            self.need(end)
            return NONE
        if self.eat(end):
            if end == "]":
                return MANY if what in (ONE, MANY, STAR) else NONE
            if what == STAR:
                self.bad("starred expression in brackets")
            return what
        good = what in (ONE, MANY, STAR)
        while not self.eat(end):
            self.need(",")
            if self.eat(end):
                break
            good = self.star_named() in (ONE, MANY, STAR) and good
        return MANY if good else NONE

    def braces(self) -> None:
        """A set or dict, after the brace."""
        if self.eat("}"):
            return
        n, dict_ = 0, None
        while True:
            n += 1
            if self.eat("**"):
                self.binary()
                pair = True
            else:
                self.star_named()
                pair = self.eat(":")
                if pair:
                    self.expression()
            if dict_ is None:
                dict_ = pair
            elif dict_ != pair:
                self.bad("set and dict mixed")
            if n == 1 and self.at("for", "async"):
                self.comprehension()
                self.need("}")
                return
            if self.eat("}"):
                return
            self.need(",")
            if self.eat("}"):
                return

    # match
    def match_here(self) -> bool:
        """Whether the line ends with a colon and a block of cases follows."""
        q = self.codes.find(_NEWLINE, self.p)
        return (
            self.peek() not in ("=", ".", ",", ")", ":", "newline", *_AUGMENTED)
            and q > 0
            and self.k[q - 1] == ":"
            and self.k[q + 1 : q + 2] == ["indent"]
            and getattr(self.k[q + 2], "text", "") == "case"
        )

    def match(self) -> None:
        self.p += 1
        self.star_expressions()
        self.need(":")
        self.need("newline")
        self.need("indent")
        while not self.eat("dedent"):
            if self.word() != "case":
                self.bad("case expected")
            self.p += 1
            self.patterns()
            if self.eat("if"):
                self.named()
            self.block()

    def patterns(self) -> None:
        self.as_pattern()
        while self.eat(","):
            if self.at(":", "if"):
                return
            self.as_pattern()

    def as_pattern(self) -> None:
        if self.eat("*"):
            self.need(NAME)
            return
        self.closed()
        while self.eat("|"):
            self.closed()
        if self.eat("as"):
            self.need(NAME)

    def closed(self) -> None:
        k = self.k[self.p]
        if k in ("True", "False", "None"):
            self.p += 1
        elif k == TEXT:
            while self.eat(TEXT):
                pass
        elif k in (NUMBER, "-"):
            self.eat("-")
            self.need(NUMBER)
            if self.at("+", "-"):
                self.p += 1
                self.need(NUMBER)
        elif k == NAME:
            self.dotted()
            if self.eat("("):
                self.separated(self.class_argument, ")")
        elif k in ("(", "["):
            self.p += 1
            self.separated(self.as_pattern, ")" if k == "(" else "]")
        elif k == "{":
            self.p += 1
            self.separated(self.mapping, "}")
        else:
            self.bad("pattern expected")

    def class_argument(self) -> None:
        if self.at(NAME) and self.peek() == "=":
            self.p += 2
        self.as_pattern()

    def mapping(self) -> None:
        if self.eat("**"):
            self.need(NAME)
            return
        self.closed()
        self.need(":")
        self.as_pattern()


__all__ = ["PYTHON_LEXER", "Python", "Fault"]
