"""JavaScript and TypeScript 5."""

from __future__ import annotations

import re

from symgraph.llm.syntax.base import CODES, END, NAME, NUMBER, TEXT, Bad, Lexer, Parser, coded
from symgraph.llm.syntax.clike import _ASSIGN, _BLOCK, levels

REGEX = "regex"
_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof "
    "new null return super switch this throw true try typeof var void while with"
)
_MARKS = (
    "{ } ( ) [ ] . ... ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= "
    "&&= ||= ??= => @"
)
_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\.|\$(?!\{))[^`\\$]*+)*+", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_OPERAND_ENDS = frozenset([NAME, NUMBER, TEXT, REGEX, ")", "]", "}", "template", "this", "super", "true", "false", "null"])


class ScriptLexer(Lexer):
    def special(self, token: str) -> str:
        c = token[0]
        if c in "\"'" and len(token) > 1:
            return TEXT
        if c == "#" and len(token) > 1:
            return NAME
        return super().special(token)

    def codes(self, text: str) -> str:
        """Also notes in `fresh` which tokens begin a line. Divisions, patterns and templates with fields need the slow way."""
        if "${" not in text and not text.startswith("#!"):
            codes = super().codes(text)
            if not _SLOW.search(codes):
                lines = [x for x in codes.replace(_COMMENT, "").split(_NEWLINE) if x]
                self.fresh = "".join(["1" + "0" * (len(x) - 1) for x in lines])
                self.at = None
                return "".join(lines)
        return coded(self.kinds(text))

    def kind(self, token: str) -> str:
        if token[:1] in ("\n", "\r") or (token[:2] == "/*" and len(token) > 3):
            return "newline" if "\n" in token or "\r" in token else "comment"
        if token[:1] == "`" and len(token) > 1:
            return TEXT
        return super().kind(token)

    def kinds(self, text: str) -> list[str]:
        """Also notes in `fresh` whether each token is the first of its line, and in `at` where it begins."""
        out, fresh, at = [], [], []
        self.known = known = self.fresh_known()
        kind, match = self.kind, self.pattern.match
        open_: list[bool] = []  # for each open brace: does it belong to a template
        p, n, last, start = 0, "1", "", 0
        if text.startswith("#!"):
            p = text.find("\n") if "\n" in text else len(text)
        while True:
            m = match(text, p)
            t, p = m.group(1), m.end()
            if t[:1] in ("\n", "\r") or (t[:2] == "/*" and len(t) > 3):
                if t[0] != "/" or "\n" in t:
                    n = "1"
                continue
            k = known.get(t)
            if k is None:
                k = kind(t)
                if len(t) < 60:
                    known[t] = k
            start = m.start(1)
            if (k == "/" or k == "/=") and last not in _OPERAND_ENDS:
                if r := _REGEX.match(text, start):
                    k, p = REGEX, r.end()
            elif k == "{":
                open_.append(False)
            elif k == "}" and open_ and open_.pop():
                out.append("}$")
                fresh.append(n)
                at.append(start)
                k = self.template(text, p)
                p = self.end
                n = "0"
                if k == "template":
                    last = k
                    out.append("template end")
                    fresh.append("0")
                    at.append(start)
                    continue
                if k == "${":
                    open_.append(True)
            elif t[:1] == "`":
                p = start + 1
                out.append("template start")
                fresh.append(n)
                at.append(start)
                n = "0"
                k = self.template(text, p)
                p = self.end
                if k == "template":
                    last = k
                    out.append("template end")
                    fresh.append("0")
                    at.append(start)
                    continue
                if k == "${":
                    open_.append(True)
            out.append(k)
            fresh.append(n)
            at.append(start)
            n, last = "0", k
            if k == END:
                break
        self.fresh, self.at = "".join(fresh), at
        return out

    def template(self, text: str, p: int) -> str:
        m = _TEMPLATE.match(text, p)
        self.end = m.end()
        if text.startswith("`", self.end):
            self.end += 1
            return "template"
        if text.startswith("${", self.end):
            self.end += 2
            return "${"
        return "unterminated `"


_NEWLINE, _COMMENT = CODES["newline"], CODES["comment"]
_SLOW = re.compile("[" + CODES["/"] + CODES["/="] + CODES["unterminated `"] + CODES["unterminated /"] + "]")
SCRIPT_LEXER = ScriptLexer(
    r"\r\n|\n|\r|`[^`\\$]*+(?:(?:\\.|\$(?!\{))[^`\\$]*+)*+`|" + _BLOCK + r"|\"[^\"\\\n\r]*+(?:\\(?:\r\n|.)[^\"\\\n\r]*+)*+\"|'[^'\\\n\r]*+(?:\\(?:\r\n|.)[^'\\\n\r]*+)*+'"
    r"|(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])|#?(?:[^\W\d]|\$)[\w$]*|\\u",
    _WORDS,
    _MARKS,
    r"[ \t\f\v﻿\xa0]+|//[^\n\r]*",
    "abstract accessor as asserts assert async await declare from get global implements infer interface is keyof let module namespace of out override "
    "private protected public readonly satisfies set static type unique yield",
)


class Script(Parser):
    BINARY = levels("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**")
    seen: dict[str, int] = {}
    typed = False
    no_in = False

    def line(self, n: int = 0) -> bool:
        return self.fresh[self.p + n] == "1"

    def end(self) -> None:
        """A semicolon, or a place where one may be left out."""
        if self.eat(";") or self.at("}", END):
            return
        if not self.line():
            self.bad("; expected")

    def name_like(self) -> bool:
        k = self.k[self.p]
        if k == NAME or k in SCRIPT_LEXER.words:
            self.p += 1
            return True
        return False

    def unit(self) -> None:
        k = self.k[self.p]
        if k == "import" and self.peek() not in ("(", "."):
            self.import_()
        elif k == "export":
            self.export()
        else:
            self.statement()

    def import_(self) -> None:
        self.p += 1
        if self.eat(TEXT):
            self.end()
            return
        if self.typed and self.word() == "type" and (self.peek() in ("{", "*") or (self.peek() == NAME and self.word(1) != "from")):
            self.p += 1
        if self.typed and self.at(NAME) and self.peek() == "=":
            self.p += 2
            self.expression()
            self.end()
            return
        if self.at(NAME):
            self.p += 1
            if not self.eat(","):
                self.from_()
                return
        if self.eat("*"):
            self.contextual("as")
            self.need(NAME)
        else:
            self.need("{")
            self.separated(self.specifier, "}")
        self.from_()

    def contextual(self, word: str) -> None:
        if self.word() != word:
            self.bad(f"{word} expected")
        self.p += 1

    def from_(self) -> None:
        self.contextual("from")
        self.need(TEXT)
        if self.at("with") or self.word() in ("assert",):
            self.p += 1
            self.object()
        self.end()

    def specifier(self) -> None:
        if self.typed and self.word() == "type" and self.peek() not in (",", "}") and self.word(1) != "as":
            self.p += 1
        if not self.eat(TEXT) and not self.name_like():
            self.bad("name expected")
        if self.word() == "as":
            self.p += 1
            if not self.eat(TEXT) and not self.name_like():
                self.bad("name expected")

    def export(self) -> None:
        self.p += 1
        if self.eat("default"):
            if self.at("function") or (self.word() == "async" and self.peek() == "function" and not self.line(1)):
                self.function(False)
            elif self.at("class", "@") or (self.typed and self.word() in ("abstract", "interface") and self.peek() in ("class", NAME)):
                if self.word() == "interface":
                    self.statement()
                else:
                    self.class_(False)
            else:
                self.assignment()
                self.end()
        elif self.eat("*"):
            if self.word() == "as":
                self.p += 1
                if not self.eat(TEXT) and not self.name_like():
                    self.bad("name expected")
            self.from_()
        elif self.at("{") or (self.typed and self.word() == "type" and self.peek() in ("{", "*")):
            self.eat(NAME)
            if self.eat("*"):
                self.from_()
                return
            self.p += 1
            self.separated(self.specifier, "}")
            if self.word() == "from":
                self.from_()
            else:
                self.end()
        elif self.typed and self.eat("="):
            self.expression()
            self.end()
        elif self.at("var", "const", "function", "class", "@", "enum") or self.word() in ("let", "async") or (self.typed and self.word()) or (self.typed and self.at("import")):
            self.statement()
        else:
            self.bad("declaration expected")

    def statement(self) -> None:
        k = self.k[self.p]
        if k == "{":
            self.block()
        elif k == ";":
            self.p += 1
        elif k in ("var", "const"):
            if self.typed and k == "const" and self.peek() == "enum":
                self.p += 1
                self.enum()
                return
            self.p += 1
            self.variables()
            self.end()
        elif k == "function":
            self.function(True)
        elif k in ("class", "@"):
            self.class_(True)
        elif k == "if":
            self.p += 1
            self.parenthesised()
            self.substatement()
            if self.eat("else"):
                self.substatement()
        elif k == "for":
            self.for_()
        elif k in ("while", "with"):
            self.p += 1
            self.parenthesised()
            self.loop(k == "while")
        elif k == "do":
            self.p += 1
            self.loop()
            self.need("while")
            self.parenthesised()
            self.eat(";")
        elif k in ("return", "throw"):
            if k == "return" and not self.inside:
                self.bad("return outside a function")
            self.p += 1
            if k == "throw" and self.line():
                self.bad("expression expected on the line")
            if not self.at(";", "}", END) and not self.line():
                self.expression()
            elif k == "throw":
                self.bad("expression expected")
            self.end()
        elif k in ("break", "continue"):
            self.p += 1
            if self.at(NAME) and not self.line():
                self.p += 1
            elif not self.loops and not (k == "break" and self.switches):
                self.p -= 1
                self.bad(f"{k} outside a loop")
            self.end()
        elif k == "switch":
            self.switch()
        elif k == "try":
            self.p += 1
            self.block()
            caught = self.eat("catch")
            if caught:
                if self.eat("("):
                    self.binding()
                    if self.typed and self.eat(":"):
                        self.type()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                self.block()
            elif not caught:
                self.bad("catch or finally expected")
        elif k == "debugger":
            self.p += 1
            self.end()
        elif k == "enum" and self.typed:
            self.enum()
        elif k == NAME:
            self.named_statement()
        elif k in ("import", "export") and not (k == "import" and self.peek() in ("(", ".")):
            if self.typed and self.depth:
                self.unit()
            else:
                self.bad("import and export stand at the top")
        else:
            self.expression()
            self.end()

    depth = 0
    #: Whether this is in a function, a loop, a switch.
    inside = loops = switches = False

    def context(self) -> str:
        return "".join(c for c, on in zip("flsn", (self.inside, self.loops, self.switches, self.depth), strict=True) if on)

    def body(self, function: bool = True) -> None:
        """A block of its own: of a function, or of a class when it is set up."""
        outer = self.inside, self.loops, self.switches, self.no_in
        self.inside, self.loops, self.switches, self.no_in = function, False, False, False
        try:
            self.block()
        finally:
            self.inside, self.loops, self.switches, self.no_in = outer

    def loop(self, repeats: bool = True) -> None:
        outer, self.loops = self.loops, self.loops or repeats
        try:
            self.substatement()
        finally:
            self.loops = outer

    def substatement(self) -> None:
        self.statement()

    def named_statement(self) -> None:
        w, after = self.word(), self.peek()
        if after == ":":
            self.p += 2
            self.statement()
            return
        if w == "let" and after in (NAME, "{", "["):
            self.p += 1
            self.variables()
            self.end()
            return
        if w == "async" and after == "function" and not self.line(1):
            self.function(True)
            return
        if self.typed and not self.line(1):
            if w == "interface" and after == NAME:
                self.p += 2
                self.type_parameters()
                if self.eat("extends"):
                    self.type()
                    while self.eat(","):
                        self.type()
                self.type_members()
                return
            if w == "type" and after == NAME:
                self.p += 2
                self.type_parameters()
                self.need("=")
                self.type()
                self.end()
                return
            if w in ("declare", "abstract") and (after in ("class", "function", "const", "var", "enum", "@") or after == NAME):
                self.p += 1
                if self.word() == "global" and self.peek() == "{":
                    self.p += 1
                    self.module_body()
                    return
                self.statement()
                return
            if w in ("namespace", "module") and after in (NAME, TEXT):
                self.p += 2
                while self.eat("."):
                    self.need(NAME)
                if self.at("{"):
                    self.module_body()
                else:
                    self.end()
                return
        self.expression()
        self.end()

    def module_body(self) -> None:
        self.need("{")
        self.depth += 1
        self.units("module", self.unit, "}")
        self.depth -= 1
        self.need("}")

    def enum(self) -> None:
        self.p += 1
        self.need(NAME)
        self.need("{")
        self.separated(self.enum_member, "}")

    def enum_member(self) -> None:
        if not self.eat(TEXT) and not self.name_like():
            self.bad("name expected")
        if self.eat("="):
            self.assignment()

    def block(self) -> None:
        self.need("{")
        self.units("statement", self.statement, "}")
        self.need("}")

    def parenthesised(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def variables(self, loop: bool = False) -> None:
        while True:
            pattern = self.at("{", "[")
            self.binding()
            if self.typed:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            elif pattern and not (loop and (self.at("in") or self.word() == "of")):
                self.bad("= expected")
            if not self.eat(","):
                return

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif self.eat("{"):
            self.separated(self.binding_property, "}")
        else:
            self.need(NAME)

    def binding_property(self) -> None:
        if self.eat("..."):
            self.binding()
            return
        simple = self.at(NAME)
        self.property_name()
        if self.eat(":"):
            self.binding()
        elif not simple:
            self.bad(": expected")
        if self.eat("="):
            self.assignment()

    def property_name(self) -> None:
        if self.eat("["):
            self.assignment()
            self.need("]")
        elif not (self.eat(TEXT) or self.eat(NUMBER) or self.name_like()):
            self.bad("property expected")

    def for_(self) -> None:
        self.p += 1
        if self.word() == "await":
            self.p += 1
        self.need("(")
        declared = self.at("var", "const") or (self.word() == "let" and self.peek() in (NAME, "{", "["))
        outer, self.no_in = self.no_in, True
        if declared:
            self.p += 1
            self.variables(True)
        elif not self.at(";"):
            self.expression()
        self.no_in = outer
        if self.at("in") or self.word() == "of":
            of = self.word() == "of"
            self.p += 1
            if of:
                self.assignment()
            else:
                self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.loop()

    def switch(self) -> None:
        self.p += 1
        self.parenthesised()
        self.need("{")
        outer, self.switches = self.switches, True
        try:
            while not self.eat("}"):
                if not self.eat("default"):
                    self.need("case")
                    self.expression()
                self.need(":")
                while not self.at("case", "default", "}", END):
                    self.tolerant("statement", self.statement)
        finally:
            self.switches = outer

    # functions and classes
    def function(self, named: bool) -> None:
        if self.at(NAME):
            self.p += 1
        self.need("function")
        self.eat("*")
        if named:
            self.need(NAME)
        else:
            self.eat(NAME)
        self.rest_of_function(self.typed and named)

    def rest_of_function(self, bodiless: bool = False) -> None:
        if self.typed:
            self.type_parameters()
        self.parameters()
        if self.typed and self.eat(":"):
            self.return_type()
        if bodiless and not self.at("{"):
            self.end()
            return
        self.body()

    def parameters(self) -> None:
        outer, self.no_in = self.no_in, False
        self.need("(")
        self.separated(self.parameter, ")")
        self.no_in = outer

    def parameter(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.typed:
            while self.word() in ("public", "private", "protected", "readonly", "override") and self.peek() in (NAME, "{", "["):
                self.p += 1
            if self.eat("this"):
                if self.eat(":"):
                    self.type()
                return
        self.eat("...")
        self.binding()
        if self.typed:
            self.eat("?")
            if self.eat(":"):
                self.type()
        if self.eat("="):
            self.assignment()

    def decorator(self) -> None:
        self.need("@")
        if self.at("("):
            self.parenthesised()
            return
        self.need(NAME)
        while self.eat("."):
            self.need(NAME)
        if self.at("("):
            self.arguments()

    def class_(self, named: bool) -> None:
        while self.at("@"):
            self.decorator()
        if self.at(NAME):
            self.contextual("abstract")
        self.need("class")
        if named:
            self.need(NAME)
        elif self.at(NAME) and not (self.typed and self.word() == "implements"):
            self.p += 1
        if self.typed:
            self.type_parameters()
        if self.eat("extends"):
            self.operand()
            if self.typed:
                self.type_arguments_here()
        if self.typed and self.word() == "implements":
            self.p += 1
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.units("member", self.member, "}")
        self.need("}")

    def member(self) -> None:
        if self.eat(";"):
            return
        while self.at("@"):
            self.decorator()
        words = ("static", "async", "get", "set", "accessor") + (
            ("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.typed else ()
        )
        while self.word() in words and self.peek() not in ("(", "=", ";", "}", "<", "?", "!", ":"):
            if self.word() == "static" and self.peek() == "{":
                self.p += 1
                self.body(False)
                return
            if self.line(1) and self.word() not in ("static", "public", "private", "protected"):
                break
            self.p += 1
        self.eat("*")
        if self.typed and self.at("[") and self.peek() == NAME and self.peek(2) == ":":  # index signature
            self.p += 3
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            self.end()
            return
        self.property_name()
        if self.typed:
            self.eat("?")
            self.eat("!")
        if self.at("(", "<"):
            self.rest_of_function(self.typed)
            return
        if self.typed and self.eat(":"):
            self.type()
        if self.eat("="):
            outer, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = outer
        self.end()

    # expressions
    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def arrow(self) -> bool:
        p = self.p
        if self.word() == "async" and not self.line(1) and self.peek() in (NAME, "(", "<") and not (self.peek() == NAME and self.peek(2) != "=>"):
            self.p += 1
        if self.at(NAME) and self.peek() == "=>":
            if self.line(1):
                self.bad("=> must not begin a line")
            self.p += 1
        elif self.at("(") or (self.typed and self.at("<")):
            end = self.partner.get(self.p) if self.at("(") else None
            if end is not None and self.k[end + 1] != "=>" and not (self.typed and self.k[end + 1] == ":"):
                self.p = p
                return False
            if end is None and self.at("("):
                self.p = p
                return False
            sure = end is not None and self.k[end + 1] == "=>"
            try:
                if self.typed:
                    self.type_parameters()
                self.parameters()
                if self.typed and self.eat(":"):
                    self.return_type()
                if not self.at("=>"):
                    raise Bad(self.p, "=> expected")
            except Bad:
                if sure:
                    raise
                self.p = p
                return False
        else:
            self.p = p
            return False
        self.need("=>")
        if self.at("{"):
            self.body()
        else:
            self.assignment()
        return True

    def assignment(self) -> None:
        if self.at("(", "<") or self.at(NAME):
            if self.arrow():
                return
        if self.word() == "yield" and self.peek() not in ("=", ".", "=>", "("):
            self.p += 1
            if self.line() or self.at(")", "]", "}", ",", ";", ":", END):
                return
            self.eat("*")
            self.assignment()
            return
        p = self.p
        self.binary()
        if self.eat("?"):
            outer, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = outer
            self.need(":")
            self.assignment()
            return
        if self.k[self.p] in _ASSIGN and not self.at(":=", "&^="):
            last = self.k[self.p - 1]
            if last in (NUMBER, TEXT, REGEX) or (last == ")" and self.k[p] != "("):
                self.bad("assignment to a value")
            self.p += 1
            self.assignment()

    def binary(self, least: int = 1) -> None:
        self.unary()
        while True:
            k = self.k[self.p]
            if k == NAME and self.typed and self.word() in ("as", "satisfies") and not self.line():
                self.p += 1
                if not self.eat("const"):
                    self.type()
                continue
            power = self.BINARY.get(k, 0)
            if k == "in" and self.no_in:
                return
            if not power or power < least:
                return
            self.p += 1
            self.binary(power if k == "**" else power + 1)

    def unary(self) -> None:
        k = self.k[self.p]
        if k in ("!", "~", "+", "-", "++", "--", "typeof", "void", "delete"):
            self.p += 1
            self.unary()
            return
        if k == NAME and self.word() == "await" and self.peek() not in ("=", ".", ")", ";", ",", "=>", ":", "?", "]", "}", *self.BINARY) and not self.line(1):
            self.p += 1
            self.unary()
            return
        if k == "<" and self.typed:  # <T>x
            self.p += 1
            self.type()
            self.need(">")
            self.unary()
            return
        self.operand()
        if self.at("++", "--") and not self.line():
            self.p += 1

    def operand(self) -> None:
        k = self.k[self.p]
        outer, self.no_in = self.no_in, False
        if k == NAME:
            if self.word() == "async" and self.peek() == "function" and not self.line(1):
                self.function(False)
            else:
                self.p += 1
        elif k in (NUMBER, TEXT, REGEX, "this", "true", "false", "null", "super"):
            self.p += 1
        elif k == "template start":
            self.template()
        elif k == "(":
            self.parenthesised()
        elif k == "[":
            self.p += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif k == "{":
            self.object()
        elif k == "function":
            self.function(False)
        elif k in ("class", "@"):
            self.class_(False)
        elif k == "new":
            self.p += 1
            if self.eat("."):
                self.need(NAME)
            else:
                if self.at("import"):
                    self.bad("new import")
                self.creation()
        elif k == "import" and self.peek() in ("(", "."):
            self.p += 1
            if self.eat("."):
                self.need(NAME)
        else:
            self.bad("expression expected")
        self.postfix()
        self.no_in = outer

    def creation(self) -> None:
        if self.eat("new"):
            self.creation()
        elif self.at("("):
            self.parenthesised()
        elif self.at("class"):
            self.class_(False)
        elif self.at("function"):
            self.function(False)
        elif not (self.eat(NAME) or self.eat("this") or self.eat("super")):
            self.bad("class expected")
        while True:
            if self.eat("."):
                if not self.name_like():
                    self.bad("name expected")
            elif self.eat("["):
                self.expression()
                self.need("]")
            else:
                break
        if self.typed:
            self.type_arguments_here()
        if self.at("("):
            self.arguments()

    def template(self) -> None:
        self.need("template start")
        while not self.eat("template end"):
            self.need("${")
            self.expression()
            self.need("}$")

    def arguments(self) -> None:
        outer, self.no_in = self.no_in, False
        self.need("(")
        self.separated(self.argument, ")")
        self.no_in = outer

    def argument(self) -> None:
        self.eat("...")
        self.assignment()

    def postfix(self) -> None:
        while True:
            k = self.k[self.p]
            if k == ".":
                self.p += 1
                if not self.name_like():
                    self.bad("name expected")
            elif k == "?.":
                self.p += 1
                if self.at("("):
                    self.arguments()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                elif not self.name_like():
                    self.bad("name expected")
            elif k == "[":
                self.p += 1
                self.expression()
                self.need("]")
            elif k == "(":
                self.arguments()
            elif k == "template start":
                self.template()
            elif k == "!" and self.typed and not self.line():
                self.p += 1
            elif k == "<" and self.typed:
                if not self.type_arguments_here():
                    return
            else:
                return

    def type_arguments_here(self) -> bool:
        """<A, B> of a call, if that is what stands here."""
        if not self.at("<"):
            return False
        p = self.p
        try:
            self.type_arguments()
            if self.at("(", ")", "]", ",", ";", ":", "}", ".", "?.", "template start", "{", END, "=", "==", "===", "!=", "!==", "&&", "||", "??") or self.line():
                return True
            if self.word() in ("implements",):
                return True
        except Bad:
            pass
        self.p = p
        return False

    def object(self) -> None:
        self.need("{")
        self.separated(self.property, "}")

    def property(self) -> None:
        if self.eat("..."):
            self.assignment()
            return
        while self.word() in ("async", "get", "set") and self.peek() not in ("(", ":", ",", "}", "=", "<"):
            self.p += 1
        if self.eat("*"):
            self.property_name()
            self.rest_of_function()
            return
        simple = self.at(NAME)
        self.property_name()
        if self.at("(") or (self.typed and self.at("<")):
            self.rest_of_function()
        elif self.eat(":"):
            self.assignment()
        elif simple:
            if self.eat("="):
                self.assignment()
        else:
            self.bad(": expected")

    # types
    def type_parameters(self) -> None:
        if self.eat("<"):
            self.separated(self.type_parameter, ">", empty=False)

    def type_parameter(self) -> None:
        while self.at("const", "in") or (self.word() in ("out",) and self.peek() == NAME):
            self.p += 1
        self.need(NAME)
        if self.eat("extends"):
            self.type()
        if self.eat("="):
            self.type()

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type()
            if self.at(">>", ">>>"):  # closes more than one list
                k = self.k[self.p][1:]
                self.k = [*self.k]
                self.k[self.p] = k
                return
            if self.eat(">"):
                return
            self.need(",")

    def return_type(self) -> None:
        if self.word() == "asserts" and self.peek() in (NAME, "this") and not self.line(1):
            self.p += 1
        if (self.at(NAME, "this")) and self.peek() == NAME and self.word(1) == "is" and not self.line(1):
            self.p += 2
        self.type()

    def type(self) -> None:
        start = self.p
        if self.at("new") or (self.word() == "abstract" and self.peek() == "new"):
            self.p += 2 if self.at(NAME) else 1
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        if self.at("<") or (self.at("(") and self.partner.get(self.p) and self.k[self.partner[self.p] + 1] == "=>"):
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        self.union()
        if self.eat("extends"):
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        if self.p == start:
            self.bad("type expected")

    def union(self) -> None:
        if self.at("|", "&"):
            self.p += 1
        self.postfix_type()
        while self.at("|", "&"):
            self.p += 1
            self.postfix_type()

    def postfix_type(self) -> None:
        while self.word() in ("keyof", "readonly", "unique", "infer") and self.peek() in (NAME, "{", "(", "[", "typeof", TEXT, "this"):
            if self.word() == "infer":
                self.p += 1
                self.need(NAME)
                if self.at("extends"):
                    p = self.p
                    self.p += 1
                    self.union()
                    if self.at("?"):
                        self.p = p
                return
            self.p += 1
        self.primary_type()
        while self.at("[") and not self.line():
            self.p += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def primary_type(self) -> None:
        k = self.k[self.p]
        if k in (NUMBER, TEXT, "true", "false", "null", "this", "void"):
            self.p += 1
        elif k == "-" and self.peek() == NUMBER:
            self.p += 2
        elif k == NAME:
            self.p += 1
            while self.at(".") and self.peek() == NAME:
                self.p += 2
            if self.at("<") and not self.line():
                self.type_arguments()
        elif k in ("typeof", "import"):
            self.p += 1
            if k == "import" or self.at("import"):
                self.eat("import")
                self.need("(")
                self.need(TEXT)
                self.need(")")
            elif not (self.eat(NAME) or self.eat("this")):
                self.bad("name expected")
            while self.eat("."):
                if not self.name_like():
                    self.bad("name expected")
            if self.at("<") and not self.line():
                self.type_arguments()
        elif k == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.p += 1
            self.separated(self.tuple_element, "]")
        elif k == "{":
            if self.peek() in ("[", "+", "-") or (self.peek() == NAME and self.peek(2) == "["):
                p = self.p
                if self.mapped():
                    return
                self.p = p
            self.type_members()
        elif k == "template start":
            self.p += 1
            while not self.eat("template end"):
                self.need("${")
                self.type()
                self.need("}$")
        else:
            self.bad("type expected")

    def tuple_element(self) -> None:
        self.eat("...")
        if self.at(NAME) and (self.peek() == ":" or (self.peek() == "?" and self.peek(2) == ":")):
            self.p += 1
            self.eat("?")
            self.need(":")
        self.type()
        self.eat("?")

    def mapped(self) -> bool:
        self.p += 1
        if self.at("+", "-"):
            self.p += 1
        if self.word() == "readonly":
            self.p += 1
        if not (self.at("[") and self.peek() == NAME and self.peek(2) == "in"):
            return False
        self.p += 3
        self.type()
        if self.word() == "as":
            self.p += 1
            self.type()
        self.need("]")
        if self.at("+", "-"):
            self.p += 1
        self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";")
        self.need("}")
        return True

    def type_members(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",")) and not self.at("}") and not self.line():
                self.bad("; expected")

    def type_member(self) -> None:
        if self.at("(", "<") or (self.at("new") and self.peek() in ("(", "<")):
            self.eat("new")
            self.type_parameters()
            self.parameters()
            if self.eat(":"):
                self.return_type()
            return
        while self.word() in ("readonly", "get", "set") and self.peek() not in (":", "?", "(", "<", ";", ",", "}"):
            self.p += 1
        if self.at("[") and self.peek() == NAME and self.peek(2) == ":":
            self.p += 3
            self.type()
            self.need("]")
        else:
            self.property_name()
        self.eat("?")
        if self.at("(", "<"):
            self.type_parameters()
            self.parameters()
            if self.eat(":"):
                self.return_type()
        elif self.eat(":"):
            self.type()


class Typed(Script):
    typed = True
    seen: dict[str, int] = {}
