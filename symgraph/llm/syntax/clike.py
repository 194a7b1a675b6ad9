"""C11, Java 17 and Go 1.22."""

from __future__ import annotations

import re

from symgraph.llm.syntax.base import CHAR, CODES, END, NAME, NUMBER, TEXT, Bad, Fault, Lexer, Parser

_NUMBER = r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"
_STRING = r'"[^"\\\n\r]*+(?:\\(?:\r\n|.)[^"\\\n\r]*+)*+"'
_CHAR = r"'(?:[^'\\\n\r]|\\(?:[^\n]))[^'\n\r]{0,12}'|'(?:[^'\\\n\r]|\\.)'"
_BLOCK = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
_SPACE = r"[ \t\f\v\r\n﻿\xa0]+"


def levels(*rows: str) -> dict[str, int]:
    return {op: k + 1 for k, row in enumerate(rows) for op in row.split()}


_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= &^= := **= &&= ||= ??=".split())

C_LEXER = Lexer(
    rf"(?:u8|[uUL])?{_STRING}|[uUL]?(?:{_CHAR})|{_NUMBER}[uUlLfFdD]*|[^\W\d]\w*",
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return "
    "short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex "
    "_Generic _Noreturn _Static_assert _Thread_local",
    "( ) [ ] { } . , ; : ? ... -> ++ -- & * + - ~ ! / % << >> < > <= >= == != ^ | && || = += -= *= /= %= &= |= ^= <<= >>= \\",
    rf"{_SPACE}|//(?:[^\n\\]|\\\r?\n|\\.)*|{_BLOCK}|\\\r?\n",
    "__attribute__ __extension__ __inline __inline__ __restrict __volatile__ __asm__",
)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\n\\/]|\\\r?\n|\\.|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|//[^\n]*|/)*)", re.M)
_C_TRIVIA = re.compile(rf"{_BLOCK}|//[^\n]*|{_STRING}|'(?:[^'\\\n]|\\.)+'|^[ \t]*#", re.M)
_DIRECTIVES = frozenset("include define undef if ifdef ifndef elif else endif pragma error warning line ident".split())


def preprocess(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without directives and without all but the first branch of conditions; faults as (offset, cause)."""
    if "#" not in text:
        return text, []
    out, last, faults, stack, at = [], 0, [], [], 0
    while m := _C_TRIVIA.search(text, at):
        if not m.group().endswith("#") or m.group()[0] in "\"'/":
            at = m.end()
            continue
        d = _DIRECTIVE.match(text, m.start())
        word, at = d.group(1), d.end()
        if not stack or all(stack):
            out.append(text[last : m.start()])
        out.append("\n" * text.count("\n", last if stack and not all(stack) else m.start(), at))
        last = at
        if word and word not in _DIRECTIVES:
            faults.append((m.start(), f"#{word} is no directive"))
        elif word in ("if", "ifdef", "ifndef"):
            stack.append(True)
        elif word in ("elif", "else", "endif") and not stack:
            faults.append((m.start(), f"#{word} without #if"))
        elif word in ("elif", "else"):
            stack[-1] = False
        elif word == "endif":
            stack.pop()
        elif word == "include" and not re.match(r'\s*(<[^>\n]+>|"[^"\n]+"|\w)', d.group(2)):
            faults.append((m.start(), "#include without a file"))
        elif word == "define" and not re.match(r"\s*[^\W\d]", d.group(2)):
            faults.append((m.start(), "#define without a name"))
    if not stack or all(stack):
        out.append(text[last:])
    if stack:
        faults.append((len(text), "#if without #endif"))
    return "".join(out), faults


_C_TYPES = frozenset("void char short int long float double signed unsigned _Bool _Complex".split())
_C_SPECIFIERS = frozenset("typedef extern static auto register inline const volatile restrict _Noreturn _Thread_local _Atomic".split())


class C(Parser):
    BINARY = levels("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %")
    seen: dict[str, int] = {}

    def unit(self) -> None:
        if self.eat(";"):
            return
        self.declaration(True)

    def specifiers(self) -> bool:
        """Declaration specifiers; whether a type is among them."""
        typed = False
        start = self.p
        while True:
            k = self.k[self.p]
            if k in _C_SPECIFIERS or self.word():
                self.p += 1
                if self.at("(") and self.k[self.p - 1] == NAME:
                    self.p = self.closes() + 1
            elif k in _C_TYPES:
                typed = True
                self.p += 1
            elif k in ("struct", "union"):
                typed = True
                self.p += 1
                named = self.eat(NAME)
                if self.eat("{"):
                    self.units("member", self.member, "}")
                    self.need("}")
                elif not named:
                    self.bad("struct without name or body")
            elif k == "enum":
                typed = True
                self.p += 1
                named = self.eat(NAME)
                if self.eat("{"):
                    self.separated(self.enumerator, "}", empty=False)
                elif not named:
                    self.bad("enum without name or body")
            elif k == "_Alignas":
                self.p += 1
                self.need("(")
                if not self.type_name():
                    self.expression()
                self.need(")")
            elif k == NAME and not typed:
                typed = True
                self.p += 1
            else:
                break
        if self.p == start:
            self.bad("declaration expected")
        return typed

    def enumerator(self) -> None:
        self.need(NAME)
        if self.eat("="):
            self.conditional()

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.at("_Static_assert"):
            self.static_assert()
            return
        self.specifiers()
        if self.eat(";"):
            return
        while True:
            if not self.at(":"):
                self.declarator()
            if self.eat(":"):
                self.conditional()
            if not self.eat(","):
                break
        self.need(";")

    def static_assert(self) -> None:
        self.p += 1
        self.need("(")
        self.separated(self.assignment, ")", empty=False, trailing=False)
        self.need(";")

    def pointers(self) -> None:
        while self.eat("*"):
            while self.k[self.p] in ("const", "volatile", "restrict", "_Atomic"):
                self.p += 1

    def declarator(self, abstract: bool = False) -> bool:
        """A declarator; whether it ends as a function's."""
        self.pointers()
        if self.at("(") and (not abstract or self.peek() in ("*", "(", "[", NAME) and not (abstract and self.peek() == NAME)):
            self.p += 1
            self.declarator(abstract)
            self.need(")")
        elif self.at(NAME):
            self.p += 1
        elif not abstract:
            self.bad("name expected")
        function = False
        while True:
            if self.eat("["):
                while self.at("static", "const", "volatile", "restrict"):
                    self.p += 1
                if not self.eat("]"):
                    if self.at("*") and self.peek() == "]":
                        self.p += 1
                    else:
                        self.assignment()
                    self.need("]")
            elif self.eat("("):
                function = True
                self.separated(self.parameter, ")", trailing=False)
            else:
                return function

    def parameter(self) -> None:
        if self.eat("..."):
            return
        self.specifiers()
        self.declarator_or_abstract()

    def declarator_or_abstract(self) -> None:
        p = self.p
        try:
            self.declarator(False)
        except Bad:
            self.p = p
            self.declarator(True)

    def type_name(self) -> bool:
        """A type name if one stands here for sure."""
        k = self.k[self.p]
        if k in _C_TYPES or k in ("struct", "union", "enum", "const", "volatile", "_Atomic"):
            self.specifiers()
            self.declarator(True)
            return True
        return False

    def declaration(self, top: bool) -> None:
        if self.at("_Static_assert"):
            self.static_assert()
            return
        start = self.p
        typed = self.specifiers()
        if self.eat(";"):
            if self.p - start == 2 and self.k[start] == NAME:
                raise Bad(start, "a name alone is no declaration")
            return
        if typed and self.p - start == 1 and self.k[start] == NAME and self.at("("):
            self.p = start  # `f() {` without a type was left by C99
            raise Bad(start, "declaration without a type")
        first = True
        while True:
            function = self.declarator()
            if first and top and function and self.at("{"):
                self.block()
                return
            first = False
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                break
        self.need(";")

    def initializer(self) -> None:
        if not self.eat("{"):
            self.assignment()
            return
        self.separated(self.designated, "}")

    def designated(self) -> None:
        while self.at("[", "."):
            if self.eat("."):
                self.need(NAME)
            else:
                self.p += 1
                self.conditional()
                self.need("]")
            if self.eat("="):
                break
        self.initializer()

    def block(self) -> None:
        self.need("{")
        self.units("statement", self.statement, "}")
        self.need("}")

    def statement(self) -> None:
        k = self.k[self.p]
        if k == "{":
            self.block()
        elif k == ";":
            self.p += 1
        elif k in ("if", "while", "switch"):
            self.p += 1
            self.need("(")
            self.expression()
            self.need(")")
            self.statement()
            if k == "if" and self.eat("else"):
                self.statement()
        elif k == "do":
            self.p += 1
            self.statement()
            self.need("while")
            self.need("(")
            self.expression()
            self.need(")")
            self.need(";")
        elif k == "for":
            self.p += 1
            self.need("(")
            if not self.eat(";"):
                self.simple()
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
            self.need(")")
            self.statement()
        elif k in ("break", "continue"):
            self.p += 1
            self.need(";")
        elif k == "goto":
            self.p += 1
            self.need(NAME)
            self.need(";")
        elif k == "return":
            self.p += 1
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif k in ("case", "default"):
            self.p += 1
            if k == "case":
                self.conditional()
            self.need(":")
            if not self.at("}"):
                self.statement()
        elif k == NAME and self.peek() == ":":
            self.p += 2
            if not self.at("}"):
                self.statement()
        else:
            self.simple()

    def simple(self) -> None:
        """A declaration or an expression, and the semicolon."""
        k = self.k[self.p]
        if k in _C_TYPES or k in _C_SPECIFIERS or k in ("struct", "union", "enum", "_Alignas", "_Static_assert"):
            self.declaration(False)
            return
        if k == NAME and self.peek() in (NAME, "*"):
            p = self.p
            try:
                self.declaration(False)
                return
            except Bad:
                self.p = p
        self.expression()
        self.need(";")

    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def assignment(self) -> None:
        self.conditional()
        if self.k[self.p] in _ASSIGN:
            self.p += 1
            self.assignment()

    def conditional(self) -> None:
        self.binary()
        if self.eat("?"):
            self.expression()
            self.need(":")
            self.conditional()

    def unary(self) -> None:
        k = self.k[self.p]
        if k in ("++", "--", "&", "*", "+", "-", "~", "!", "&&"):
            self.p += 1
            self.unary()
            return
        if k in ("sizeof", "_Alignof"):
            self.p += 1
            if self.at("("):
                p = self.p
                self.p += 1
                if self.type_name() and self.eat(")"):
                    return
                self.p = p
            self.unary()
            return
        if k == "(":
            p = self.p
            self.p += 1
            if self.type_name():
                self.need(")")
                if self.at("{"):
                    self.initializer()
                    self.postfix()
                else:
                    self.unary()
                return
            if self.at(NAME):  # a cast to a name of a type, if an operand follows
                self.p += 1
                self.pointers()
                stars = self.k[self.p - 1] != NAME
                if self.at(")") and self.peek() in (NAME, NUMBER, TEXT, CHAR, "sizeof", "~", "!", *(("(", "{", "&", "*", "-", "+") if stars else ())):
                    self.p += 1
                    if self.at("{"):
                        self.initializer()
                    else:
                        self.unary()
                    return
            self.p = p
        self.primary()
        self.postfix()

    def primary(self) -> None:
        k = self.k[self.p]
        if k == TEXT:
            while self.at(TEXT, NAME) and (self.at(TEXT) or self.peek() == TEXT):
                self.p += 1
        elif k in (NAME, NUMBER, CHAR):
            self.p += 1
            if k == NAME and self.at(TEXT):
                self.primary()
        elif k == "(":
            self.p += 1
            if self.at("{"):
                self.block()
            else:
                self.expression()
            self.need(")")
        elif k == "_Generic":
            self.p += 1
            self.need("(")
            self.p = self.partner.get(self.p - 1, self.p) + 1
        else:
            self.bad("expression expected")

    def postfix(self) -> None:
        while True:
            k = self.k[self.p]
            if k == "[":
                self.p += 1
                self.expression()
                self.need("]")
            elif k == "(":
                self.p += 1
                self.separated(self.argument, ")", trailing=False)
            elif k in (".", "->"):
                self.p += 1
                self.need(NAME)
            elif k in ("++", "--"):
                self.p += 1
            else:
                return

    def argument(self) -> None:
        if not self.type_name():
            self.assignment()


class JavaLexer(Lexer):
    def special(self, token: str) -> str:
        return TEXT if token.startswith('"""') and len(token) >= 6 else super().special(token)


JAVA_LEXER = JavaLexer(
    rf'"""[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*+"""|{_STRING}|{_CHAR}|{_NUMBER}[lLfFdD]?|[^\W\d]\w*|\$[\w$]*',
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null _",
    "( ) [ ] { } ; , . ... @ :: = > < ! ~ ? : -> == >= <= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<= >>= >>>=",
    rf"{_SPACE}|//[^\n\r]*|{_BLOCK}",
    "record sealed non permits yield",
)
_JAVA_MODIFIERS = frozenset("public protected private abstract static final transient volatile synchronized native strictfp default".split())
_JAVA_TYPES = frozenset("boolean byte short int long char float double void".split())


class Java(Parser):
    BINARY = levels("||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %")
    seen: dict[str, int] = {}

    def file(self) -> None:
        # The order of units is none of a unit's shape, so it is not checked in what is remembered.
        begun = typed = False
        while not self.at(END):
            start, kind = self.p, self.k[self.p]
            if typed and kind == "import":
                self.faults.append(Fault(start, "imports come first"))
            self.tolerant("unit", self.unit)
            package = kind == "package" or (kind == "@" and "package" in self.k[start : self.p])
            if begun and package:
                self.faults.append(Fault(start, "package comes first"))
            begun = begun or kind != ";"
            typed = typed or not (package or kind in ("import", ";"))

    def unit(self) -> None:
        if self.eat(";"):
            return
        if self.at("import"):
            self.p += 1
            self.eat("static")
            self.name()
            if self.eat("."):
                self.need("*")
            self.need(";")
            return
        self.modifiers()
        if self.at("package"):
            self.p += 1
            self.name()
            self.need(";")
            return
        if not self.type_declaration():
            self.bad("class, interface, enum or record expected")

    def name(self) -> None:
        self.need(NAME)
        while self.at(".") and self.peek() == NAME:
            self.p += 2

    def modifiers(self) -> None:
        while True:
            if self.k[self.p] in _JAVA_MODIFIERS and not (self.at("default") and self.peek() in (":", "->")):
                self.p += 1
            elif self.at("@") and self.peek() == NAME:
                self.p += 1
                self.name()
                if self.eat("("):
                    self.separated(self.element, ")", trailing=False)
            elif self.at(NAME) and self.word() in ("sealed", "non") and self.peek() in ("class", "interface", "abstract", "public", "static", "-"):
                self.p += 3 if self.peek() == "-" else 1
            else:
                return

    def element(self) -> None:
        if self.at(NAME) and self.peek() == "=":
            self.p += 2
        self.element_value()

    def element_value(self) -> None:
        if self.at("@"):
            self.modifiers()
        elif self.eat("{"):
            self.separated(self.element_value, "}")
        else:
            self.conditional()

    def type_declaration(self) -> bool:
        k = self.k[self.p]
        if k in ("class", "interface", "enum") or (k == "@" and self.peek() == "interface"):
            self.p += 2 if k == "@" else 1
            self.need(NAME)
            self.type_parameters()
        elif k == NAME and self.peek() == NAME and self.peek(2) in ("(", "<") and self.word() == "record":
            self.p += 2
            self.type_parameters()
            self.need("(")
            self.separated(self.parameter, ")", trailing=False)
        else:
            return False
        while self.at("extends", "implements") or (self.at(NAME) and self.peek() == NAME):
            self.p += 1
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        if k == "enum":
            while not self.at(";", "}"):
                self.modifiers()
                self.need(NAME)
                if self.eat("("):
                    self.separated(self.expression, ")", trailing=False)
                if self.at("{"):
                    self.body()
                if not self.eat(","):
                    break
            if not self.at("}"):
                self.need(";")
        self.units("member", self.member, "}")
        self.need("}")
        return True

    def body(self) -> None:
        self.need("{")
        self.units("member", self.member, "}")
        self.need("}")

    def type_parameters(self) -> None:
        if self.eat("<"):
            self.separated(self.type_parameter, ">", trailing=False, empty=False)

    def type_parameter(self) -> None:
        self.modifiers()
        self.need(NAME)
        if self.eat("extends"):
            self.type()
            while self.eat("&"):
                self.type()

    def type(self) -> None:
        self.modifiers_only_annotations()
        if self.k[self.p] in _JAVA_TYPES:
            self.p += 1
        elif self.eat("?"):
            if self.at("extends", "super"):
                self.p += 1
                self.type()
            return
        else:
            self.need(NAME)
            self.type_arguments()
            while self.at(".") and self.peek() == NAME:
                self.p += 2
                self.type_arguments()
        while self.at("[") and self.peek() == "]":
            self.p += 2

    def modifiers_only_annotations(self) -> None:
        while self.at("@") and self.peek() == NAME:
            self.modifiers()

    def type_arguments(self) -> None:
        if self.eat("<"):
            self.separated(self.type, ">", trailing=False)

    def member(self) -> None:
        if self.eat(";"):
            return
        self.modifiers()
        if self.at("{"):
            self.block()
            return
        if self.type_declaration():
            return
        self.type_parameters()
        if self.at(NAME) and self.peek() == "(":
            self.p += 1
            self.method()
            return
        if self.at(NAME) and self.peek() == "{":  # compact constructor
            self.p += 1
            self.block()
            return
        self.type()
        self.need(NAME)
        if self.at("("):
            self.method()
            return
        self.declarators()
        self.need(";")

    def method(self) -> None:
        self.need("(")
        self.separated(self.parameter, ")", trailing=False)
        while self.at("[") and self.peek() == "]":
            self.p += 2
        if self.eat("throws"):
            self.type()
            while self.eat(","):
                self.type()
        if self.eat("default"):
            self.element_value()
        if not self.eat(";"):
            self.block()

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.eat("...")
        if self.eat("this"):
            return
        self.need(NAME)
        while self.at("[") and self.peek() == "]":
            self.p += 2

    def declarators(self) -> None:
        """What follows the first name of a variable declaration."""
        while True:
            while self.at("[") and self.peek() == "]":
                self.p += 2
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.need(NAME)

    def initializer(self) -> None:
        if self.eat("{"):
            self.separated(self.initializer, "}")
        else:
            self.expression()

    def block(self) -> None:
        self.need("{")
        self.units("statement", self.statement, "}")
        self.need("}")

    def parenthesised(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def local(self) -> bool:
        """A local variable or class declaration, without its semicolon, if there is one here."""
        p = self.p
        try:
            self.modifiers()
            if self.type_declaration():
                return True
            if self.k[self.p] not in _JAVA_TYPES and not self.at(NAME):
                raise Bad(self.p, "declaration expected")
            self.type()
            if not self.at(NAME) or self.peek() not in ("=", ";", ",", "[", ":"):
                raise Bad(self.p, "declaration expected")
        except Bad:
            if self.p > p and self.k[p] in ("final", "@", *_JAVA_TYPES, "class", "abstract", "enum", "interface") and self.k[p + 1] not in (".", "[", "::"):
                raise
            self.p = p
            return False
        self.p += 1
        self.declarators()
        return True

    def statement(self) -> None:
        k = self.k[self.p]
        if k == "{":
            self.block()
        elif k == ";":
            self.p += 1
        elif k in ("if", "while"):
            self.p += 1
            self.parenthesised()
            self.statement()
            if k == "if" and self.eat("else"):
                self.statement()
        elif k == "do":
            self.p += 1
            self.statement()
            self.need("while")
            self.parenthesised()
            self.need(";")
        elif k == "for":
            self.p += 1
            self.need("(")
            if not self.eat(";"):
                if self.local():
                    if self.eat(":"):
                        self.expression()
                        self.need(")")
                        self.statement()
                        return
                else:
                    self.expression()
                    while self.eat(","):
                        self.expression()
                self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
                while self.eat(","):
                    self.expression()
            self.need(")")
            self.statement()
        elif k == "switch":
            self.p += 1
            self.switch()
        elif k == "try":
            self.p += 1
            resources = self.eat("(")
            while resources and not self.eat(")"):
                if not self.local():
                    self.expression()
                if not self.at(")"):
                    self.need(";")
            self.block()
            n = 0
            while self.eat("catch"):
                n += 1
                self.need("(")
                self.modifiers()
                self.type()
                while self.eat("|"):
                    self.type()
                self.need(NAME)
                self.need(")")
                self.block()
            if self.eat("finally"):
                self.block()
            elif not n and not resources:
                self.bad("catch or finally expected")
        elif k in ("return", "throw"):
            self.p += 1
            if not (k == "return" and self.at(";")):
                self.expression()
            self.need(";")
        elif k in ("break", "continue"):
            self.p += 1
            self.eat(NAME)
            self.need(";")
        elif k == "synchronized":
            self.p += 1
            self.parenthesised()
            self.block()
        elif k == "assert":
            self.p += 1
            self.expression()
            if self.eat(":"):
                self.expression()
            self.need(";")
        elif k == NAME and self.peek() == ":":
            self.p += 2
            self.statement()
        elif k == NAME and self.word() == "yield" and self.peek() not in ("=", ".", "(", "++", "--"):
            self.p += 1
            self.expression()
            self.need(";")
        else:
            p = self.p
            if self.local():
                if self.k[self.p - 1] != "}" or not any(x in ("class", "enum", "interface") for x in self.k[p : p + 4]) or self.at(";"):
                    self.need(";")
                return
            self.expression(True)
            self.need(";")

    def switch(self) -> None:
        self.parenthesised()
        self.need("{")
        while not self.eat("}"):
            if self.eat("default"):
                pass
            else:
                self.need("case")
                self.case_label()
                while self.eat(","):
                    self.case_label()
            if self.eat("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
                continue
            self.need(":")
            while not self.at("case", "default", "}", END):
                self.tolerant("statement", self.statement)

    def case_label(self) -> None:
        if self.eat("default"):
            return
        self.conditional()

    def expression(self, statement: bool = False) -> None:
        p = self.p
        if self.lambda_():
            return
        self.conditional()
        if self.k[self.p] in _ASSIGN or (self.at(">") and self.peek() in (">=",)) or (self.at(">") and self.peek() == ">" and self.peek(2) == ">="):
            while not (self.k[self.p] in _ASSIGN or self.at(">=")):
                self.p += 1
            self.p += 1
            self.expression()
        elif statement and self.k[self.p - 1] not in (")", "++", "--", "}") and self.k[p] not in ("++", "--", "new"):
            raise Bad(self.p, f"not a statement before {self.k[self.p]}")

    def lambda_(self) -> bool:
        if self.at(NAME) and self.peek() == "->":
            self.p += 2
        elif self.at("(") and self.partner.get(self.p) and self.k[self.partner[self.p] + 1] == "->":
            self.p += 1
            end = self.partner[self.p - 1]
            while self.p < end:
                if self.at(NAME) and self.peek() in (",", ")"):
                    self.p += 1
                else:
                    self.parameter()
                if self.p < end:
                    self.need(",")
            self.p = end + 2
        else:
            return False
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return True

    def conditional(self) -> None:
        self.binary()
        if self.eat("?"):
            if not self.lambda_():
                self.conditional()
            self.need(":")
            if not self.lambda_():
                self.conditional()

    def binary(self, least: int = 1) -> None:
        self.unary()
        while True:
            k = self.k[self.p]
            power = self.BINARY.get(k, 0)
            shift = k == ">" and self.peek() == ">" and self.peek(2) != ">="
            if shift and self.peek() == ">" and self.peek(2) == ">" and self.peek(3) == ">=":
                return
            if k == ">" and self.peek() == ">=":
                return
            if shift:
                power = self.BINARY["<<"]
            if not power or power < least:
                return
            self.p += 1
            if shift:
                while self.eat(">"):
                    pass
            if k == "instanceof":
                self.modifiers()
                self.type()
                self.eat(NAME)
                continue
            self.binary(power + 1)

    def unary(self) -> None:
        k = self.k[self.p]
        if k in ("+", "-", "!", "~", "++", "--"):
            self.p += 1
            self.unary()
            return
        if k == "(" and self.partner.get(self.p):
            p, end = self.p, self.partner[self.p]
            after = self.k[end + 1]
            primitive = self.k[p + 1] in _JAVA_TYPES
            if primitive or (self.k[p + 1] in (NAME, "@") and after in (NAME, TEXT, CHAR, NUMBER, "(", "!", "~", "new", "this", "super", "true", "false", "null", "switch", *_JAVA_TYPES)):
                try:
                    self.p += 1
                    self.type()
                    while self.eat("&"):
                        self.type()
                    if self.p == end:
                        self.p += 1
                        if not self.lambda_():
                            self.unary()
                        return
                except Bad:
                    pass
                self.p = p
        self.primary()
        while True:
            k = self.k[self.p]
            if k == ".":
                self.p += 1
                if self.eat("new"):
                    self.creator()
                    continue
                self.type_arguments()
                if not self.at(NAME, "class", "this", "super"):
                    self.bad("name expected")
                self.p += 1
                if self.at("("):
                    self.arguments()
            elif k == "[":
                self.p += 1
                self.expression()
                self.need("]")
            elif k in ("++", "--"):
                self.p += 1
            elif k == "::":
                self.p += 1
                if not self.eat("new"):
                    self.need(NAME)
            else:
                return

    def arguments(self) -> None:
        self.need("(")
        self.separated(self.expression, ")", trailing=False)

    def creator(self) -> None:
        self.modifiers_only_annotations()
        if self.k[self.p] in _JAVA_TYPES:
            self.p += 1
        else:
            self.need(NAME)
            self.type_arguments()
            while self.eat("."):
                self.need(NAME)
                self.type_arguments()
        if self.at("["):
            empty = self.peek() == "]"
            while self.eat("["):
                if not self.at("]"):
                    self.expression()
                self.need("]")
            if empty:
                self.need("{")
                self.separated(self.initializer, "}")
            return
        self.arguments()
        if self.at("{"):
            self.body()

    def primary(self) -> None:
        k = self.k[self.p]
        if k in (NUMBER, TEXT, CHAR, "true", "false", "null"):
            self.p += 1
        elif k in ("this", "super"):
            self.p += 1
            if self.at("("):
                self.arguments()
        elif k == NAME:
            if self.peek() in ("<", "[", "."):  # a type before :: or .class
                p = self.p
                try:
                    self.type()
                    if self.at("::") or (self.at(".") and self.peek() == "class"):
                        return
                except Bad:
                    pass
                self.p = p
            self.p += 1
            if self.at("("):
                self.arguments()
        elif k in _JAVA_TYPES:
            self.type()
            if self.at("::"):
                return
            self.need(".")
            self.need("class")
        elif k == "(":
            self.parenthesised()
        elif k == "new":
            self.p += 1
            self.creator()
        elif k == "switch":
            self.p += 1
            self.switch()
        else:
            self.bad("expression expected")


class GoLexer(Lexer):
    def special(self, token: str) -> str:
        if token[0] == "`" and len(token) > 1:
            return TEXT
        return super().special(token)

    def kind(self, token: str) -> str:
        if token[:1] == "\n" or (token[:2] == "/*" and len(token) > 3):
            return "newline" if "\n" in token else "comment"
        return super().kind(token)

    def codes(self, text: str) -> str:
        """With the semicolons that line ends stand for."""
        codes = super().codes(text + "\n")
        return _GO_REST.sub("", _GO_ENDS.sub(CODES[";"], codes))

    def places(self, text: str) -> list[int]:
        codes = super().codes(text + "\n")
        marked = {m.start() for m in _GO_ENDS.finditer(codes)}
        return [k for k, c in enumerate(codes) if k in marked or c not in (CODES["newline"], CODES["comment"])]


_GO_ENDS = re.compile(
    "(?<=[" + "".join(CODES[x] for x in (NAME, NUMBER, TEXT, CHAR, "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")) + "])"
    f"{CODES['comment']}*{CODES['newline']}"
)
_GO_REST = re.compile(f"[{CODES['newline']}{CODES['comment']}]+")


GO_LEXER = GoLexer(
    rf"\n|{_BLOCK}|`[^`]*`|{_STRING}|{_CHAR}|{_NUMBER}i?|[^\W\d]\w*",
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "( ) [ ] { } + - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... , ; . :",
    r"[ \t\r﻿]+|//[^\n]*",
)


class Go(Parser):
    BINARY = levels("||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^")
    seen: dict[str, int] = {}
    composite = True

    def file(self) -> None:
        if self.at(END):
            return
        self.tolerant("package", self.package)
        started = False
        while not self.at(END):
            # The order of units is none of a unit's shape, so it is not checked in what is remembered.
            if started and self.at("import"):
                self.faults.append(Fault(self.p, "imports come first"))
            started = started or self.at("const", "var", "type", "func")
            self.tolerant("unit", self.unit)

    def package(self) -> None:
        self.need("package")
        self.need(NAME)
        self.need(";")

    def unit(self) -> None:
        k = self.k[self.p]
        if k == ";":
            self.p += 1
            return
        self.composite = True
        if k == "import":
            self.p += 1
            self.group(self.import_spec)
        elif k in ("const", "var", "type"):
            self.declaration()
        elif k == "func":
            self.function()
        else:
            self.bad("declaration expected")
        self.end()

    def end(self) -> None:
        if not self.at(")", "}", END):
            self.need(";")

    def group(self, rule) -> None:
        if self.eat("("):
            while not self.eat(")"):
                rule()
                if not self.at(")"):
                    self.need(";")
        else:
            rule()

    def import_spec(self) -> None:
        if self.at(NAME, "."):
            self.p += 1
        self.need(TEXT)

    def declaration(self) -> None:
        k = self.k[self.p]
        self.p += 1
        self.group({"const": self.const_spec, "var": self.var_spec, "type": self.type_spec}[k])

    def names(self) -> None:
        self.need(NAME)
        while self.eat(","):
            self.need(NAME)

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need(NAME)
        if self.at("[") and self.peek() == NAME and self.peek(2) not in ("]", "."):
            p = self.p
            try:
                self.type_parameters()
            except Bad:
                self.p = p
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if self.eat("]"):
                return
            self.need(",")
            if self.eat("]"):
                return

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def function(self) -> None:
        self.p += 1
        if self.at("("):
            self.parameters()
        self.need(NAME)
        if self.at("["):
            self.type_parameters()
        self.signature()
        if self.at("{"):
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.k[self.p] in (NAME, "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        self.separated(self.parameter, ")")

    def parameter(self) -> None:
        if self.eat("..."):
            self.type()
            return
        if self.at(NAME) and self.peek() not in (",", ")", "."):
            p = self.p
            if self.peek() == "[":
                try:
                    self.p += 1
                    self.type()
                    if self.at(",", ")"):
                        return
                except Bad:
                    pass
                self.p = p
                self.type()
                return
            self.p += 1
            self.eat("...")
        self.type()

    def type(self) -> None:
        k = self.k[self.p]
        if k == NAME:
            self.p += 1
            if self.at(".") and self.peek() == NAME:
                self.p += 2
            if self.at("[") and self.peek() != "]":
                p = self.p
                try:
                    self.p += 1
                    self.separated(self.type, "]", empty=False)
                except Bad:
                    self.p = p
        elif k == "*":
            self.p += 1
            self.type()
        elif k == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.p += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    self.expression()
                self.need("]")
            self.type()
        elif k == "map":
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.p += 1
            self.eat("<-")
            self.type()
        elif k == "<-":
            self.p += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.p += 1
            self.signature()
        elif k == "struct":
            self.p += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                if not self.at("}"):
                    self.need(";")
        elif k == "interface":
            self.p += 1
            self.need("{")
            while not self.eat("}"):
                if self.at(NAME) and self.peek() == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                if not self.at("}"):
                    self.need(";")
        else:
            self.bad("type expected")

    def field(self) -> None:
        if self.eat("*"):
            self.type()
        elif self.at(NAME) and self.peek() in (";", "}", ".", TEXT):
            self.type()
        else:
            self.names()
            self.type()
        self.eat(TEXT)

    def block(self) -> None:
        outer, self.composite = self.composite, True
        self.need("{")
        self.units("statement", self.statement, "}")
        self.need("}")
        self.composite = outer

    def statement(self) -> None:
        k = self.k[self.p]
        if k == ";":
            self.p += 1
            return
        if k in ("const", "var", "type"):
            self.declaration()
        elif k == "{":
            self.block()
        elif k == "if":
            self.if_()
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.p += 1
            self.clauses(self.select_case)
        elif k == "return":
            self.p += 1
            if not self.at(";", "}"):
                self.expressions()
        elif k in ("break", "continue"):
            self.p += 1
            self.eat(NAME)
        elif k == "goto":
            self.p += 1
            self.need(NAME)
        elif k == "fallthrough":
            self.p += 1
        elif k in ("go", "defer"):
            self.p += 1
            self.expression()
            if self.k[self.p - 1] != ")":
                self.bad("call expected")
        elif k == NAME and self.peek() == ":":
            self.p += 2
            if not self.at("}"):
                self.statement()
            return
        else:
            self.simple()
        self.end()

    def simple(self, ranged: bool = False) -> bool:
        """A simple statement; whether it is a range clause."""
        if ranged and self.eat("range"):
            self.expression()
            return True
        p = self.p
        self.expressions()
        k = self.k[self.p]
        if k in _ASSIGN:
            if k == ":=" and any(x not in (NAME, ",") for x in self.k[p : self.p]):
                self.bad("name expected")
            self.p += 1
            if ranged and self.eat("range"):
                self.expression()
                return True
            self.expressions()
        elif k in ("++", "--"):
            self.p += 1
        elif k == "<-":
            self.p += 1
            self.expression()
        elif self.k[self.p - 1] != ")" and self.k[p] != "<-":
            raise Bad(self.p, f"not a statement before {k}")
        return False

    def header(self) -> None:
        """[simple ;] [simple] before a block."""
        outer, self.composite = self.composite, False
        if not self.at("{"):
            if not self.at(";"):
                self.condition()
            if self.eat(";") and not self.at("{"):
                self.condition()
        self.composite = outer

    def condition(self) -> None:
        p = self.p
        self.expressions()
        if self.k[self.p] in _ASSIGN or self.at("++", "--", "<-"):
            self.p = p
            self.simple()

    def if_(self) -> None:
        self.p += 1
        if self.at("{"):
            self.bad("condition expected")
        self.header()
        self.block()
        if self.eat("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.p += 1
        outer, self.composite = self.composite, False
        if not self.at("{"):
            ranged = False
            if not self.at(";"):
                p = self.p
                if self.at("range"):
                    ranged = self.simple(True)
                else:
                    self.expressions()
                    if self.k[self.p] in _ASSIGN or self.at("++", "--", "<-"):
                        self.p = p
                        ranged = self.simple(True)
            if not ranged and self.eat(";"):
                if not self.at(";"):
                    self.expression()
                self.need(";")
                if not self.at("{"):
                    self.simple()
        self.composite = outer
        self.block()

    def switch(self) -> None:
        self.p += 1
        self.header()
        self.clauses(self.switch_case)

    def clauses(self, case) -> None:
        outer, self.composite = self.composite, True
        self.need("{")
        while not self.eat("}"):
            if not self.eat("default"):
                self.need("case")
                case()
            self.need(":")
            while not self.at("case", "default", "}", END):
                self.tolerant("statement", self.statement)
        self.composite = outer

    def switch_case(self) -> None:
        self.separated_types()

    def separated_types(self) -> None:
        while True:
            self.type_or_expression()
            if not self.eat(","):
                return

    def type_or_expression(self) -> None:
        p = self.p
        if self.k[p] in ("[", "map", "chan", "func", "struct", "interface", "*"):
            try:
                self.type()
                if self.at(",", ":", ")"):
                    return
            except Bad:
                pass
            self.p = p
        self.expression()

    def select_case(self) -> None:
        self.simple()

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self) -> None:
        self.binary()

    def unary(self) -> None:
        if self.k[self.p] in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            if self.at("<-") and self.peek() == "chan":
                self.type()
                self.postfix(True)
                return
            self.p += 1
            self.unary()
            return
        self.primary()

    def primary(self) -> None:
        k = self.k[self.p]
        typed = False
        if k == NAME:
            self.p += 1
            typed = self.composite
        elif k in (NUMBER, TEXT, CHAR):
            self.p += 1
        elif k == "(":
            outer, self.composite = self.composite, True
            self.p += 1
            self.type_or_expression()
            self.need(")")
            self.composite = outer
        elif k == "func":
            self.p += 1
            self.signature()
            if self.at("{"):
                self.block()
        elif k in ("[", "map", "chan", "struct", "interface"):
            self.type()
            if not self.at("{", "("):
                self.bad("{ expected")
            typed = self.k[self.p] == "{"
        else:
            self.bad("expression expected")
        self.postfix(typed)

    def postfix(self, typed: bool) -> None:
        while True:
            k = self.k[self.p]
            if k == ".":
                self.p += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    typed = False
                else:
                    self.need(NAME)
            elif k == "(":
                outer, self.composite = self.composite, True
                self.p += 1
                self.separated(self.argument, ")")
                self.composite = outer
                typed = False
            elif k == "[":
                outer, self.composite = self.composite, True
                self.p += 1
                if not self.at(":"):
                    self.type_or_expression()
                while self.at(":", ","):
                    self.p += 1
                    if not self.at(":", "]"):
                        self.type_or_expression()
                self.need("]")
                self.composite = outer
            elif k == "{" and typed:
                self.literal()
                typed = False
            else:
                return

    def argument(self) -> None:
        self.type_or_expression()
        self.eat("...")

    def literal(self) -> None:
        outer, self.composite = self.composite, True
        self.need("{")
        self.separated(self.element, "}")
        self.composite = outer

    def element(self) -> None:
        self.element_value()
        if self.eat(":"):
            self.element_value()

    def element_value(self) -> None:
        if self.at("{"):
            self.literal()
        else:
            self.expression()
