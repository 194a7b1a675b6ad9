"""Rust 2021."""

from __future__ import annotations

from symgraph.llm.syntax.base import CHAR, END, NAME, NUMBER, TEXT, Lexer, Parser
from symgraph.llm.syntax.clike import levels

LIFETIME = "lifetime"


class RustLexer(Lexer):
    def special(self, token: str) -> str:
        c = token[0]
        if c == "'" and len(token) > 1:
            return CHAR if token.endswith("'") and len(token) > 2 else LIFETIME
        return super().special(token)

    def kind(self, token: str) -> str:
        if token[:1] in "rbc" and token[-1:] in "\"'#" and len(token) > 2:
            return CHAR if token.endswith("'") else TEXT
        return super().kind(token)


_INNER = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
_MIDDLE = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_INNER})*+\*/"
_BLOCK = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_MIDDLE})*+\*/"
_RAW = "|".join(rf'[bc]?r{h}"(?:[^"]|"(?!{h}))*+"{h}' if h else r'[bc]?r"[^"]*+"' for h in ("###", "##", "#", ""))
RUST_LEXER = RustLexer(
    _RAW + r"|[bc]?\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}))'|'(?:[^\W\d]\w*)"
    r"|(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?|r#[^\W\d]\w*|[^\W\d]\w*",
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self "
    "static struct super trait true type unsafe use where while",
    "{ } ( ) [ ] ; , . .. ..= ... :: : -> => = == != < > <= >= + - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= @ # $ ? _ ~",
    rf"[ \t\f\v\r\n﻿]+|//[^\n]*|{_BLOCK}",
    "union default raw macro_rules",
)
RUST_LEXER.known["_"] = "_"
_ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
_PATH = (NAME, "self", "Self", "super", "crate")
_ENDS_BLOCK = ("if", "match", "while", "for", "loop", "unsafe", "{")


class Rust(Parser):
    BINARY = levels("||", "&&", "== != < > <= >=", "|", "^", "&", "<<", "+ -", "* / %")
    seen: dict[str, int] = {}
    structs = True

    def unit(self) -> None:
        if self.at("#") and self.peek() == "!" and self.peek(2) == "[":
            self.p += 2
            self.tree()
            return
        if not self.item():
            self.bad("item expected")

    def tree(self) -> None:
        """A bracketed token tree."""
        if self.k[self.p] not in ("(", "[", "{") or self.p not in self.partner:
            self.bad("bracket expected")
        end = self.partner[self.p]
        for k in range(self.p, end):
            if self.k[k].startswith(("damage", "unterminated")):
                self.p = k
                self.bad("damage")
        self.p = end + 1

    def attributes(self) -> None:
        while self.at("#"):
            self.p += 1
            self.eat("!")
            if not self.at("["):
                self.bad("[ expected")
            self.tree()

    def visibility(self) -> None:
        if self.eat("pub") and self.at("(") and self.peek() in ("crate", "super", "self", "in"):
            self.tree()

    def item(self) -> bool:
        """An item, if one stands here."""
        self.attributes()
        self.visibility()
        k, after = self.k[self.p], self.peek()
        if k == ";":
            self.p += 1
        elif k in ("const", "async", "unsafe", "extern", "fn") and self.function_here():
            self.function()
        elif k == "struct" or (k == NAME and after == NAME and self.peek(2) in ("{", "<") and self.word() == "union"):
            self.p += 1
            self.need(NAME)
            self.generics()
            if self.at("("):
                self.p += 1
                self.separated(self.tuple_field, ")")
                self.where()
                self.need(";")
            else:
                self.where()
                if not self.eat(";"):
                    self.fields()
        elif k == "enum":
            self.p += 1
            self.need(NAME)
            self.generics()
            self.where()
            self.need("{")
            self.separated(self.variant, "}")
        elif k == "trait" or (k == "unsafe" and after == "trait"):
            self.eat("unsafe")
            self.p += 1
            self.need(NAME)
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            self.members()
        elif k == "impl" or (k == "unsafe" and after == "impl"):
            self.eat("unsafe")
            self.p += 1
            if self.at("<") and self.peek() in (LIFETIME, NAME, "const", ">", "#"):
                self.generics()
            self.eat("const")
            self.eat("!")
            self.type()
            if self.eat("for"):
                self.type()
            self.where()
            self.members()
        elif k in ("const", "static"):
            self.p += 1
            self.eat("mut")
            if not self.eat("_"):
                self.need(NAME)
            self.need(":")
            self.type()
            if self.eat("="):
                self.expression()
            self.need(";")
        elif k == "type":
            self.p += 1
            self.need(NAME)
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.where()
            self.need(";")
        elif k == "mod":
            self.p += 1
            self.need(NAME)
            if not self.eat(";"):
                self.need("{")
                self.units("unit", self.unit, "}")
                self.need("}")
        elif k == "use":
            self.p += 1
            self.use_tree()
            self.need(";")
        elif k == "extern" and after == "crate":
            self.p += 2
            if not self.eat("self"):
                self.need(NAME)
            if self.eat("as") and not self.eat("_"):
                self.need(NAME)
            self.need(";")
        elif k == "extern" and (after == "{" or after == TEXT):
            self.p += 1
            self.eat(TEXT)
            self.members()
        elif k == NAME and after == "!" and self.peek(2) == NAME and self.word() == "macro_rules":
            self.p += 3
            brace = self.at("{")
            self.tree()
            if not brace:
                self.need(";")
        elif k in _PATH and self.macro_here():
            while not self.eat("!"):
                self.p += 1
            brace = self.at("{")
            self.tree()
            if not brace:
                self.need(";")
        else:
            return False
        return True

    def macro_here(self) -> bool:
        p = self.p
        while self.k[p] in _PATH or self.k[p] == "::":
            p += 1
        return self.k[p] == "!" and self.k[p + 1] in ("(", "[", "{")

    def function_here(self) -> bool:
        p = self.p
        while self.k[p] in ("const", "async", "unsafe", "extern", TEXT):
            p += 1
        return self.k[p] == "fn" and self.k[p + 1] == NAME

    def function(self) -> None:
        while not self.eat("fn"):
            self.p += 1
        self.need(NAME)
        self.generics()
        self.need("(")
        self.separated(self.parameter, ")")
        if self.eat("->"):
            self.type()
        self.where()
        if not self.eat(";"):
            self.block()

    def parameter(self) -> None:
        self.attributes()
        p = self.p
        if self.eat("&"):
            self.eat(LIFETIME)
        self.eat("mut")
        if self.eat("self"):
            if self.eat(":"):
                self.type()
            return
        self.p = p
        if self.eat("..."):
            return
        self.pattern()
        self.need(":")
        self.type()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def fields(self) -> None:
        self.need("{")
        self.separated(self.field, "}")

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.need(NAME)
        self.need(":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.need(NAME)
        if self.eat("("):
            self.separated(self.tuple_field, ")")
        elif self.at("{"):
            self.fields()
        if self.eat("="):
            self.expression()

    def members(self) -> None:
        self.need("{")
        self.units("member", self.unit_member, "}")
        self.need("}")

    def unit_member(self) -> None:
        if self.at("#") and self.peek() == "!":
            self.attributes()
            return
        self.attributes()
        if self.at(NAME) and self.peek() in ("fn", "const", "type", "unsafe", "async", "impl") and self.word() == "default":
            self.p += 1
        if not self.item():
            self.bad("item expected")

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                self.separated(self.use_tree, "}")
                return
            if self.k[self.p] not in _PATH:
                self.bad("path expected")
            self.p += 1
            if not self.eat("::"):
                break
        if self.eat("as") and not self.eat("_"):
            self.need(NAME)

    def generics(self) -> None:
        if self.eat("<"):
            self.separated(self.generic, ">")

    def generic(self) -> None:
        self.attributes()
        if self.eat(LIFETIME):
            if self.eat(":"):
                while self.eat(LIFETIME):
                    self.eat("+")
            return
        if self.eat("const"):
            self.need(NAME)
            self.need(":")
            self.type()
            if self.eat("="):
                self.generic_argument()
            return
        self.need(NAME)
        if self.eat(":"):
            self.bounds()
        if self.eat("="):
            self.type()

    def bounds(self) -> None:
        while self.at(LIFETIME, "?", "(", "for", "::", "<", "~", *_PATH):
            if not self.eat(LIFETIME):
                opened = self.eat("(")
                self.eat("?")
                if self.eat("~"):
                    self.need("const")
                if self.eat("for"):
                    self.generics()
                self.path(False)
                if opened:
                    self.need(")")
            if not self.eat("+"):
                return

    def where(self) -> None:
        if not self.eat("where"):
            return
        while not self.at("{", ";", "=", END):
            if not self.eat(LIFETIME):
                if self.eat("for"):
                    self.generics()
                self.type()
            self.need(":")
            self.bounds()
            if not self.eat(","):
                return

    # types and paths
    def type(self) -> None:
        k = self.k[self.p]
        if k in ("&", "&&"):
            self.p += 1
            self.eat(LIFETIME)
            self.eat("mut")
            self.type()
        elif k == "*":
            self.p += 1
            if not (self.eat("const") or self.eat("mut")):
                self.bad("const or mut expected")
            self.type()
        elif k == "(":
            self.p += 1
            self.separated(self.type, ")")
        elif k == "[":
            self.p += 1
            self.type()
            if self.eat(";"):
                self.expression()
            self.need("]")
        elif k in ("!", "_"):
            self.p += 1
        elif k in ("impl", "dyn"):
            self.p += 1
            self.bounds()
            return
        elif k in ("fn", "unsafe", "extern", "for"):
            if self.eat("for"):
                self.generics()
            self.eat("unsafe")
            if self.eat("extern"):
                self.eat(TEXT)
            if self.eat("fn"):
                self.need("(")
                self.separated(self.fn_type_parameter, ")")
                if self.eat("->"):
                    self.type()
            else:
                self.path(False)
        elif k in _PATH or k in ("::", "<"):
            self.path(False)
            if self.at("!"):
                self.p += 1
                self.tree()
        else:
            self.bad("type expected")

    def fn_type_parameter(self) -> None:
        if self.eat("..."):
            return
        if self.at(NAME, "_") and self.peek() == ":":
            self.p += 2
        self.type()

    def path(self, expression: bool) -> None:
        if self.eat("<"):
            self.type()
            if self.eat("as"):
                self.path(False)
            self.need(">")
            self.need("::")
        else:
            self.eat("::")
        while True:
            if self.k[self.p] not in _PATH:
                self.bad("path expected")
            self.p += 1
            if not expression and self.at("<"):
                self.generic_arguments()
            elif not expression and self.at("("):
                self.p += 1
                self.separated(self.type, ")")
                if self.eat("->"):
                    self.type()
            if not self.at("::"):
                return
            if self.peek() in ("{", "*"):
                return
            self.p += 1
            if self.at("<"):
                self.generic_arguments()
                if not self.eat("::"):
                    return

    def generic_arguments(self) -> None:
        self.need("<")
        self.separated(self.generic_argument, ">")

    def generic_argument(self) -> None:
        if self.eat(LIFETIME) or self.eat(NUMBER) or self.eat(TEXT) or self.eat("true") or self.eat("false") or self.eat(CHAR):
            return
        if self.at("-") and self.peek() == NUMBER:
            self.p += 2
            return
        if self.at("{"):
            self.block()
            return
        if self.at(NAME) and self.peek() in ("=", ":"):
            self.p += 1
            if self.eat("="):
                self.type()
            else:
                self.p += 1
                self.bounds()
            return
        self.type()

    # patterns
    def pattern(self) -> None:
        self.eat("|")
        self.one_pattern()
        while self.eat("|"):
            self.one_pattern()

    def one_pattern(self) -> None:
        k = self.k[self.p]
        if k == "_":
            self.p += 1
        elif k == "..":
            self.p += 1
            if self.at(NUMBER, CHAR, "-"):
                self.literal()
        elif k == "..=":
            self.p += 1
            self.literal()
        elif k in ("&", "&&"):
            self.p += 1
            self.eat("mut")
            self.one_pattern()
        elif k == "(":
            self.p += 1
            self.separated(self.pattern, ")")
        elif k == "[":
            self.p += 1
            self.separated(self.pattern, "]")
        elif k in ("ref", "mut") or (k == NAME and self.peek() == "@"):
            self.eat("ref")
            self.eat("mut")
            self.need(NAME)
            if self.eat("@"):
                self.one_pattern()
        elif k in (NUMBER, TEXT, CHAR, "true", "false", "-"):
            self.literal()
            self.range_end()
        elif k in _PATH or k in ("::", "<"):
            self.path(True)
            if self.at("!"):
                self.p += 1
                self.tree()
            elif self.eat("("):
                self.separated(self.pattern, ")")
            elif self.at("{"):
                self.p += 1
                self.separated(self.field_pattern, "}")
            else:
                self.range_end()
        elif k == "const" and self.peek() == "{":
            self.p += 1
            self.block()
        else:
            self.bad("pattern expected")

    def range_end(self) -> None:
        if self.at("..", "..=", "..."):
            self.p += 1
            if self.at(NUMBER, CHAR, "-", TEXT):
                self.literal()
            elif self.k[self.p] in _PATH:
                self.path(True)

    def literal(self) -> None:
        self.eat("-")
        if not self.at(NUMBER, TEXT, CHAR, "true", "false"):
            self.bad("literal expected")
        self.p += 1

    def field_pattern(self) -> None:
        self.attributes()
        if self.eat(".."):
            return
        if self.at(NAME, NUMBER) and self.peek() == ":":
            self.p += 2
            self.pattern()
            return
        self.eat("ref")
        self.eat("mut")
        self.need(NAME)

    # statements
    def block(self) -> None:
        outer, self.structs = self.structs, True
        self.need("{")
        self.units("statement", self.statement, "}")
        self.need("}")
        self.structs = outer

    def statement(self) -> None:
        if self.eat(";"):
            return
        self.attributes()
        k = self.k[self.p]
        if k == "let":
            self.p += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expression()
                if self.eat("else"):
                    self.block()
            self.need(";")
            return
        item = k in ("fn", "struct", "enum", "trait", "impl", "use", "mod", "type", "pub", "static", "extern") or (
            k in ("const", "unsafe", "async") and self.peek() not in ("{", "move", "|", "||")
        )
        if (item or (k == NAME and self.peek() == "!" and self.peek(2) == NAME)) and self.item():
            return
        p = self.p
        if k in _ENDS_BLOCK or (k == LIFETIME and self.peek() == ":" and self.peek(2) in ("loop", "while", "for", "{")):
            self.block_like()
            if self.at(".", "?"):
                self.postfix()
                self.rest()
            else:
                self.eat(";")
                return
        elif k in _PATH and self.macro_here():
            q = self.p
            while not self.eat("!"):
                self.p += 1
            brace = self.at("{")
            self.tree()
            if brace and not self.at(".", "?"):
                self.eat(";")
                return
            self.p = q
            self.expression()
        else:
            self.expression()
        if not self.at("}"):
            self.need(";")
        if self.p == p:
            self.bad("statement expected")

    def rest(self) -> None:
        """What may follow an operand that is already read."""
        while (power := self.power()) >= 1:
            self.operator()
            self.binary(power + 1)
        if self.k[self.p] in _ASSIGN:
            self.p += 1
            self.expression()

    def block_like(self) -> None:
        if self.eat(LIFETIME):
            self.need(":")
        k = self.k[self.p]
        if k == "{":
            self.block()
        elif k in ("unsafe", "loop"):
            self.p += 1
            self.block()
        elif k == "if":
            self.p += 1
            self.header()
            self.block()
            if self.eat("else"):
                if self.at("if"):
                    self.block_like()
                else:
                    self.block()
        elif k == "while":
            self.p += 1
            self.header()
            self.block()
        elif k == "for":
            self.p += 1
            self.pattern()
            self.need("in")
            self.header()
            self.block()
        elif k == "match":
            self.p += 1
            self.header()
            self.need("{")
            outer, self.structs = self.structs, True
            self.units("arm", self.arm, "}")
            self.structs = outer
            self.need("}")
        else:
            self.bad("block expected")

    def header(self) -> None:
        outer, self.structs = self.structs, False
        self.expression()
        self.structs = outer

    def arm(self) -> None:
        self.attributes()
        self.pattern()
        if self.eat("if"):
            self.expression()
        self.need("=>")
        if self.at("{"):
            self.block()
            if self.eat(",") or self.at("}"):
                return
            if self.at(".", "?"):
                self.postfix()
                self.rest()
            else:
                return
        else:
            self.expression()
        if not self.at("}"):
            self.need(",")

    # expressions
    def expression(self) -> None:
        k = self.k[self.p]
        if k in ("return", "break"):
            self.p += 1
            if k == "break":
                self.eat(LIFETIME)
            if not self.at(";", "}", ")", "]", ",", "=>", "else") and not (self.at("{") and not self.structs):
                self.expression()
            return
        if k in ("..", "..="):
            self.p += 1
            if not self.at(")", "]", "}", ";", ",", "{"):
                self.binary()
            return
        if k in ("|", "||", "move") or (k == "async" and self.peek() in ("move", "|", "||") and not (self.peek() == "move" and self.peek(2) == "{")):
            self.closure()
            return
        self.binary()
        if self.at("..", "..="):
            self.p += 1
            if not self.at(")", "]", "}", ";", ",", "=>") and not (self.at("{") and not self.structs):
                self.binary()
        elif self.k[self.p] in _ASSIGN or (self.at(">") and self.peek() == ">="):
            self.p += 2 if self.at(">") else 1
            self.expression()

    def closure(self) -> None:
        self.eat("async")
        self.eat("move")
        if not self.eat("||"):
            self.need("|")
            while not self.eat("|"):
                self.one_pattern()
                if self.eat(":"):
                    self.type()
                if not self.at("|"):
                    self.need(",")
        if self.eat("->"):
            self.type()
            self.block()
        else:
            self.expression()

    def power(self) -> int:
        k = self.k[self.p]
        if k == ">" and self.peek() == ">":
            return self.BINARY["<<"]
        if k == ">" and self.peek() == ">=":
            return 0
        return self.BINARY.get(k, 0)

    def operator(self) -> None:
        if self.at(">") and self.peek() == ">":
            self.p += 1
        self.p += 1

    def binary(self, least: int = 1) -> None:
        self.unary()
        while (power := self.power()) >= least:
            k = self.k[self.p]
            self.operator()
            self.binary(power + 1)
            if power == 3 and self.power() == 3 and k != ">>":
                self.bad("comparisons do not chain")

    def unary(self) -> None:
        if self.at("-", "!", "*"):
            self.p += 1
            self.unary()
            return
        if self.at("&", "&&"):
            self.p += 1
            if self.at(NAME) and self.peek() in ("const", "mut") and self.word() == "raw":
                self.p += 1
                self.eat("const")
            self.eat("mut")
            self.unary()
            return
        self.primary()
        self.postfix()
        while self.eat("as"):
            self.type()

    def primary(self) -> None:
        k = self.k[self.p]
        if k in (NUMBER, TEXT, CHAR, "true", "false", "_"):
            self.p += 1
        elif k in _PATH or k in ("::", "<"):
            self.path(True)
            if self.at("!") and self.peek() in ("(", "[", "{"):
                self.p += 1
                self.tree()
            elif self.at("{") and self.structs:
                self.struct()
        elif k == "(":
            outer, self.structs = self.structs, True
            self.p += 1
            self.separated(self.element, ")")
            self.structs = outer
        elif k == "[":
            outer, self.structs = self.structs, True
            self.p += 1
            if not self.eat("]"):
                self.element()
                if self.eat(";"):
                    self.expression()
                    self.need("]")
                elif not self.eat("]"):
                    self.need(",")
                    self.separated(self.element, "]")
            self.structs = outer
        elif k in ("async", "const"):
            self.p += 1
            self.eat("move")
            self.block()
        elif k in _ENDS_BLOCK or k == LIFETIME:
            self.block_like()
        elif k == "continue":
            self.p += 1
            self.eat(LIFETIME)
        elif k in ("return", "break", "|", "||", "move"):
            self.expression()
        elif k == "let":
            self.p += 1
            self.pattern()
            self.need("=")
            self.binary(2)
        else:
            self.bad("expression expected")

    def element(self) -> None:
        self.attributes()
        self.expression()

    def struct(self) -> None:
        self.need("{")
        self.separated(self.struct_field, "}")

    def struct_field(self) -> None:
        self.attributes()
        if self.eat(".."):
            if not self.at("}"):
                self.expression()
            return
        if not (self.eat(NAME) or self.eat(NUMBER)):
            self.bad("field expected")
        if self.eat(":"):
            self.expression()

    def postfix(self) -> None:
        while True:
            k = self.k[self.p]
            if k == "?":
                self.p += 1
            elif k == ".":
                self.p += 1
                if self.at(NUMBER, "await"):
                    self.p += 1
                    continue
                self.need(NAME)
                if self.at("::"):
                    self.p += 1
                    self.generic_arguments()
            elif k == "(":
                outer, self.structs = self.structs, True
                self.p += 1
                self.separated(self.element, ")")
                self.structs = outer
            elif k == "[":
                outer, self.structs = self.structs, True
                self.p += 1
                self.expression()
                self.need("]")
                self.structs = outer
            else:
                return
