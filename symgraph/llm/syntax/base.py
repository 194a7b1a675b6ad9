"""What the parsers share: tokens, brackets, precedence climbing, recovery and the memory of shapes."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Kinds of tokens that are not themselves: name, number, text, character, lifetime, end of file and damage.
NAME, NUMBER, TEXT, CHAR, END = "name", "number", "text", "char", "end"


class Fault(NamedTuple):
    """An error: the number of the token (or -1 and an offset) and its cause."""

    token: int
    cause: str
    offset: int = -1


class Bad(Exception):
    def __init__(self, token: int, cause: str):
        super().__init__(cause)
        self.token, self.cause = token, cause


class Word(str):
    """A name that is a keyword in some places: equal to NAME, but of its own shape."""

    text = ""

    @classmethod
    def of(cls, text: str) -> Word:
        word = cls(NAME)
        word.text = text
        return word


#: The kind that each character of a string of codes stands for.
KINDS: dict[str, str] = {}


class Codes(dict):
    """A character for every kind of token, so that runs of tokens are strings."""

    def __missing__(self, kind: str) -> str:
        code = chr(0x100 + len(self))
        self[kind] = code
        KINDS[code] = Word.of(kind[5:]) if kind.startswith("word ") else kind
        return code


CODES = Codes()


def code(kind: str) -> str:
    return CODES[kind] if type(kind) is str else CODES["word " + kind.text]


def coded(kinds: list[str]) -> str:
    return "".join([CODES[k] if type(k) is str else CODES["word " + k.text] for k in kinds])


def kinds_of(codes: str) -> list[str]:
    kinds = KINDS
    return [kinds[c] for c in codes]


_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}$", "indent": "dedent"}
_BRACKETS = re.compile("[" + "".join(CODES[x] for pair in _OPEN.items() for x in pair) + "]")
_OF = {CODES[x]: x for pair in _OPEN.items() for x in pair}
_STOPS = re.compile("[" + CODES["{"] + CODES[";"] + CODES["}"] + "]")


def brackets(codes: str) -> tuple[dict[int, int], list[Fault]]:
    """The partner of each opening bracket, and what is not balanced."""
    partner, open_, faults = {}, [], []
    for m in _BRACKETS.finditer(codes):
        k, x = m.start(), _OF[m.group()]
        if x in _OPEN:
            open_.append((k, x))
        elif open_ and _OPEN[open_[-1][1]] == x:
            partner[open_.pop()[0]] = k
        else:
            faults.append(Fault(k, f"unmatched {x}"))
            if any(_OPEN[y] == x for _, y in open_):
                while _OPEN[open_[-1][1]] != x:
                    open_.pop()
                open_.pop()
    faults += [Fault(k, f"{x} is never closed") for k, x in open_]
    return partner, sorted(faults)


class Parser:
    """Recursive descent over kinds of tokens. Subclasses give `unit()` for a declaration or statement of the file.

    Runs of tokens that end with a block or a semicolon and once parsed as a unit are remembered by their kinds, names
    and values left out: the same shape parses the same way wherever it comes again.
    """

    MEMORY = 200_000
    seen: dict[str, int] = {}
    #: Binary operators by how tightly they bind.
    BINARY: dict[str, int] = {}

    def __init__(self, kinds: list[str], codes: str, partner: dict[int, int], fresh: str = ""):
        self.k, self.codes, self.partner, self.fresh = kinds, codes, partner, fresh
        self.p, self.faults = 0, []
        #: Where the nesting was too deep to go on; what follows is unknown.
        self.deep: Fault | None = None

    # tokens
    def at(self, *kinds: str) -> bool:
        return self.k[self.p] in kinds

    def peek(self, n: int = 1) -> str:
        return self.k[self.p + n] if self.p + n < len(self.k) else END

    def eat(self, kind: str) -> bool:
        if self.k[self.p] == kind:
            self.p += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.k[self.p] != kind:
            self.bad(f"{kind} expected")
        self.p += 1

    def bad(self, cause: str) -> None:
        raise Bad(self.p, f"{cause} before {self.k[self.p]}")

    def word(self, n: int = 0) -> str:
        """The contextual keyword here, empty if there is none."""
        k = self.k[self.p + n] if self.p + n < len(self.k) else END
        return k.text if type(k) is Word else ""

    def closes(self) -> int:
        """Where the bracket here closes; the end of the file if it does not."""
        return self.partner.get(self.p, len(self.k) - 1)

    # lists
    def separated(self, rule, end: str, by: str = ",", empty: bool = True, trailing: bool = True) -> None:
        """rule (by rule)* and then `end`."""
        if empty and self.eat(end):
            return
        while True:
            rule()
            if self.eat(end):
                return
            self.need(by)
            if trailing and self.eat(end):
                return

    # expressions
    def unary(self) -> None:
        raise NotImplementedError

    def binary(self, least: int = 1) -> None:
        """Precedence climbing."""
        self.unary()
        while (power := self.BINARY.get(self.k[self.p], 0)) >= least:
            self.p += 1
            self.binary(power + 1)

    # memory and recovery
    def context(self) -> str:
        """What decides on the rules besides the tokens, such as being in a loop."""
        return ""

    def remembered(self, name: str, rule) -> None:
        p, codes = self.p, self.codes
        m = _STOPS.search(codes, p)
        q = m.start() if m else len(codes)
        if m and m.group() == CODES["{"]:
            q = self.partner.get(q, -1)
        if q < 0 or q - p > 4000:
            rule()
            return
        key = f"{name} {self.context()}{codes[p : q + 2]}\n{self.fresh[p : q + 2]}"
        size = self.seen.get(key)
        if size is not None:
            self.p = p + size
            return
        before = len(self.faults)
        rule()
        # What was read is in the key: up to the token after the block, which may be a semicolon that belongs to it.
        within = self.p <= q + 1 or (self.p == q + 2 and self.k[q + 1] == ";")
        if within and len(self.faults) == before:
            if len(self.seen) > self.MEMORY:
                self.seen.clear()
            self.seen[key] = self.p - p

    def tolerant(self, name: str, rule) -> None:
        """`rule`; after an error, on with the next unit (panic mode)."""
        start = self.p
        try:
            self.remembered(name, rule)
        except Bad as e:
            self.faults.append(Fault(e.token, e.cause))
            self.p = max(self.p, start)
            self.skip(start)
        except RecursionError:
            self.deep = Fault(min(self.p, len(self.k) - 1), "nested too deeply")
            self.p = len(self.k) - 1

    def skip(self, start: int) -> None:
        """To after the next semicolon or block, or before the bracket that closes what holds this."""
        while not self.at(END):
            kind = self.k[self.p]
            if kind in (";", "newline"):
                self.p += 1
                break
            if kind in _OPEN:
                block = kind == "{"
                self.p = self.closes()
                if not self.at(END):
                    self.p += 1
                if block:
                    break
                continue
            if kind in ("}", ")", "]", "}$"):
                break
            self.p += 1
        if self.p == start and not self.at(END):
            self.p += 1

    def units(self, name: str, rule, end: str) -> None:
        while not self.at(end, END):
            self.tolerant(name, rule)

    def unit(self) -> None:
        raise NotImplementedError

    def file(self) -> None:
        while not self.at(END):
            self.tolerant("unit", self.unit)


class Lexer:
    """Splits text by one pattern; whatever is no token is damage."""

    #: Most names; not those that begin a string or go on with other letters.
    ASCII_NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?![\"'#$\x80-\U0010ffff])"

    def __init__(self, pattern: str, words: str, marks: str, trivia: str, contextual: str = ""):
        every = marks.split()
        alone = [x for x in every if len(x) == 1 and not any(y != x and y.startswith(x) for y in every) and x not in "\"'`#$@"]
        alternatives = "|".join(re.escape(x) for x in sorted(set(every) - set(alone), key=len, reverse=True))
        single = "[" + "".join(re.escape(x) for x in alone) + "]"
        self.pattern = re.compile(f"(?:{trivia})*+({self.ASCII_NAME}|{single}|{pattern}|{alternatives}|\\Z|.)", re.S)
        self.words, self.marks = frozenset(words.split()), frozenset(marks.split())
        self.contextual = {x: Word.of(x) for x in contextual.split()}
        self.known: dict[str, str] = self.fresh_known()
        self.coded: dict[str, str] = {}

    def fresh_known(self) -> dict[str, str]:
        """Kinds of tokens by their text, to be filled up to a bound."""
        if not hasattr(self, "known") or len(self.known) > 300_000:
            return {x: x for x in self.words | self.marks} | self.contextual
        return self.known

    def kind(self, token: str) -> str:
        """The kind of a token that is seen for the first time; see `kinds`."""
        c = token[:1]
        if not c:
            return END
        if c.isalpha() or c == "_" or c == "$":
            return NAME
        if c.isdigit() or (c == "." and token[1:2].isdigit()):
            return NUMBER
        return self.special(token)

    def special(self, token: str) -> str:
        c = token[0]
        if c == '"' and len(token) > 1:
            return TEXT
        if c == "'" and len(token) > 1:
            return CHAR
        return f"damage {token[:12]!r}" if c not in "\"'`/" else f"unterminated {c}"

    def codes(self, text: str) -> str:
        """The text as a string of codes, one for each token."""
        if len(self.coded) > 300_000:
            self.coded = {}
        known, new = self.coded, self.new
        return "".join([known.get(t) or new(t) for t in self.pattern.findall(text)])

    def new(self, token: str) -> str:
        k = code(self.known.get(token) or self.kind(token))
        if len(token) < 60:
            self.coded[token] = k
        return k

    def places(self, text: str) -> list[int] | None:
        """The number in the pattern's sequence of each code, if they differ."""
        return None

    def offsets(self, text: str) -> list[int]:
        """Where in the text each token begins."""
        return [m.start(1) for m in self.pattern.finditer(text)]
