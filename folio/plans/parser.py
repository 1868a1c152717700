"""Query text to a QuerySpec: a scanner and a recursive-descent parser, without dependencies.

    select price, -weight kind ~ /plated|polished/ and name ~ steel where size >= 40 order -price, name top 25

Clauses come in any order and may repeat; keywords are case-insensitive.
"""

from __future__ import annotations

import re

from folio.types import Comparison, QueryError, QuerySpec

KEYWORDS = ("top", "select", "where", "order", "sort", "recent", "verbose")
_WORD = re.compile(r"[^\s~\-/!,][^\s~=<>,]*")
_NUMBER = re.compile(r"-?(?:\d+(?:\.\d*)?|\.\d+)(?:%|[eE][+-]?\d+)?|-?inf")
_SLASHED = re.compile(r"/((?:[^/\\]|\\.)*)/", re.DOTALL)
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"|' + r"'((?:[^'\\]|\\.)*)'", re.DOTALL)
_MOMENT = re.compile(r"(?:19|20)\d\d-\d\d-\d\d\s\d\d:\d\d(?::\d\d)?")
_COMPARE = re.compile(r"==|<=|>=|<|>")
DEFAULT_TOP = 10


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.include, self.exclude, self.sort, self.regex, self.where = [], [], [], [], []
        self.flags, self.messages, self.top = set(), [], -1

    def fail(self, wanted: str):
        rest = self.text[self.at :].strip()
        raise QueryError(f"expected {wanted} at {rest[:30]!r}" if rest else f"expected {wanted} at the end")

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, pattern: re.Pattern) -> re.Match | None:
        self.space()
        found = pattern.match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def sign(self, char: str) -> bool:
        self.space()
        if self.text.startswith(char, self.at):
            self.at += len(char)
            return True
        return False

    def keyword(self, *words: str) -> str | None:
        """One of the words, whole, unless it is the field of a regex."""
        self.space()
        found = _WORD.match(self.text, self.at)
        if found and found[0].lower() in words and not re.match(r"\s*~", self.text[found.end() :]):
            self.at = found.end()
            return found[0].lower()
        return None

    def name(self) -> str:
        found = self.take(_WORD)
        return found[0] if found else self.fail("a name")

    def parse(self) -> QuerySpec:
        while True:
            self.space()
            if self.at >= len(self.text):
                break
            self.clause()
        return QuerySpec(tuple(self.include), tuple(self.exclude), tuple(self.sort), tuple(self.regex), tuple(self.where), self.top, frozenset(self.flags), tuple(self.messages))

    def clause(self) -> None:
        word = self.keyword(*KEYWORDS)
        if word is None:
            self.filters()
        elif word == "top":
            self.limit()
        elif word in ("recent", "verbose"):
            self.flags.add(word)
        elif word == "select":
            self.listed(self.column)
        elif word == "where":
            self.comparison()
            while self.keyword("and"):
                self.comparison()
        else:
            self.listed(self.key)

    def listed(self, item) -> None:
        item()
        while self.sign(","):
            item()

    def limit(self) -> None:
        found = self.take(_NUMBER)
        if not found:
            self.fail("a number after top")
        if re.fullmatch(r"-?\d+", found[0]):
            self.top = int(found[0])
        else:
            self.top = DEFAULT_TOP
            self.messages.append(f"top {found[0]} is not a whole number, {DEFAULT_TOP} is used")

    def column(self) -> None:
        if self.sign("-"):
            self.exclude.append(self.name())
        else:
            self.include.append(self.name())

    def key(self) -> None:
        down = self.sign("-")
        self.sort.append((self.name(), not down))

    def filters(self) -> None:
        self.filter()
        while self.keyword("and"):
            self.filter()

    def filter(self) -> None:
        field = None
        if not self.sign("!"):
            field = self.name()
            if not self.sign("~"):
                self.fail(f"a clause, or ~ after {field!r}")
        self.space()
        if self.text.startswith("/", self.at):
            found = self.take(_SLASHED) or self.fail("a closing slash")
            self.regex.append((field, found[1]))
        else:
            self.regex.append((field, self.name()))

    def comparison(self) -> None:
        column = self.name()
        op = self.take(_COMPARE) or self.fail("one of == <= < > >=")
        quoted = self.take(_QUOTED)
        if quoted:
            inner = quoted[1] if quoted[1] is not None else quoted[2]
            self.where.append(Comparison(column, op[0], re.sub(r"\\(.)", r"\1", inner), True))
            return
        found = self.take(_MOMENT) or self.take(_WORD) or self.take(_NUMBER)
        if not found:
            self.fail("a value")
        self.where.append(Comparison(column, op[0], found[0]))


def parse(text: str) -> QuerySpec:
    """The spec of a query; QueryError if it can't be read. An empty query has all defaults."""
    return _Parser(text).parse()
