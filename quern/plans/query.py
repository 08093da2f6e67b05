"""The query algebra: terms, AND, OR, NOT; its text syntax and its rewrites. Runs on the driver."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from enum import Enum


class Kind(Enum):
    TERM = "TERM"
    AND = "AND"
    OR = "OR"
    NOT = "NOT"


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    kind: Kind
    term: str = ""
    kids: tuple[Query | None, ...] = ()

    def __str__(self) -> str:
        if self.kind is Kind.TERM:
            return f'"{self.term}"'
        return f"{self.kind.value}({', '.join(map(str, self.kids))})"

    def is_empty(self) -> bool:
        if self.kind is Kind.TERM:
            return not self.term
        return not self.kids or self.kind is Kind.NOT and self.kids[0] is None


#: Unicode's white space, which str.strip would widen by U+001C to U+001F.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


def normal(text: str) -> str:
    """Trim Unicode blanks, then lower-case character by character, as the function on columns does it."""
    return "".join({"İ": "i", "Σ": "σ"}.get(c, c.lower()) for c in text.strip(_BLANKS))


def Term(term: str) -> Query:
    return Query(Kind.TERM, normal(term))


def _gather(kind: Kind, parts) -> Query:
    """Drop missing operands and splice in operands of the same kind."""
    kids: list[Query] = []
    for p in parts:
        if p is not None:
            kids.extend(p.kids if p.kind is kind else (p,))
    return Query(kind, kids=tuple(kids))


def And(*parts: Query | None) -> Query:
    return _gather(Kind.AND, parts)


def Or(*parts: Query | None) -> Query:
    return _gather(Kind.OR, parts)


def Not(inner: Query | None) -> Query:
    return Query(Kind.NOT, kids=(inner,))


def optimize(q: Query | None) -> Query | None:
    """Drop empty operands (they are neutral), lift only children, cancel double negation; None if nothing is left."""
    if q is None:
        return None
    if q.kind is Kind.TERM:
        return Term(q.term) if q.term else None
    kids = [k for k in map(optimize, q.kids) if k is not None]
    if not kids:
        return None
    if q.kind is Kind.NOT:
        inner = kids[0]
        return inner.kids[0] if inner.kind is Kind.NOT else Not(inner)
    return kids[0] if len(kids) == 1 else _gather(q.kind, kids)


def term_weights(q: Query) -> Counter[str]:
    """How often each term stands in the query, under NOT too."""
    if q.kind is Kind.TERM:
        return Counter([q.term])
    return sum((term_weights(k) for k in q.kids if k is not None), Counter())


def cost(q: Query | None, df: dict[str, int], universe: int) -> int:
    """Rows a node may give: a term's postings, the least of AND, the sum of OR, the rest for NOT."""
    if q is None:
        return 0
    if q.kind is Kind.TERM:
        return df.get(q.term, 0)
    each = [cost(k, df, universe) for k in q.kids]
    if q.kind is Kind.NOT:
        inner = each[0] if each else 0
        return universe - inner if universe > inner else universe
    return (min(each) if q.kind is Kind.AND else sum(each)) if each else 0


_TOKEN = re.compile(r"[ \t\r\n]*(?:([A-Za-z0-9_]+)|([()]))")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        while m := _TOKEN.match(text, self.at):
            self.tokens.append((m[1] or m[2], m.start(m.lastindex)))
            self.at = m.end()
        rest = text[self.at :].strip(" \t\r\n")
        if rest:
            self.tokens.append(("", text.index(rest, self.at)))
        self.k = 0

    def peek(self) -> str | None:
        return self.tokens[self.k][0] if self.k < len(self.tokens) else None

    def word(self, keyword: str) -> bool:
        if (self.peek() or "").upper() == keyword:
            self.k += 1
            return True
        return False

    def chain(self, keyword: str, part, build) -> Query:
        parts = [part()]
        while self.word(keyword):
            parts.append(part())
        return parts[0] if len(parts) == 1 else build(*parts)

    def either(self) -> Query:
        return self.chain("OR", self.both, Or)

    def both(self) -> Query:
        return self.chain("AND", self.unary, And)

    def unary(self) -> Query:
        if self.word("NOT"):
            return Not(self.unary())
        token = self.peek()
        if token is None:
            raise QuerySyntaxError("unexpected end")
        if token == "(":
            self.k += 1
            inner = self.either()
            if not self.word(")"):
                raise QuerySyntaxError("expected )")
            return inner
        if not token or token == ")":
            raise QuerySyntaxError(f"expected term at {self.tokens[self.k][1]}")
        self.k += 1
        return Term(token)


def parse(text: str) -> Query | None:
    """NOT binds before AND before OR; keywords in any case; terms are ASCII letters, digits and underscores.

    A keyword other than NOT where a term is due is a term.
    """
    reader = _Reader(text.strip())
    if not reader.tokens:
        raise QuerySyntaxError("empty query")
    q = reader.either()
    if reader.peek() is not None:
        raise QuerySyntaxError(f"trailing input at {reader.tokens[reader.k][1]}")
    return optimize(q)
