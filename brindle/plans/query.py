"""Queries as data: each stands for a set of documents."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Occur(Enum):
    MUST = "must"
    SHOULD = "should"
    MUST_NOT = "must_not"


class Query:
    """Any query."""

    def __and__(self, other: Query) -> Query:
        return Bool(((Occur.MUST, self), (Occur.MUST, other)))

    def __or__(self, other: Query) -> Query:
        return Bool(((Occur.SHOULD, self), (Occur.SHOULD, other)))

    def __invert__(self) -> Query:
        return Bool(((Occur.MUST_NOT, self),))


@dataclass(frozen=True)
class MatchAll(Query):
    """Every document."""


@dataclass(frozen=True)
class MatchNone(Query):
    """No document."""


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str


@dataclass(frozen=True)
class And(Query):
    """All terms in one field."""

    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Or(Query):
    """Any of the terms in one field."""

    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Terms(Query):
    """Any of the terms in one field, for long lists."""

    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str


@dataclass(frozen=True)
class Wildcard(Query):
    field: str
    pattern: str


@dataclass(frozen=True)
class Phrase(Query):
    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Range(Query):
    """Points from low to high, both included."""

    field: str
    low: int
    high: int


@dataclass(frozen=True)
class Bool(Query):
    clauses: tuple[tuple[Occur, Query], ...]

    def of(self, occur: Occur) -> list[Query]:
        return [q for o, q in self.clauses if o is occur]


def simplified(q: Query) -> Query:
    """The same set with fewer nodes: single terms, duplicates, SHOULD clauses beside MUST, nested conjunctions."""
    if isinstance(q, (And, Or, Terms)):
        terms = tuple(dict.fromkeys(q.terms))
        if not terms:
            return MatchNone()
        return Term(q.field, terms[0]) if len(terms) == 1 else type(q)(q.field, terms)
    if isinstance(q, Phrase):
        return MatchNone() if not q.terms else Term(q.field, q.terms[0]) if len(q.terms) == 1 else q
    if not isinstance(q, Bool):
        return q
    must, should, no = ([simplified(x) for x in q.of(o)] for o in (Occur.MUST, Occur.SHOULD, Occur.MUST_NOT))
    if not q.clauses or any(isinstance(x, MatchNone) for x in must) or any(isinstance(x, MatchAll) for x in no):
        return MatchNone()
    no = [x for x in no if not isinstance(x, MatchNone)]
    if must:
        flat = []
        for x in must:  # a conjunction without exclusions is part of this one
            inner = x.clauses if isinstance(x, Bool) and all(o is Occur.MUST for o, _ in x.clauses) else ((Occur.MUST, x),)
            flat += [y for _, y in inner]
        must = [x for x in dict.fromkeys(flat) if not isinstance(x, MatchAll)] or [MatchAll()]
        should = []
    elif should:
        should = list(dict.fromkeys(x for x in should if not isinstance(x, MatchNone)))
        if not should:
            return MatchNone()
        if any(isinstance(x, MatchAll) for x in should):
            must, should = [MatchAll()], []
    elif not no:
        return MatchAll()
    if not no and len(must) + len(should) == 1:
        return (must + should)[0]
    return Bool((*((Occur.MUST, x) for x in must), *((Occur.SHOULD, x) for x in should), *((Occur.MUST_NOT, x) for x in no)))
