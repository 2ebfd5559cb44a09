"""Schema strings, JSON requests, S-expressions and query files."""

from __future__ import annotations

import json
import random

import pytest

from brindle.plans import dsl
from brindle.plans.query import And, Bool, MatchAll, MatchNone, Occur, Or, Phrase, Prefix, Range, Term, Terms, Wildcard, simplified
from brindle.plans.schema import FieldSpec, Schema

M, S, N = Occur.MUST, Occur.SHOULD, Occur.MUST_NOT


def test_schema_string():
    s = Schema.parse("$policy=dynamic, ts:longpoint+numericdv+stored, level:keyword+sorteddv, message:text+positions@msg, n:intpoint, v:numericdv, w:sorteddv+stored, x:stored")
    assert s.policy == "dynamic" and s.aliases == {"message": "msg"}
    assert s.fields["ts"] == FieldSpec("ts", "long", points=True, doc_values="numeric", stored=True)
    assert s.fields["level"].doc_values == "sorted" and s.fields["level"].stored
    assert s.fields["message"].positions and s.fields["n"].kind == "int" and not s.fields["n"].stored
    assert s.fields["w"].doc_values == "sorted" and s.fields["w"].stored and not s.fields["x"].indexed


@pytest.mark.parametrize("bad", ["a", "a:nosuch", "$policy=x", "$other=1", "a:text@", "a:text,a:keyword"])
def test_bad_schema_strings(bad):
    with pytest.raises(ValueError):
        Schema.parse(bad)


def test_field_rules():
    with pytest.raises(ValueError):
        FieldSpec("a", "keyword", indexed=True, positions=True)
    with pytest.raises(ValueError):
        FieldSpec("a", "text", points=True)


NAMES, VALUES = ["colour", "size_mm", "é"], ["red", "a*b", "p?", "-", "Ünder", "0"]


def made(r, depth):
    """A random query that both languages can say."""
    kind = r.randrange(6 if depth else 5)
    name, value = r.choice(NAMES), r.choice(VALUES)
    if kind < 3:
        return (Term, Prefix, Wildcard)[kind](name, value)
    if kind == 3:
        return Phrase(name, (value, r.choice(VALUES)))
    if kind == 4:
        return Range(name, *sorted(r.choice([0, -(1 << 63), (1 << 63) - 1, r.randint(-999, 999)]) for _ in range(2)))
    return Bool(tuple((r.choice([M, S, N]), made(r, depth - 1)) for _ in range(r.randint(1, 3))))


def as_sexpr(q):
    """Heads that say the same are taken where they fit."""
    if isinstance(q, Bool):
        kinds = {o for o, _ in q.clauses}
        if kinds == {N} and len(q.clauses) == 1:
            return ["(", "NOT", *as_sexpr(q.clauses[0][1]), ")"]
        if len(kinds) == 1 and kinds != {N}:
            return ["(", "AND" if kinds == {M} else "OR", *(t for _, x in q.clauses for t in as_sexpr(x)), ")"]
        return ["(", "BOOL", *(t for o, x in q.clauses for t in ("(", {M: "MUST", S: "SHOULD", N: "NOT"}[o], *as_sexpr(x), ")")), ")"]
    if isinstance(q, Range):
        return ["(", "RANGE", q.field, str(q.low), str(q.high), ")"]
    if isinstance(q, Phrase):
        return ["(", "PHRASE", q.field, *q.terms, ")"]
    value = {Term: "term", Prefix: "prefix", Wildcard: "pattern"}[type(q)]
    return ["(", type(q).__name__.upper(), q.field, getattr(q, value), ")"]


def as_spec(q):
    if isinstance(q, Bool):
        return {"type": "bool", "clauses": [{"occur": o.value, "query": as_spec(x)} for o, x in q.clauses]}
    if isinstance(q, Range):
        return {"type": "range", "field": q.field, "low": q.low, "high": q.high}
    if isinstance(q, Phrase):
        return {"type": "phrase", "field": q.field, "terms": list(q.terms)}
    value = {Term: "term", Prefix: "prefix", Wildcard: "pattern"}[type(q)]
    return {"type": type(q).__name__.lower(), "field": q.field, "value": getattr(q, value)}


@pytest.mark.parametrize("seed", range(60))
def test_both_languages_say_every_query(seed):
    r = random.Random(seed)
    q = made(r, 3)
    tokens = as_sexpr(q)
    for between in (" ", "\n\t "):
        assert dsl.from_sexpr(between.join(tokens)) == q
    assert dsl.from_sexpr(" ".join(tokens).replace("( ", "(").replace(" )", ")")) == q
    assert dsl.from_json(json.dumps({"query": as_spec(q)})) == dsl.Request(q, None, True, 10)
    for order in ("asc", "desc", "up"):
        request = {"top_n": seed, "sort": {"order": order, "field": "size_mm"}, "query": as_spec(q)}
        assert dsl.from_json(json.dumps(request)) == dsl.Request(q, "size_mm", order != "asc", seed)
    assert dsl.from_json(json.dumps({"query": {"type": "match_all"}, "sort": {"field": "colour"}})) == dsl.Request(MatchAll(), "colour", True, 10)


@pytest.mark.parametrize("seed", range(60))
def test_spoilt_expressions_are_refused(seed):
    r = random.Random(seed)
    tokens = as_sexpr(made(r, 2))
    heads = [k for k, t in enumerate(tokens) if k and tokens[k - 1] == "("]
    leaves = [k for k in heads if tokens[k] in ("TERM", "PREFIX", "WILDCARD", "PHRASE", "RANGE")]
    at, leaf = r.choice(heads), r.choice(leaves)
    end = tokens.index(")", leaf)
    spoilt = {
        "not closed": tokens[:-1],
        "not opened": tokens[1:],
        "closed twice": [*tokens, ")"],
        "two of them": tokens * 2,
        "unknown head": [*tokens[:at], tokens[at].lower(), *tokens[at + 1 :]],
        "no head": [*tokens[:at], *tokens[at + 1 :]] if tokens[at] in ("AND", "OR", "NOT", "BOOL") else tokens[:1],
        "an argument too few": [*tokens[: end - 1], *tokens[end:]],
        "an argument too many": [*tokens[:end], "more", *tokens[end:]],
        "a query for an argument": [*tokens[: leaf + 1], "(", "TERM", "a", "b", ")", *tokens[leaf + 2 :]],
        "nothing to join": ["(", r.choice(["AND", "OR", "NOT", "BOOL"]), ")"],
        "two to turn": ["(", "NOT", *tokens, *tokens, ")"],
        "clauses without a kind": ["(", "BOOL", *tokens, ")"] if tokens[1] not in ("NOT",) else [],
        "a range of words": ["(", "RANGE", "size_mm", "low", "9", ")"],
        "a range of fractions": ["(", "RANGE", "size_mm", "0.5", "9", ")"],
        "a range beyond 64 bits": ["(", "RANGE", "size_mm", "0", str(1 << 63), ")"],
        "nothing": [],
    }
    for name, wrong in spoilt.items():
        with pytest.raises(ValueError):
            dsl.from_sexpr(" ".join(wrong))
            pytest.fail(f"{name}: {wrong}")


def without(spec, key):
    return {k: v for k, v in spec.items() if k != key}


@pytest.mark.parametrize("seed", range(40))
def test_spoilt_requests_are_refused(seed):
    r = random.Random(seed)
    spec = as_spec(made(r, 2))
    key = r.choice(sorted(spec))
    inner = {"type": "bool", "clauses": [{"occur": "must", "query": spec}]}
    spoilt = [spec, {}, [spec], {"query": without(spec, key)}, {"query": [spec]}, {"query": {**spec, "type": spec["type"].upper()}}, {"query": {"type": "bool", "clauses": [{"occur": "may", "query": spec}]}}, {"query": {"type": "bool", "clauses": [{"query": spec}]}}]
    spoilt += [{"query": inner, "top_n": n} for n in (-1, 1.5, "3", True)] + [{"query": {"type": "range", "field": "size_mm", "low": low, "high": 1}} for low in ("0", 0.0, None, True, -(1 << 63) - 1)]
    spoilt += [{"query": {"type": kind, "field": "colour", "value": v}} for kind in ("term", "prefix", "wildcard") for v in (1, None, ["red"])] + [{"query": {"type": "term", "field": 1, "value": "red"}}]
    for wrong in spoilt:
        with pytest.raises(ValueError):
            dsl.from_json(json.dumps(wrong))
            pytest.fail(repr(wrong))
    text = json.dumps({"query": spec})
    for cut in (0, 1, len(text) // 2, len(text) - 1):
        with pytest.raises(ValueError):
            dsl.from_json(text[:cut])


def test_query_file():
    lines = ["TERM\tf\tt\t9\n", "AND\thigh\ta\tb", "OR\tlow\ta\tb", "TERMS\tf\ta,b", "PHRASE\tf\ta\tb", "RANGE\tf\t1\t2", "BOOL\tx\t(NOT (TERM f a))", "# nothing", "AND\tx"]
    got = [q for _, q in dsl.from_query_file(lines, "f")]
    assert got == [Term("f", "t"), And("f", ("a", "b")), Or("f", ("a", "b")), Terms("f", ("a", "b")), Phrase("f", ("a", "b")), Range("f", 1, 2), Bool(((N, Term("f", "a")),))]


def test_simplified():
    a, b = Term("f", "a"), Term("f", "b")
    assert simplified(And("f", ("a", "a"))) == a
    assert simplified(Or("f", ())) == MatchNone()
    assert simplified(Phrase("f", ("a",))) == a
    assert simplified(Bool(((M, a), (S, b)))) == a
    assert simplified(Bool(((M, Bool(((M, a), (M, b)))), (M, a)))) == Bool(((M, a), (M, b)))
    assert simplified(Bool(((S, MatchAll()), (S, a)))) == MatchAll()
    assert simplified(Bool(((S, MatchNone()), (N, a)))) == MatchNone()
    assert simplified(Bool(((N, MatchNone()),))) == MatchAll()
    assert simplified(Bool(((M, MatchNone()), (S, a)))) == MatchNone()
