"""Mixing against the definition, step by step in Python, and against SQL."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from small_docs import STRUCT, row

from brindle.llm import mixing as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Excess over twice a source's size goes to the others by weight, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, out, open_ = 1.5 * sum(sizes.values()), {}, list(order)
    while open_:
        left, w = goal - sum(out.values()), sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 2 * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    return out


def check(rows, got):
    sizes = {}
    for _, text, _, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    goal = targets(sizes)
    source_of = {(r[0], len(WORD.findall(r[1] or ""))): r[3] for r in rows}
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        s = source_of[(r.doc_id, r.size)]
        taken.setdefault(s, []).append(r.taken)
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * (1 + goal[s]) and 0 <= r.taken <= 2 * r.size
    for s, n in taken.items():
        assert abs(sum(n) - goal[s]) <= 3.5  # rows with one id and size share what is left, rounded down


def test_definition(docs, corpus):
    got = X.taken(docs).collect()
    check(corpus, got)
    again = X.taken(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("rows_per_range", [3, 1024])
def test_hot_sources(spark, seed, rows_per_range, monkeypatch):
    monkeypatch.setattr(X, "ROWS_PER_RANGE", rows_per_range)
    r = random.Random(seed)
    rows = [row(i, "w " * r.randint(0, 30), source=r.choice(["hot"] * 6 + ["ä", "b", "Z", None, "𐀀", "\uffff"])) for i in range(150)]
    check(rows, X.taken(spark.createDataFrame(rows, STRUCT)).collect())


def test_many_sources_take_the_salted_way(spark, monkeypatch):
    rows = [row(i, "w " * (i % 7), source=None if i % 9 == 0 else f"s{i % 5}") for i in range(80)]
    df = spark.createDataFrame(rows, STRUCT)
    one = sorted(map(repr, X.taken(df).collect()))
    monkeypatch.setattr(X, "BROADCAST_SOURCES", 2)
    assert sorted(map(repr, X.taken(df).collect())) == one


def test_against_sql(spark, docs, corpus, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    r = con.execute(X.oracle())
    names = [c[0] for c in r.description]
    want = sorted(repr(tuple(x)) for x in r.fetchall())
    got = sorted(repr(tuple(x[n] for n in names)) for x in X.taken(docs).collect())
    assert got == want


def test_nothing(no_docs, spark):
    assert X.taken(no_docs).count() == 0 and X.mix(no_docs).count() == 0
    empty = spark.createDataFrame([row(1, None), row(2, "", source="b")], STRUCT)
    assert {(r.target, r.taken) for r in X.taken(empty).collect()} == {(0.0, 0)}


def test_mixed_texts_are_what_is_taken(docs, corpus):
    plan = {}
    for r in X.taken(docs).collect():
        plan.setdefault(r.doc_id, []).append(r.taken)
    mixed = X.mix(docs)
    assert mixed.columns == docs.columns
    words, texts = {}, {x[0]: WORD.findall(x[1] or "") for x in corpus}
    for r in mixed.collect():
        got = WORD.findall(r.text or "")
        assert got == texts[r.doc_id][: len(got)]
        words[r.doc_id] = words.get(r.doc_id, 0) + len(got)
    assert {k: v for k, v in words.items() if v} == {k: sum(v) for k, v in plan.items() if sum(v)}
