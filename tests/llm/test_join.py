"""The similarity join against all pairs, on texts with copies, near copies and shared passages."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from small_docs import STRUCT, row, sentence

from brindle.llm import groups, join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Number of links and least id of the class, for each row in order."""
    sets, root, links = [sets_of(r[1]) for r in rows], list(range(len(rows))), [0] * len(rows)
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    return sorted(((repr(r[0]), repr(least.get(find(k))), links[k]) for k, r in enumerate(rows)))


def near(r, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = r.choice(["changed", "other", "new"])
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(corpus):
    r = random.Random(9)
    rows, passage = [x for x in corpus if x[0] is None or x[0] < 60 or x[0] >= 300], sentence(r, "en", 60)
    for k in range(12):
        text = sentence(r, "en", 150)
        rows += [row(1000 + 100 * k + j, near(r, text, r.randint(0, 7))) for j in range(8)]
    rows += [row(3000 + j, passage + "\n" + sentence(r, "de", r.randint(10, 60))) for j in range(40)]
    rows += [row(4000 + j, near(r, rows[-1][1], 1)) for j in range(30)] + [row(5000 + j, "short text") for j in range(3)]
    return rows


@pytest.mark.parametrize("blocks", [(1024, 384, 512), (5, 4, 3)])
def test_all_links(spark, copies, blocks, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(J, "TEXT_BLOCK", blocks[1])
    monkeypatch.setattr(groups, "SPLIT", blocks[2])
    got = J.jaccard_classes(spark.createDataFrame(copies, STRUCT).repartition(4)).collect()
    assert sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in got) == brute(copies)


def test_chains_are_compared_in_buckets(spark, monkeypatch):
    """Each text is a shift of the one before: neighbours are linked, the ends of a chain have nothing in common."""
    monkeypatch.setattr(J, "TEXT_BLOCK", 16)
    r = random.Random(4)
    words = sentence(r, "en", 1500).split()
    rows = [row(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(300)] + [row(900 + i, sentence(r, "fr", 100)) for i in range(20)]
    df = spark.createDataFrame(rows, STRUCT)
    parts, compared = [], J.compared

    def watched(*given):
        out = compared(*given)
        parts.append(out.groupBy("part").count().collect())
        return out

    monkeypatch.setattr(J, "compared", watched)
    got = J.jaccard_classes(df).collect()
    want = brute(rows)
    assert {r.part for r in parts[0]} >= {1}
    assert sorted((repr(x.doc_id), repr(x.class_id), x.n_links) for x in got) == want and max(n for *_, n in want) == 6


def test_clashing_names_and_equal_rows(spark):
    rows = [(1, "some words that are equal in all", k, f"x{k}") for k in range(5)] + [(2, "some words that are equal in all", 9, "y"), (3, None, 1, "z"), (3, None, 2, "z")]
    kept = [[tuple(r) for r in J.first_of_each_class(spark.createDataFrame(x, "doc_id long, text string, _rk int, `a.b` string").repartition(n)).collect()] for x, n in ((rows, 1), (rows[::-1], 3))]
    assert sorted(kept[0], key=repr) == sorted(kept[1], key=repr) and len(kept[0]) == 3
    assert {r[0] for r in kept[0]} == {1, 3} and next(r for r in kept[0] if r[0] == 1) in rows


def test_hot_keys_are_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(groups, "SPLIT", 10)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(500)], "a long, x long")
    table = rows.groupBy("a").agg(F.max("x").alias("m"), F.count("*").alias("_n"))
    for limit in (10, 60, 1000):
        monkeypatch.setattr(groups, "SPLIT", limit)
        got = sorted(tuple(r) for r in groups.spread_join(rows, table, ["a"]).select("a", "x", "m").collect())
        assert got == sorted(tuple(r) for r in rows.join(table, "a").select("a", "x", "m").collect()) and len(got) == 500


def test_one_document_of_each_class_stays(spark, copies, no_docs):
    df = spark.createDataFrame(copies, STRUCT)
    kept = J.first_of_each_class(df)
    assert kept.columns == df.columns
    want, singles = set(), 0
    for doc_id, least, links in brute(copies):
        singles += not links and least == "None"
        want.add(least)
    ids = [repr(r.doc_id) for r in kept.collect()]
    assert set(ids) - {"None"} == want - {"None"}
    assert len([i for i in ids if i != "None"]) - len(set(ids) - {"None"}) == 1  # the text that is null twice, under one id: no words, no link
    assert J.first_of_each_class(no_docs).count() == 0 and J.jaccard_classes(no_docs).count() == 0


def test_keys_beyond_the_broadcast_bound(spark, copies, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_KEYS", 0)
    df = spark.createDataFrame(copies, STRUCT)
    got = J.jaccard_classes(df).collect()
    assert sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in got) == brute(copies)
    assert J.first_of_each_class(df).count() == len({x[1] for x in brute(copies)} - {"None"}) + 2


def test_pruning_keeps_similar_pairs():
    least = J.least_matches()
    assert least == sorted(least) and len(least) == 6
    rng = np.random.default_rng(0)
    kept = {0.85: 0, 0.2: 0}
    for s in kept:
        for _ in range(300):
            union = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(400 * s)
            a, b = np.concatenate([union[:n], union[n::2]]), np.concatenate([union[:n], union[n + 1 :: 2]])
            x, y = (J.signature(J.minima(v))[None] for v in (a, b))
            kept[s] += len(J.survivors(x, y, least, False)[0])
    assert kept[0.85] == 300 and kept[0.2] == 0


def test_links_at_the_threshold():
    base = np.arange(1, 101, dtype=np.uint64)
    other = np.concatenate([base[:80], base[:0]])
    assert J.links([base, other], 0)[0].tolist() == [0]
    assert not len(J.links([base, base[:79]], 0)[0])
    assert J.links([base, other, base], 1)[1].tolist() == [1, 2]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {r.node: r.root for r in groups.components(df).collect()} == {x: find(x) for x in root}
    assert groups.components(df.where("false")).count() == 0
