"""Nearest neighbours against brute force: recall, exact scores, ties, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from brindle.llm import ann as A

STRUCT = "vec_id long, embedding array<float>, label int, d int, id long, score double"


def brute(rows, every=20, top=20, kind=np.float32):
    good = []
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.append((i, np.array(v, kind).astype(float)))
    out = {}
    for n, (q, a) in enumerate(good):
        if q % every == 0:
            scored = []
            for m, (i, b) in enumerate(good):
                if m != n and len(a) == len(b):
                    s = 0.0
                    for x, y in zip(a, b, strict=True):
                        s += float(x) * float(y)
                    scored.append((np.inf if np.isnan(s) else -s, i))
            out.setdefault(q, []).append([(i, -s) for s, i in sorted(scored)[:top]])
    return {q: x[0] for q, x in out.items()} if all(len(x) == 1 for x in out.values()) else out


def run(spark, rows, parts=3, struct=STRUCT):
    got = {}
    for r in A.neighbours(spark.createDataFrame(rows, struct).repartition(parts)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [x[k] for k in sorted(x)] for q, x in got.items() if sorted(x) == list(range(1, len(x) + 1))}


@pytest.mark.parametrize("d", [8, 64, 65])
@pytest.mark.parametrize("blocks", [(1 << 20, 32768), (2000, 100)])
def test_recall_and_scores(spark, d, blocks, monkeypatch):
    monkeypatch.setattr(A, "QUERY_BYTES", blocks[0])
    monkeypatch.setattr(A, "CODE_BLOCK", blocks[1])
    rng = np.random.default_rng(d)
    centers = rng.normal(size=(10, d))
    rows = [(i, (centers[i % 10] + 0.7 * rng.normal(size=d)).tolist(), 0, 1, 1, 1.0) for i in range(600)]
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.99
    scores = {(q, i): s for q, x in want.items() for i, s in x}
    assert all(s == scores[q, i] for q, x in got.items() for i, s in x if (q, i) in scores)


def test_ties_and_odd_vectors(spark):
    v = [1.0, 2.0, -1.0]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [-inf, 1.0, 1.0]]
    rows = [(i, v, 0, 0, 0, 0.0) for i in range(0, 300)] + [(1000 + 20 * k, x, 0, 0, 0, 0.0) for k, x in enumerate(odd)]
    rows += [(None, v, 0, 0, 0, 0.0), (2000, [1.0, 1.0], 0, 0, 0, 0.0), (2001, [1.0, -1.0], 0, 0, 0, 0.0), (-20, [-1.0, 0.0, 0.5], 0, 0, 0, 0.0)]
    got, want = run(spark, rows), brute(rows)
    assert got == want and len(got[2000]) == 1 and [i for i, _ in got[0]] == list(range(1, 21))


def test_rows_that_share_an_id(spark):
    v = [1.0, 2.0, -1.0]
    rows = [(20, v, 0, 0, 0, 0.0), (20, v, 0, 0, 0, 0.0), (20, [9.0, 0.0, 1.0], 0, 0, 0, 0.0), (21, v, 0, 0, 0, 0.0), (21, [0.5, 0.5, 0.0], 0, 0, 0, 0.0)]
    got = [tuple(r) for r in A.neighbours(spark.createDataFrame(rows, STRUCT).repartition(2)).collect()]
    want = [(q, k, i, s) for q, lists in brute(rows).items() for found in lists for k, (i, s) in enumerate(found, 1)]
    assert sorted(got) == sorted(want) and len(got) == 12


@pytest.mark.parametrize("low,high", [(1e20, 1e20), (1e38, 1e38), (1e-20, 1e-20), (1e-30, 1e30), (1e39, 1e39), (1e-170, 1e-170), (1e-300, 1e150), (1e300, 1e300)])
def test_any_finite_scale(spark, low, high):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16))
    scale = np.exp(rng.uniform(np.log(low), np.log(high), (300, 1)))
    kind = np.float32 if 1e-38 < low and high < 1e38 else np.float64
    struct = STRUCT if kind is np.float32 else STRUCT.replace("array<float>", "array<double>")
    rows = [(i, x.tolist(), 0, 1, 1, 1.0) for i, x in enumerate(v * scale)]
    with np.errstate(over="ignore", invalid="ignore"):
        got, want = run(spark, rows, struct=struct), brute(rows, kind=kind)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.99


def test_most_codes_are_never_reranked():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(20_000, 256))
    v[:4000] += 3 * rng.normal(size=256)
    queries = A.Queries(np.arange(20), np.arange(20), v[:20], 20)
    reranked = sum(queries.search(np.arange(a, a + 4000), np.arange(a, a + 4000), v[a : a + 4000], *A.codes(v[a : a + 4000])) for a in range(0, 20_000, 4000))
    assert reranked < 20 * 4000
    scores = v[:20] @ v.T
    scores[np.arange(20), np.arange(20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(want.tolist(), queries.best_ids.tolist(), strict=True)]) > 0.99


def test_few_or_none(spark):
    assert run(spark, [(20, [1.0], 0, 0, 0, 0.0)]) == {}
    assert run(spark, [(20, [1.0], 0, 0, 0, 0.0), (21, [2.0], 0, 0, 0, 0.0)]) == {20: [(21, 2.0)]}
    assert A.neighbours(spark.createDataFrame([], STRUCT)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 64)) * rng.uniform(0.1, 10, (2000, 1))
    q = rng.normal(size=64)
    bits, norms, cosines = A.codes(v)
    asked = A.Queries(np.array([0]), np.array([0]), q[None, :], 20)
    packed = np.ascontiguousarray(bits.view(np.uint64).T)
    near = (2 * asked.low[0] * np.bitwise_count(packed).sum(axis=0, dtype=int) + 2 * asked.step[0] * asked.counts(0, packed) - (64 * asked.low[0] + asked.step[0] * asked.sums[0])) / 8
    guess = near * norms / cosines * np.linalg.norm(q)
    plain = ((np.unpackbits(bits, axis=1) * 2.0 - 1) / 8) @ (q @ A.rotation(64)) * norms / cosines
    assert np.abs(guess - plain).max() < 0.1 * np.abs(plain).max() and asked.lost[0] < 0.2
    width = norms * np.sqrt(1 - cosines**2) / cosines / np.sqrt(63) * A.EPSILON * np.linalg.norm(q)
    assert np.mean(np.abs(guess - v @ q) <= width) > 0.99 and abs(np.mean((guess - v @ q) / width)) < 0.05
    assert np.allclose(A.rotation(64) @ A.rotation(64).T, np.eye(64))
