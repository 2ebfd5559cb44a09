"""The pipeline's stages, each against its own input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from small_docs import row, sentence
from test_classifiers import gram
from test_join import sets_of
from test_mixing import targets
from test_secrets import brute as plain_secrets

import corpus_pipeline as P
from brindle.llm import packing, secrets, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    from small_docs import STRUCT

    r, rows, labels = random.Random(11), [], []
    for i in range(400):
        words = sentence(r, ["en", "fr"][i % 2], r.randint(30, 90)).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), "zwumpfig")
        if i % 7 == 0:
            words.insert(5, "password=abcdef%d" % i)
        rows.append(row(i, " ".join(words), source=f"s{i % 3}"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [row(500 + k, rows[k][1] + " end") for k in range(1, 4)] + [row(600, None), row(601, ""), row(602, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, STRUCT).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = [docs]
    for name, stage in P.STAGES:
        steps.append(P.common.staged(stage(spark, steps[-1], tables), name.replace(" ", "-")))
    assert [s.columns for s in steps[1:-1]] == [docs.columns] * 4 and len(P.STAGES) == 5
    start, clean, single, safe, mixed = ([r.asDict() for r in s.collect()] for s in steps[:5])
    toxic = {r["doc_id"] for r in start if r["text"] and "zwumpfig" in r["text"]}
    left = {r["doc_id"] for r in clean}
    assert len(toxic & left) <= 4 and len({r["doc_id"] for r in start} - toxic - left) <= 4
    assert not {501, 502, 503} & {r["doc_id"] for r in single} and {600, 601, 602} <= {r["doc_id"] for r in single}
    assert len(single) == len(clean) - len({501, 502, 503} & left)
    assert {r["doc_id"] for r in safe} == {r["doc_id"] for r in single}
    assert not any("password=abc" in (r["text"] or "") for r in safe) and any(secrets.MARK in (r["text"] or "") for r in safe)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in safe + mixed)
    words = sum(len((r["text"] or "").split()) for r in safe)
    assert abs(sum(len((r["text"] or "").split()) for r in mixed) - 1.5 * words) < 10
    pieces = steps[5].collect()
    assert len({r.sequence_id for r in pieces}) <= sum(p.length for p in pieces) / 1024 + 20


def brute_mixed(rows, weights, bias):
    """All documents that reach packing, a row for each time one is taken: plain versions of the first four stages."""
    left = []
    for r in rows:
        text = f" {(r.text or '').lower()} "
        grams = {gram(text[i : i + n], toxicity.BITS) for n in toxicity.GRAMS for i in range(len(text) - n + 1)}
        if 1 / (1 + math.exp(-sum(float(weights[g]) for g in grams) - bias)) < toxicity.THRESHOLD:
            left.append(r)
    sets, root = [sets_of(r.text) for r in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    single = [r for k, r in enumerate(left) if not any(root[j] == root[k] and left[j].doc_id < r.doc_id for j in range(len(left)))]
    safe = []
    for r in single:
        text = r.text
        for start, _, end in reversed(plain_secrets(text or "")):
            text = text[:start] + secrets.MARK + text[end:]
        safe.append((r.doc_id, text, r.source, len(words_of(text))))
    sizes = {}
    for *_, source, n in safe:
        sizes[source] = sizes.get(source, 0) + n
    goal, out = targets(sizes), []
    for source, size in sizes.items():
        if not size:
            continue
        times, rest = divmod(math.floor(goal[source] + 0.5), size)
        for doc_id, text, _, n in sorted((d for d in safe if d[2] == source), key=lambda d: hashlib.md5(f"{d[0]}:{d[3]}".encode()).hexdigest()[:12]):
            out += [(doc_id, text)] * times
            if rest > 0:
                out.append((doc_id, text if n <= rest else " ".join(words_of(text)[:rest])))
            rest -= n
    return out


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_run_against_brute_force(spark, tables):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    mixed = brute_mixed(docs.collect(), *toxicity.learn(docs, labels))
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    copies = {}
    for doc_id, text in mixed:
        ids = (*tokenizer.encode(text, add_special_tokens=False).ids, 0)
        copies.setdefault((doc_id, len(ids)), []).append(ids)
    covered, sequences = {}, {}
    for p in P.run(spark, tables).collect():
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        found = copies[p.doc_id, p.doc_tokens]
        assert any(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in found)
        covered.setdefault((p.doc_id, p.doc_tokens), Counter()).update(range(p.start, p.start + p.length))
    assert set(covered) == set(copies)
    assert all(covered[k] == {at: len(found) for at in range(k[1])} for k, found in copies.items())
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_run_gives_the_last_stage(spark, tables):
    out = P.run(spark, tables)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert P.run(spark, tables).agg({"length": "sum"}).first() == out.agg({"length": "sum"}).first()


def test_empty_tables(spark, tmp_path):
    from small_docs import STRUCT

    spark.createDataFrame([], STRUCT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    assert toxicity.THRESHOLD == 0.7
