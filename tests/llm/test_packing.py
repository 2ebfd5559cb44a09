"""Packing is an exact round trip of the tokenizers' ids without padding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from small_docs import STRUCT, row

from brindle.llm import packing as K


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(K.vocabulary())


def check(rows, pieces, tokenizer):
    want = sorted([repr(r[0]), *tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows)
    sequences, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids.tolist()))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    if len({(r[0]) for r in rows}) == len(rows):
        got = []
        for (doc_id, n), parts in by_doc.items():
            ids = [x for start, part in sorted(parts) for x in part]
            assert [s for s, _ in sorted(parts)] == np.cumsum([0, *(len(p) for _, p in sorted(parts))])[:-1].tolist() and len(ids) == n
            got.append([repr(doc_id), *ids])
        assert sorted(got) == want
    assert sum(p.length for p in pieces) == sum(len(w) - 1 for w in want)


def test_round_trip(spark, corpus, tokenizer):
    seen, rows = set(), []
    for r in corpus:
        if r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    rows.append(row(400, "before <|endoftext|> after"))
    df = spark.createDataFrame(rows, STRUCT)
    for parts in (1, 5):
        pieces = K.pack(df.repartition(parts), with_ids=True).collect()
        check(rows, pieces, tokenizer)


def test_repeated_rows_and_nothing(docs, corpus, no_docs, tokenizer):
    check(corpus, K.pack(docs, with_ids=True).collect(), tokenizer)
    assert K.pack(no_docs).count() == 0
    assert K.pack(docs).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_one_small_document(spark, tokenizer):
    rows = [row(7, "a few words only", source=None)]
    check(rows, K.pack(spark.createDataFrame(rows, STRUCT), with_ids=True).collect(), tokenizer)


@pytest.mark.parametrize("run", [" ", "\n", "\r\n", "\u00a0", " \t", "a", "7", "!", "\u4e2d"])
def test_runs_of_any_length(tokenizer, run):
    text = "before " + run * (1_200_000 // len(run)) + "after it"
    assert K.encoder(K.vocabulary())(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_of_long_runs(spark, tokenizer):
    rows = [row(1, " " * 1_000_000), row(2, "\n" * 1_500_000 + "x"), row(3, "a few words")]
    check(rows, K.pack(spark.createDataFrame(rows, STRUCT), with_ids=True).collect(), tokenizer)


def test_open_windows_are_bounded():
    r = random.Random(0)
    packer, total = K.Packer(0, False), 0
    for i in range(3000):
        n = r.choice([1, 5, 100, 700, 1023, 1024, 1025, 5000])
        packer.add(i, np.zeros(n, "<u4"))
        total += n
        assert len(packer.windows) <= K.OPEN and all(0 < w[0] < 1024 for w in packer.windows)
    packer.close()
    assert sum(x[2] for x in packer.rows) == total
    left = [x for x in packer.rows if x[5] is None]
    assert sum(x[2] for x in left) < 1024


def test_powers_of_two():
    pieces = [(1, 0, np.arange(300, dtype="<u4"), 300), (2, 5, np.arange(77, dtype="<u4"), 90)]
    got = list(K.unpadded(pieces))
    assert [sum(len(p[2]) for p in w) for w in got] == [256, 64, 32, 16, 8, 1]
    assert np.concatenate([p[2] for w in got for p in w]).tolist() == [*range(300), *range(77)]
