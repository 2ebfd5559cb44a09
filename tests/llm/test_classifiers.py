"""Language, quality and toxicity: held-out accuracy, defined cases, and that labels of held-out rows play no part."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from small_docs import row, sentence

from brindle.llm import common as C
from brindle.llm import langid, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, score double"


def rest(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad, rude = i % 3 == 0, i % 4 == 0
        lang = ["en", "fr", "de"][i % 5 % 3]
        words = sentence(r, lang, r.randint(30, 90)).split()
        if bad:
            words = [w.upper() + "!!" for w in words]
        if rude:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zwumpf", "grobkol"]))
        rows.append(row(i, " ".join(words), lang))
        labels.append((i, int(not bad), int(rude), 1.0))
    labels += [(None, 1, 1, None), (5000, None, None, None), (600, 1, 0, 0.0), (0, None, None, 0.0), (1, 1, 0, 1.0)]
    from small_docs import STRUCT

    return spark.createDataFrame(rows, STRUCT).cache(), spark.createDataFrame(labels, LABELS).cache(), {x[0]: x for x in labels[:600]}


@pytest.mark.parametrize("run,held,label,threshold", [(quality.quality_scores, (5, 0), 1, 0.3), (toxicity.toxicity_scores, (3, 1), 2, 0.7)])
def test_held_out_accuracy(labelled, run, held, label, threshold):
    docs, labels, truth = labelled
    got = run(docs, labels).collect()
    assert len(got) == 600 and all(r.held_out == (rest(r.doc_id, held[0]) == held[1]) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    right = np.mean([r.predicted == truth[r.doc_id][label] for r in got if r.held_out])
    assert right > 0.95


@pytest.mark.parametrize("run,held,name", [(quality.quality_scores, (5, 0), "quality"), (toxicity.toxicity_scores, (3, 1), "toxic")])
def test_held_out_labels_play_no_part(spark, labelled, run, held, name):
    docs, labels, _ = labelled
    turned = spark.createDataFrame([tuple(1 - v if k == name and v is not None and rest(r.doc_id, held[0]) == held[1] else v for k, v in r.asDict().items()) for r in labels.collect()], LABELS)
    one, two = (sorted(tuple(r) for r in run(docs.limit(50), x).collect()) for x in (labels, turned))
    assert one == two


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows(spark, docs, no_docs, corpus, labelled, run):
    _, labels, _ = labelled
    got = run(docs, labels).collect()
    assert len(got) == len(corpus) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[300][0].score == by[301][0].score and len(by[5]) == 3 and len({r.score for r in by[5]}) == 1
    assert by[None][0].held_out is False
    assert run(no_docs, labels).count() == 0
    assert {r.predicted for r in run(docs, labels.where("false")).collect()} <= {0, 1}


def test_toxic_documents_go_and_columns_stay(spark, labelled, no_docs):
    docs, labels, truth = labelled
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i, x in truth.items() if x[2] and i in ids]) < 8 and len([i for i, x in truth.items() if not x[2] and i not in ids]) < 8
    assert toxicity.drop_toxic(no_docs, labels).count() == 0


def spread(h, bits):
    h ^= h >> 15
    h = h * 0x2C1B3C6D % (1 << 32)
    h ^= h >> 12
    return (h * 0x297A2D39 % (1 << 32)) >> (32 - bits)


def gram(chars, bits):
    h = 0x9E3779B1 * len(chars) % (1 << 32)
    for c in chars:
        h = h * 0x01000193 % (1 << 32) ^ ord(c)
    return spread(h, bits)


def plain_subwords(text):
    out, last = [], None
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        marked = f" {word} "
        for n in quality.GRAMS:
            out += [gram(marked[i : i + n], quality.BITS) for i in range(len(marked) - n + 1) if n != len(marked)]
        h = sum((ord(c) + 7) * 0x811C9DC5 * pow(0x01000193, k, 1 << 32) for k, c in enumerate(word)) % (1 << 32)
        out.append(spread(h, quality.BITS))
        if last is not None:
            out.append(spread(last ^ h ^ 0x9E3779B1, quality.BITS))
        last = h
    return Counter(out)


ODD = ["", " ", "a", " a", "a ", "ab\x0bab  ab", "x" * 40 + " y", "é😀 \x1cx y", "word word\nword\tother", "a b c d e f g"]


@pytest.mark.parametrize("chunk", [1 << 18, 1, 2, 7])
def test_subwords_by_a_plain_reading(monkeypatch, chunk):
    monkeypatch.setattr(quality, "_CHUNK", chunk)
    for text in [*ODD, None, sentence(random.Random(7), "de", 60)]:
        ids, n = quality.counts(text)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == dict(plain_subwords(text)), text


def test_quality_scores_by_a_plain_reading(labelled):
    docs, labels, _ = labelled
    slots, bias = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for r in docs.limit(40).collect():
        bag = plain_subwords(r.text)
        mean = sum(float(slots[i]) * n for i, n in bag.items()) / sum(bag.values())
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-mean - bias)), abs=1e-5)
    assert np.count_nonzero(slots) > 100


def test_toxicity_scores_by_a_plain_reading(labelled):
    docs, labels, _ = labelled
    weights, bias = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    for r in docs.limit(40).collect():
        text = f" {r.text.lower()} "
        grams = {gram(text[i : i + n], toxicity.BITS) for n in toxicity.GRAMS for i in range(len(text) - n + 1)}
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-sum(float(weights[g]) for g in grams) - bias)), abs=1e-5)


def test_ratios_of_both_signs_have_weights():
    r = random.Random(5)
    texts = [sentence(r, "fr", 40) + " rudeword" for _ in range(60)] + [sentence(r, "fr", 40) + " politely" for _ in range(60)]
    sets, y = list(toxicity.all_features(texts)), np.array([1] * 60 + [0] * 60)
    weights, _ = toxicity.train(sets, y)
    toxic, other = (np.bincount(np.concatenate(sets[a : a + 60]), minlength=1 << toxicity.BITS) + 1 for a in (0, 60))
    ratio = np.log(toxic / 62) - np.log(other / 62)
    sure = (toxic + other >= 7) & (np.abs(ratio) >= 2 * np.sqrt(1 / toxic + 1 / other))
    assert (weights[~sure] == 0).all() and (weights > 0).any() and (weights < 0).any()
    assert weights[gram("rudew", toxicity.BITS)] > 0 > weights[gram("polit", toxicity.BITS)]


def test_near_copies_in_the_sample_count_once():
    r = random.Random(8)
    base = [sentence(r, lang, 200) for lang in ("en", "fr", "de", "en")]
    texts = [base[0], base[1], base[0] + " end", base[2], base[0], " ".join(base[1].split()[:-5]), base[3], "", ""]
    sets = list(toxicity.all_features(texts))
    assert toxicity.unlike(sets).tolist() == [0, 1, 3, 6, 7]
    assert toxicity.unlike([]).tolist() == []


def test_languages_by_a_plain_reading(docs, corpus):
    net = langid.learn(docs)
    texts = [x[1] for x in corpus[:25]] + ["x", "é" * 100, "Ab 12 " * 40]
    got = langid.predict(texts, net)
    size = langid.FILTERS
    for k, text in enumerate(texts):
        raw = text.encode()
        raw += b" " * (-len(raw) % langid.WINDOW)
        total = np.zeros(len(net.languages))
        for at in range(0, len(raw), langid.WINDOW):
            codes = [int(langid.CLASS[b]) for b in raw[at : at + langid.WINDOW]]
            hidden = []
            for w, filters in zip(langid.WIDTHS, net.filters, strict=True):
                for f in range(size):
                    hidden.append(max(sum(float(filters[j][codes[p + j]][f]) for j in range(w)) for p in range(langid.WINDOW - 3)))
            z = np.maximum(np.array(hidden) + net.offsets, 0) @ net.out + net.bias
            e = np.exp(z - z.max())
            total += e / e.sum()
        total /= len(raw) // langid.WINDOW
        assert got[0][k] == net.languages[int(total.argmax())] and got[1][k] == pytest.approx(total.max(), abs=1e-4)


def test_no_language_is_too_rare(spark):
    rows = [row(i, f"{'abcdefghij'[i % 10] * 4} {'klmnopqrst'[i // 10 % 10] * 4} " * 8, f"l{i % 300:03d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, label int, rk long, size long, id long")
    assert len(langid.learn(df, per_class=2).languages) == 300
    many, most = C.class_sample(df.select("doc_id", "lang"), "doc_id", "lang", 400, 1, most=600)
    assert many.select("lang").distinct().count() == 300 and most == 4 * 16 * 300


def test_chunks_change_nothing(monkeypatch):
    text = sentence(random.Random(3), "fr", 3000)
    whole = set(next(toxicity.all_features([text])).tolist())
    bags = quality.counts(text)
    monkeypatch.setattr(toxicity, "_CHUNK", 500)
    monkeypatch.setattr(quality, "_CHUNK", 500)
    assert set(next(toxicity.all_features([text])).tolist()) == whole
    again = quality.counts(text)
    assert (again[0] == bags[0]).all() and (again[1] == bags[1]).all()


def test_quality_slots_are_folded_exactly():
    r = random.Random(4)
    texts = [sentence(r, "en", 40) for _ in range(20)] + [sentence(r, "en", 40).upper() for _ in range(20)]
    slots, bias = quality.train([quality.counts(t) for t in texts], np.array([1] * 20 + [0] * 20))
    got = quality.score([*texts, "", None], slots, bias)
    for t, s in zip(texts, got, strict=False):
        ids, n = quality.counts(t)
        assert abs(s - 1 / (1 + np.exp(-((slots[ids] * n).sum() / n.sum() + bias)))) < 1e-6
    assert got[-1] == got[-2] and (got[:20] > 0.5).all() and (got[20:40] < 0.5).all()


def test_languages(spark, docs, no_docs, corpus):
    got = langid.predictions(docs).collect()
    assert len(got) == len(corpus)
    truth = {x[0]: x[2] for x in corpus}
    sure = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == (rest(r.doc_id, 4) == 2) for r in sure)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in sure if r.held_out]) > 0.97
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {300, 301, 302, 303} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predictions(no_docs).count() == 0


def test_no_labels_no_language(docs):
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in langid.predictions(docs.limit(9).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.predictions(docs.where("doc_id < 20").withColumn("lang", F.lit("xx"))).collect()} == {"xx"}


def test_pair_tables_are_the_convolution():
    rng = np.random.default_rng(0)
    net = langid.train(rng.integers(0, langid.N_CLASSES, (64, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 64), ["a", "b"], epochs=1)
    x = rng.integers(0, langid.N_CLASSES, (5, langid.WINDOW)).astype(np.uint8)
    n = langid.WINDOW - 3
    tops = []
    for w, f in zip(langid.WIDTHS, net.filters, strict=True):
        tops.append(sum(f[k][x[:, k : k + n]] for k in range(w)).max(axis=1))
    z = np.maximum(np.concatenate(tops, axis=1) + net.offsets, 0) @ net.out + net.bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x, net.tables()), z / z.sum(axis=1, keepdims=True), atol=1e-5)
