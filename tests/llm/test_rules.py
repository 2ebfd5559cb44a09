"""Quality rules: base counts by a plain reading, the smoothed model against a dictionary version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from small_docs import STRUCT, row, sentence
from hypothesis import given, settings
from pyspark.sql import functions as F
from hypothesis import strategies as st

from brindle.llm import rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, places, inside = WORD.findall(text), {}, set()
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            for i in at:
                inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#$", " ", "\n", "\x0b", "\x1c", " ", " ", "a b a b a b a b", "\r\n", "😀|"])).map("".join))
def test_base_counts(text):
    assert R.base_counts(text) == brute(text)


def test_long_base_counts(corpus):
    for _, text, *_ in corpus:
        assert R.base_counts(text) == brute(text)


def kneser_ney(texts, order):
    """Probabilities of the highest order, by dictionaries."""
    grams = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = {}
    for k, c in grams.items():
        n = Counter(c.values())
        d[k] = (0.0, *R.discounts(n[1], n[2], n[3], n[4]))
    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(grams[1]) + 1)
        after = {x: c for x, c in grams[k].items() if x[:-1] == g[:-1]}
        total = sum(after.values())
        gamma = sum(d[k][min(c, 3)] for c in after.values()) / total
        return (grams[k][g] - d[k][min(grams[k][g], 3)]) / total + gamma * p(g[1:])
    return {g: p(g) for g in grams[order]}, grams


def test_model_is_modified_kneser_ney(spark):
    r = random.Random(5)
    texts = {"en": [sentence(r, "en", 30) for _ in range(6)], "": [sentence(r, "fr", 20)]}
    df = spark.createDataFrame([(lang, t) for lang, ts in texts.items() for t in ts], "lang string, text string").repartition(3)
    model = R.fit(df)
    for lang, ts in texts.items():
        p, _ = kneser_ney(ts, R.ORDER)
        for t in ts:
            codes = np.concatenate(list(R.gram_codes(t)))
            got = model.log_probabilities(lang, codes)
            want = [math.log(p[t[i : i + R.ORDER]]) for i in range(len(t) - R.ORDER + 1)]
            assert np.abs(got - want).max() < 1e-4
    unseen = model.log_probabilities("en", np.concatenate(list(R.gram_codes("qqqq zzzz thqq"))))
    assert np.isfinite(unseen).all() and (unseen < 0).all()


def test_chunks_change_nothing(monkeypatch):
    text = sentence(random.Random(6), "de", 500)
    whole = np.concatenate(list(R.gram_codes(text)))
    monkeypatch.setattr(R, "_CHUNK", 100)
    assert (np.concatenate(list(R.gram_codes(text))) == whole).all()


def test_table(spark, docs, no_docs, corpus):
    got = R.judged(docs).collect()
    assert len(got) == len(corpus)
    texts = {x[0]: x[1] for x in corpus}
    for r in got:
        counts = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0]) and not (r.base_failed and r.kept)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 300)
    assert R.judged(no_docs).count() == 0


def test_bands_reject_odd_texts(spark):
    r = random.Random(7)
    rows = [row(i, sentence(r, "en", 80)) for i in range(200)]
    odd = "".join(chr(r.randint(0x4E00, 0x9000)) + (" " if k % 5 == 0 else "") for k in range(400))
    got = {x.doc_id: x for x in R.judged(spark.createDataFrame([*rows, row(900, odd)], STRUCT)).collect()}
    assert not got[900].base_failed and not got[900].kept and all(got[i].kept for i in range(200))


def test_loads_and_pieces_change_nothing(spark, docs):
    def rows(most):
        got = R.judged(docs, most=most).collect()
        return sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, None if r.perplexity is None else round(r.perplexity, 3)) for r in got)

    whole = rows(R.MOST_ENTRIES)
    texts = docs.select(F.lit("en").alias("lang"), "text")
    model = R.counted_model(texts)
    parts = R.loads(model, 400)
    assert len(parts) > 3 and [p for x in parts for p in x["en"][1]] == list(range(len(parts)))
    complete, loaded = R.fit(texts), [R.load(model, x) for x in parts]
    codes = np.concatenate([*R.gram_codes("some thing unseen Qx%7"), complete.tables["en", R.ORDER][0]])
    assert sum(len(m.own("en", codes)) for m in loaded) == len(codes)
    for m in loaded:
        mine = m.own("en", codes)
        assert len(mine) and (m.log_probabilities("en", mine) == complete.log_probabilities("en", mine)).all()
        assert max(len(k) for (_, kind), (k, _) in m.tables.items() if kind in (3, 4, -2, -3)) < 1500
    assert rows(2000) == whole and rows(500) == whole


def test_discounts_as_columns(spark):
    cases = [(0, 0, 0, 0), (5, 0, 0, 0), (10, 4, 2, 1), (3, 9, 1, 0), (1, 1, 50, 2), (0, 3, 2, 1)]
    got = spark.createDataFrame(cases, "n1 long, n2 long, n3 long, n4 long").select("n1", "n2", "n3", "n4", *R.discount_columns()).collect()
    for row_ in got:
        assert np.allclose(row_[4:], R.discounts(*row_[:4]))


def test_no_gram_is_lost_or_taken_for_another(spark):
    r = random.Random(8)
    text = "".join(chr(r.choice([r.randint(0x61, 0x7A), r.randint(0x4E00, 0x9000), r.randint(0x1F300, 0x1F5FF)])) for _ in range(30_000))
    model = R.fit(spark.createDataFrame([("zh", text), ("en", text[::-1])], "lang string, text string"))
    for lang, t in (("zh", text), ("en", text[::-1])):
        codes = np.unique(np.concatenate(list(R.gram_codes(t))))
        assert (model.tables[lang, R.ORDER][0] == codes).all()
    units = text.encode("utf-16-le")
    assert len(model.tables["zh", R.ORDER][0]) == len({units[i : i + 8] for i in range(0, len(units) - 7, 2)})
    absent = np.concatenate(list(R.gram_codes("".join(chr(r.randint(0x400, 0x4FF)) for _ in range(50_000)))))
    assert np.isnan(model.look("zh", R.ORDER, absent)).all()
    assert not (np.concatenate(list(R.gram_codes("aabc"))) == np.concatenate(list(R.gram_codes("aၡbc")))).any()


def test_symbols_at_every_word_are_rejected_though_common(spark):
    r = random.Random(10)
    marked = lambda n: " ".join(w + r.choice(["***", "%%%", "&&&", "$$$", "###"]) for w in sentence(r, "en", n).split())
    rows = [row(i, sentence(r, "en", r.randint(60, 140))) for i in range(400)] + [row(1000 + i, marked(r.randint(60, 140))) for i in range(40)]
    got = {x.doc_id: x for x in R.judged(spark.createDataFrame(rows, STRUCT)).collect()}
    assert [i for i, x in got.items() if i >= 1000 and x.kept] == [] and sum(not got[i].kept for i in range(400)) <= 2
    assert all(x.word_perplexity > x.perplexity for x in got.values())


def test_bands_reject_junk_of_any_length(spark):
    r = random.Random(9)
    rows = [row(i, sentence(r, ["en", "fr"][i % 2], r.randint(60, 140)), ["en", "fr"][i % 2]) for i in range(400)]
    letters = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(n))
    junk = [row(1000, letters(150)), row(1001, letters(15)), row(1002, sentence(r, "en", 100), "fr"), row(1003, sentence(r, "fr", 15), "en")]
    junk.append(row(1004, " ".join(w + r.choice(["%%%", "&&&", "$$$"]) for w in sentence(r, "en", 100).split())))
    short = [row(2000 + i, sentence(r, "en", 15)) for i in range(20)]
    got = {x.doc_id: x for x in R.judged(spark.createDataFrame([*rows, *junk, *short], STRUCT)).collect()}
    assert {i for i, x in got.items() if not x.kept} == {1000, 1001, 1002, 1003, 1004}
    assert not any(x.base_failed for x in got.values())
