"""Toxicity: character n-gram linear classifier with naive Bayes log-count ratios.

A document is the set of its hashed character n-grams (lower-cased, four to six
characters, of the whole text). Each feature is scaled by the log ratio of
its smoothed document counts in toxic and other texts; a logistic regression on
the scaled features gives the score. N-grams of both signs have weights, as far as
their log ratio is MIN_ERRORS standard errors or more from zero: in a long text
the many others, whose ratios are chance, would outvote the few that count. Most
n-grams that pass point to toxicity, since other texts have no words of their own.
Features are made on the executors,
training runs on the driver over a bounded sample, of whose near copies one counts.

Defined cases: a null text counts as empty; an empty text scores by the bias
alone; a null doc_id is never learned from and is not held out; of repeated
doc_ids in the labels a document is toxic if any row says so; repeated
documents are scored row by row; without labels of both classes every score is
0. Other columns of the input are ignored by toxicity_scores and kept by
drop_toxic, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C

BITS = 20
GRAMS = (4, 5, 6)
#: At most about so many labelled texts of each class are learned from.
PER_CLASS = 1000
THRESHOLD = 0.7
#: N-grams in fewer texts of the sample, or whose log ratio is nearer to zero, get no weight.
MIN_TEXTS, MIN_ERRORS = 5, 2.0
_CHUNK = 1 << 20
_PART = 128
_HASHES, _ALIKE = 32, 20


def features(text: str | None, seen: np.ndarray, stamp: int) -> np.ndarray:
    """The set of n-gram ids of a text. seen: an int32 array of 2**BITS, marked with stamp for ids that were met."""
    out = []
    for part in C.text_chunks(f" {(text or '').lower()} ", _CHUNK, max(GRAMS) - 1):
        codes = C.code_points(part)
        for n in GRAMS:
            ids = C.gram_ids(codes, n, BITS)
            ids = ids[seen[ids] != stamp]
            at = np.arange(len(ids), dtype=np.int32)
            seen[ids] = at  # the last of equal ids wins
            ids = ids[seen[ids] == at]
            seen[ids] = stamp
            out.append(ids)
    return np.concatenate(out)


def all_features(texts) -> Iterator[np.ndarray]:
    seen = np.zeros(1 << BITS, np.int32)
    for k, text in enumerate(texts):
        yield features(text, seen, -1 - k)


def unlike(sets: list[np.ndarray]) -> np.ndarray:
    """Places of sets of which no two are near copies (some six of ten n-grams in common or more, by minimum hashes); the first of such stays.

    Copies would make chance n-grams of one text look like those of many.
    """
    turns = np.random.default_rng(3).integers(1, 1 << 32, (_HASHES, 1), dtype=np.uint32) | np.uint32(1)
    least = np.full((len(sets), _HASHES), 0xFFFFFFFF, np.uint32)
    for k, ids in enumerate(sets):
        if len(ids):
            least[k] = (ids.astype(np.uint32) * turns).min(axis=1)
    kept: list[int] = []
    for k in range(len(sets)):
        if not kept or (least[kept] == least[k]).sum(axis=1).max() < _ALIKE:
            kept.append(k)
    return np.array(kept, np.int64)


def train(sets: list[np.ndarray], labels: np.ndarray, rounds: int = 120, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights by n-gram id and the bias. Adam on whole gradients, summed over parts of the sample to save memory."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), -1e9
    y = labels.astype(np.float64)
    toxic, other = np.ones(1 << BITS), np.ones(1 << BITS)
    for ids, label in zip(sets, labels, strict=True):
        (toxic if label else other)[ids] += 1
    ratio = np.log(toxic / (y.sum() + 2)) - np.log(other / ((1 - y).sum() + 2))
    met = np.flatnonzero((toxic + other >= MIN_TEXTS + 2) & (np.abs(ratio) >= MIN_ERRORS * np.sqrt(1 / toxic + 1 / other)))
    ratio = ratio[met]
    local = np.full(1 << BITS, len(met), np.int32)  # the last slot is for all others and stays 0
    local[met] = np.arange(len(met), dtype=np.int32)
    ratio = np.append(ratio, 0.0)
    parts = []
    for at in range(0, len(sets), _PART):
        kept = [c[c < len(met)] for c in (local[ids] for ids in sets[at : at + _PART])]
        parts.append((at, np.concatenate(kept), np.array([len(c) for c in kept])))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, bias = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    for t in range(1, rounds + 1):
        scaled, gw, gb = w * ratio, penalty * w, 0.0
        for at, col, sizes in parts:
            row = np.repeat(np.arange(len(sizes)), sizes)
            z = np.bincount(row, weights=scaled[col], minlength=len(sizes)) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[at : at + len(sizes)]) * share[at : at + len(sizes)]
            gw += np.bincount(col, weights=g[row], minlength=len(ratio)) * ratio
            gb += g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.02 / (1 - 0.9**t) * np.sqrt(1 - 0.99**t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[met] = (w * ratio)[:-1]
    return weights, float(bias)


def score(texts, weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.array([float(weights[ids].sum(dtype=np.float64)) for ids in all_features(texts)]) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held: tuple[int, int] | None = (3, 1), per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled documents, without those whose id's remainder is held out."""
    C.ready(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if held:
        known = known.where(C.remainder("id", held[0]) != held[1])
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen, most = C.class_sample(known, "id", "label", per_class, 10)
    chosen = chosen.limit(most).toPandas()
    if chosen.label.nunique() < 2:
        return train([], np.zeros(0))
    spark = docs.sparkSession
    few = spark.createDataFrame(chosen.astype({"id": "int64", "label": "int32"}), "id long, label int")  # bounded by per_class
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "label": b.label, "ids": [np.sort(x).tobytes() for x in all_features(b.text)]})

    got = texts.mapInPandas(featured, "id long, label int, ids binary").toArrow().sort_by("id")
    sets = [np.frombuffer(x, np.int32) for x in (v.as_buffer() for v in got["ids"])]
    kept = unlike(sets)
    return train([sets[k] for k in kept], got["label"].to_numpy()[kept])


def score_udf(spark, weights: np.ndarray, bias: float):
    """A column function: text to the toxicity score."""
    C.ready(spark)
    model = spark.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(texts, *model.value))

    return toxicity


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (3, 1), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    udf = score_udf(docs.sparkSession, *learn(docs, labels, id_col, text_col, held=held))
    return C.on_all_cores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select(
        "doc_id",
        F.coalesce(C.remainder("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out"),
        udf(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    udf = score_udf(docs.sparkSession, *learn(docs, labels, id_col, text_col))
    return C.on_all_cores(docs).where(udf(F.col(text_col)) < threshold)
