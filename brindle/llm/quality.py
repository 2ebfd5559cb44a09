"""Quality classifier: supervised subword embeddings with a softmax output.

Each word, each pair of words that follow each other, and each character n-gram
of a word (three to five characters, the word in boundary marks) has a learned
vector, found by hashing. A pair is hashed by the exclusive or of its words, so
that its order doesn't count and a word with itself has the same vector whichever
word it is: what repetition says is learned once for all words. A document is
the average of the vectors of its whole text, with counts; a softmax over two
outputs gives the score. Vectors and outputs are trained together by stochastic
gradient descent in numpy, one document a step, on a bounded sample of the
labelled rows.

For a fixed output layer the difference of the two logits is linear in the
average, so every hash slot is folded into one number before scoring.

Defined cases: a null text counts as empty; an empty text scores by the output
bias alone; a null doc_id is never learned from and is not held out; of
repeated doc_ids in the labels the highest label counts; repeated documents are
scored row by row; without labels of both classes every score is 0.5. Other
columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C

BITS = 17
DIM = 8
GRAMS = (3, 4, 5)
#: At most about so many labelled texts of each class are learned from.
PER_CLASS = 1500
THRESHOLD = 0.3
_CHUNK = 1 << 18
_FIRST, _TIMES, _PAIR = 0x811C9DC5, 0x01000193, np.uint32(0x9E3779B1)


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Hashed ids of the words, their n-grams and their pairs, chunk by chunk of the whole text; a word may span chunks."""
    text = text or ""
    before = np.array([0x20], np.uint32)
    length, begun, last = 0, 0, None  # of the word that the chunk before ended in; the last whole word
    for at in range(0, len(text) + 1, _CHUNK):
        codes = C.code_points(text[at : at + _CHUNK])
        if at + _CHUNK > len(text):
            codes = np.append(codes, np.uint32(0x20))
        codes = np.where((codes >= 0x09) & (codes <= 0x0D), np.uint32(0x20), codes)
        both = np.concatenate((before, codes))
        white = both == 0x20
        for n in GRAMS:
            skip = max(0, len(before) - n + 1)
            ids = C.gram_ids(both[skip:], n, BITS)
            w = white[skip:]
            inner = np.zeros(len(ids), bool)
            for k in range(1, n - 1):
                inner |= w[k : k + len(ids)]
            marks = w[: len(ids)] & w[n - 1 :]  # a whole word in its marks; words have ids of their own
            yield ids[~(inner | marks)]
        before, letter = both[1 - max(GRAMS) :], ~white[len(before) :]
        words, (length, begun) = _words(codes, letter, length, begun)
        yield C.spread(words, BITS)
        if last is not None:
            words = np.concatenate((last, words))
        if len(words) > 1:
            yield C.spread(words[:-1] ^ words[1:] ^ _PAIR, BITS)
        last = words[-1:] if len(words) else last


def _words(codes: np.ndarray, letter: np.ndarray, length: int, begun: int) -> tuple[np.ndarray, tuple[int, int]]:
    """Hashes of the words that end in a chunk, and the length and hash of one that doesn't. length, begun: of one that began before."""
    starts = np.flatnonzero(letter & ~np.concatenate(([length > 0], letter[:-1])))
    if length:
        starts = np.concatenate(([0], starts))
    if not len(starts):
        return np.zeros(0, np.uint32), (0, 0)
    place = np.arange(len(codes)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(codes)]))))
    h = np.add.reduceat((codes + np.uint32(7)) * _powers(int(place[letter].max(initial=0)) + 1)[np.where(letter, place, 0)] * letter, starts, dtype=np.uint32)
    if length:
        h[0] = (begun + int(h[0]) * pow(_TIMES, length, 1 << 32)) & 0xFFFFFFFF
    if not letter[-1]:
        return h, (0, 0)
    return h[:-1], (len(codes) - int(starts[-1]) + (length if length and len(starts) == 1 else 0), int(h[-1]))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _TIMES, np.uint32)
    p[0] = _FIRST
    return np.multiply.accumulate(p, dtype=np.uint32)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for part in subwords(text):
        ids, at = np.unique(np.concatenate((ids, part)), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate((n, np.ones(len(part)))), minlength=len(ids)).astype(np.int64)
    return ids.astype(np.int32), n.astype(np.int32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 15000, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """The folded model: a number for each hash slot, and the bias."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    random = np.random.default_rng(8)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    out[1], out[0] = 0.1, -0.1
    seen = np.full(1 << BITS, 1e-8, np.float32)
    seen_out, seen_bias = np.full((2, DIM), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    share = len(labels) / (2 * np.bincount(labels, minlength=2).clip(1))
    for _ in range(min(40, max(6, -(-steps // len(bags))))):
        for k in random.permutation(len(bags)):
            ids, n = bags[k]
            p = (n / max(1, n.sum())).astype(np.float32)
            hidden = p @ vectors[ids]
            z = out @ hidden + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[labels[k]] -= 1
            error *= share[labels[k]]
            back = out.T @ error
            seen_out += np.outer(error, hidden) ** 2
            seen_bias += error**2
            out -= rate * np.outer(error, hidden) / np.sqrt(seen_out)
            bias -= rate * error / np.sqrt(seen_bias)
            seen[ids] += p * p * (back @ back)
            vectors[ids] -= (rate * p / np.sqrt(seen[ids]))[:, None] * back
    slots = (vectors @ (out[1] - out[0])).astype(np.float32)
    met = np.zeros(1 << BITS, bool)
    for ids, _ in bags:
        met[ids] = True
    slots[~met] = 0  # slots that were never trained hold only their start values
    return slots, float(bias[1] - bias[0])


def score(texts, slots: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(texts))
    for k, text in enumerate(texts):
        total, n = 0.0, 0
        for ids in subwords(text):
            total += float(slots[ids].sum(dtype=np.float64))
            n += len(ids)
        out[k] = total / n if n else 0.0
    return 1 / (1 + np.exp(-np.clip(out + bias, -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: tuple[int, int] | None = (5, 0), per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled documents, without those whose id's remainder is held out."""
    C.ready(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if held:
        known = known.where(C.remainder("id", held[0]) != held[1])
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen, most = C.class_sample(known, "id", "label", per_class, 8)
    chosen = chosen.limit(most).toPandas()
    if chosen.label.nunique() < 2:
        return train([], np.zeros(0, np.int64))
    spark = docs.sparkSession
    few = spark.createDataFrame(chosen.astype({"id": "int64", "label": "int32"}), "id long, label int")  # bounded by per_class
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bags = [counts(t) for t in b.text]
            yield pd.DataFrame({"id": b.id, "label": b.label, "ids": [x.tobytes() for x, _ in bags], "n": [n.tobytes() for _, n in bags]})

    got = texts.mapInPandas(counted, "id long, label int, ids binary, n binary").toPandas().sort_values("id")
    bags = [(np.frombuffer(x, np.int32), np.frombuffer(n, np.int32)) for x, n in zip(got.ids, got.n, strict=True)]
    return train(bags, got.label.to_numpy().astype(np.int64))


def score_udf(spark, slots: np.ndarray, bias: float):
    """A column function: text to the quality score."""
    C.ready(spark)
    model = spark.sparkContext.broadcast((slots, bias))

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(texts, *model.value))

    return quality


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (5, 0), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    udf = score_udf(docs.sparkSession, *learn(docs, labels, id_col, text_col, held=held))
    return C.on_all_cores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select(
        "doc_id",
        F.coalesce(C.remainder("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out"),
        udf(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
