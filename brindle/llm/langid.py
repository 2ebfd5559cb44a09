"""Language ID: a byte convolutional network over fixed-length windows.

Filters of two, three and four bytes slide over windows of 96 bytes (letters
A-Z folded, digits as one class); each filter's maximum over the window feeds a
softmax. The network is trained in numpy on a bounded sample of labelled texts
and applied to batches of windows that cover the whole text; a document's
distribution is the mean over its windows.

A convolution over one-hot bytes is a sum of table rows, so the tables of two
neighbouring bytes are added up once before scoring.

Defined cases: a null text, or one without a letter, is `und` with score 0; a
null or held-out id, or a null language, is never learned from; without any
label all texts are `und`; with one label every text with a letter gets it; the
last window is padded with spaces; repeated rows are predicted row by row.
Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 8
#: At most about so many texts of each language are learned from, and so many windows of each.
PER_CLASS = 400
WINDOWS_PER_TEXT = 8
#: The whole sample has about so many texts at most; with more than MOST_TEXTS / PER_CLASS languages each has fewer.
MOST_TEXTS = 100_000
_BLOCK = 1024


def _classes() -> tuple[np.ndarray, int]:
    """Byte classes: white space 0, digits 1, other signs 2, letters 3-28, bytes from 0x80 each their own."""
    table = np.full(256, 2, np.uint8)
    table[:33] = 0
    table[48:58] = 1
    for k in range(26):
        table[65 + k] = table[97 + k] = 3 + k
    table[128:] = 29 + np.arange(128)
    return table, 29 + 128


CLASS, N_CLASSES = _classes()


def windows(text: str, most: int | None = None) -> np.ndarray:
    """Byte classes of the windows of a text, all of them or `most` evenly spread ones."""
    data = CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    n = max(1, -(-len(data) // WINDOW))
    full = np.zeros(n * WINDOW, np.uint8)
    full[: len(data)] = data
    full = full.reshape(n, WINDOW)
    return full if most is None or n <= most else full[np.linspace(0, n - 1, most).astype(int)]


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # for each width: (width, classes, filters)
    offsets: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        two, three, four = self.filters
        pairs = [a[:, None, :] + b[None, :, :] for a, b in ((two[0], two[1]), (three[0], three[1]), (four[0], four[1]), (four[2], four[3]))]
        return np.concatenate(pairs, axis=2).reshape(N_CLASSES * N_CLASSES, -1).astype(np.float32), three[2].astype(np.float32)

    def probabilities(self, codes: np.ndarray, tables) -> np.ndarray:
        """Distributions of windows of byte classes."""
        pair, third = tables
        k, n = FILTERS, WINDOW - max(WIDTHS) + 1
        both = codes[:, :-1].astype(np.int32) * N_CLASSES + codes[:, 1:]
        got = pair[both]
        two = got[:, :n, :k].max(axis=1)
        three = (got[:, :n, k : 2 * k] + third[codes[:, 2 : n + 2]]).max(axis=1)
        four = (got[:, :n, 2 * k : 3 * k] + got[:, 2 : n + 2, 3 * k :]).max(axis=1)
        hidden = np.maximum(np.concatenate((two, three, four), axis=1) + self.offsets, 0)
        z = hidden @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(codes: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01) -> Network:
    """Adam on minibatches; the gradient of a maximum goes to the place that had it."""
    random = np.random.default_rng(1)
    size, n = len(WIDTHS) * FILTERS, WINDOW - max(WIDTHS) + 1
    weights = [random.normal(0, 0.3, (w, N_CLASSES, FILTERS)) for w in WIDTHS]
    params = [*weights, np.zeros(size), random.normal(0, 0.3, (size, len(languages))), np.zeros(len(languages))]
    moments, squares, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = max(epochs, -(-1500 * batch // max(1, len(codes)))) if len(languages) > 1 else 0
    for _ in range(min(steps, 60)):
        order = random.permutation(len(codes))
        for at in range(0, len(order), batch):
            x, y = codes[order[at : at + batch]].astype(np.int64), labels[order[at : at + batch]]
            tops, places = [], []
            for w, filters in zip(WIDTHS, params[:3], strict=True):
                got = sum(filters[k][x[:, k : k + n]] for k in range(w))
                place = got.argmax(axis=1)
                places.append(place)
                tops.append(np.take_along_axis(got, place[:, None, :], axis=1)[:, 0])
            before = np.concatenate(tops, axis=1) + params[3]
            hidden = np.maximum(before, 0)
            z = hidden @ params[4] + params[5]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ params[4].T) * (before > 0)
            grads = []
            for j, w in enumerate(WIDTHS):
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                g = np.empty_like(params[j])
                for k in range(w):
                    slot = np.take_along_axis(x, places[j] + k, axis=1) * FILTERS + np.arange(FILTERS)
                    g[k] = np.bincount(slot.ravel(), weights=part.ravel(), minlength=N_CLASSES * FILTERS).reshape(N_CLASSES, FILTERS)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            t += 1
            for p, g, m, v in zip(params, grads, moments, squares, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Network(languages, [p.astype(np.float32) for p in params[:3]], params[3].astype(np.float32), params[4].astype(np.float32), params[5].astype(np.float32))


def predict(texts, net: Network | None, tables=None) -> tuple[list[str], np.ndarray]:
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if net is None:
        return langs, scores
    tables = tables or net.tables()
    waiting, owners, held = [], [], 0
    total, n = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts), np.int64)

    def flush() -> None:
        nonlocal waiting, owners, held
        if held:
            codes, who = np.concatenate(waiting), np.concatenate(owners)
            for at in range(0, len(codes), _BLOCK):
                p, w = net.probabilities(codes[at : at + _BLOCK], tables), who[at : at + _BLOCK]
                np.add.at(total, w, p)
                n[:] += np.bincount(w, minlength=len(n))
        waiting, owners, held = [], [], 0

    for k, text in enumerate(texts):
        if text is None or not any(map(str.isalpha, text)):
            continue
        part = windows(text)
        waiting.append(part)
        owners.append(np.full(len(part), k))
        held += len(part)
        if held >= 4 * _BLOCK:
            flush()
    flush()
    for k in np.flatnonzero(n):
        p = total[k] / n[k]
        langs[k], scores[k] = net.languages[int(p.argmax())], min(1.0, float(p.max()))
    return langs, scores


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: tuple[int, int] = (4, 2), per_class: int = PER_CLASS) -> Network | None:
    """Train on a bounded, hash-chosen sample of every language's texts."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    known = known.where("id is not null and label is not null and text is not null").where(C.remainder("id", held[0]) != held[1])
    C.ready(docs.sparkSession)
    few, most = C.class_sample(known, "id", "label", per_class, 1, MOST_TEXTS)
    few = few.groupBy("id").agg(F.min(F.struct("label", "text")).alias("x")).select("id", "x.*")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [windows(t, WINDOWS_PER_TEXT) for t in b.text]
            yield pd.DataFrame({"id": b.id, "label": b.label, "codes": [g.tobytes() for g in got]})

    got = few.mapInPandas(cut, "id long, label string, codes binary").limit(most).toPandas().sort_values("id")
    if not len(got):
        return None
    languages = sorted(got.label.unique())
    place = {x: k for k, x in enumerate(languages)}
    codes = [np.frombuffer(x, np.uint8).reshape(-1, WINDOW) for x in got.codes]
    labels = np.repeat([place[x] for x in got.label], [len(x) for x in codes])
    return train(np.concatenate(codes), labels, languages)


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    spark = docs.sparkSession
    C.ready(spark)
    model = spark.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, held))

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = model.value.tables() if model.value else None
        for texts in batches:
            langs, scores = predict(texts, model.value, tables)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return C.on_all_cores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select(
        "doc_id",
        F.coalesce(C.remainder("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out"),
        language(F.col("text")).alias("p"),
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
