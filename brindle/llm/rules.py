r"""Quality rules: exact counts per text, and n-gram perplexity bands by language.

The base counts (words, their code points, symbol characters, repeated lines,
words in repeated five-word windows) and the base verdict are exact. The method
adds a character four-gram model with modified Kneser-Ney smoothing for every
language: n-grams of all whole texts are counted with Spark (pre-aggregated in
each task), continuation counts, discounts and back-off weights are DataFrame
aggregations over the distinct n-grams. The finished probabilities are a written
table of the n-grams themselves, read as sorted arrays with parallel arrays of
values, 12 bytes an entry: nothing is hashed or left out, and an n-gram that was
not counted is never found. A text's log perplexity is the mean negative log
probability of its n-grams, and its word perplexity their sum for each word: junk
that many texts share is likely to the model, but what is put to every word still
makes each of them longer and so less likely. Texts are split by a hash into two halves, each half
has a model of its own, and a text is scored by the model of the other half, so
that it can't vouch for itself. The bands of both lie around the median of the texts
of the language that the same model scores, in units of their robust spread; they
widen with the square root of the median length over the text's for shorter ones.

The model grows with the corpus; what is broadcast at a time doesn't. A model of
more than MOST_ENTRIES entries is cut into pieces by the middle two characters of
an n-gram, on which everything but its last back-off to pairs and single
characters depends; these are in every piece. Models and pieces are packed into
loads of about MOST_ENTRIES. Each load is one pass over the texts of its
languages that sums up the n-grams of its pieces, and the sums of passes add up.
A text is read by as many passes as its own language's model has pieces.

Defined cases: a null text counts as empty and fails the base rules; a null
language shares its model with the empty one; a text without n-grams, or whose
language has no text in the other half, has no perplexity and no verdict by it;
an empty table gives no rows; repeated rows count as often as they occur and are
judged row by row. The driver sees four numbers for each language. Other columns of the input play no part, whatever their
names. The model's characters are UTF-16 units, so that four of them fill 64 bits
and none are folded; a code point above 65535 counts as two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C

ORDER = 4
CHAR_BITS = 16
#: Entries of the model (of 12 bytes) that are broadcast at a time.
MOST_ENTRIES = 8_000_000
#: Bands: so many robust spreads below and above the median log perplexity; a spread counts as MIN_SPREAD at least
#: (for words, as many times more as their median is larger).
BELOW, ABOVE, MIN_SPREAD = 4.0, 8.0, 0.02
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
_CHUNK = 1 << 20
_FLUSH = 1 << 21
_SPREAD, _PRIME = 40503, 1_000_003
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    white = int(((data == 0x20) | ((data >= 0x09) & (data <= 0x0D))).sum())
    words = C.word_hashes(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), len(text) - white, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a window of five words found twice or more in the text."""
    grams = C.shingle_hashes(words, WINDOW)
    if len(grams) < 2:
        return 0
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(grams, twice))
    edge = np.zeros(len(words) + 1, np.int32)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge) > 0).sum())


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def gram_codes(text: str | None) -> Iterator[np.ndarray]:
    """The n-grams of a text as integers, oldest character highest."""
    units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), np.uint16)
    for at in range(0, len(units) - ORDER + 1, _CHUNK):
        codes = units[at : at + _CHUNK + ORDER - 1].astype(np.uint64)
        m = len(codes) - ORDER + 1
        out = np.zeros(m, np.uint64)
        for k in range(ORDER):
            out <<= np.uint64(CHAR_BITS)
            out |= codes[k : k + m]
        yield out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of a task: language, n-gram, count. Sent on when they grow beyond a bound."""
    held: dict[str, list] = {}
    fresh = 0

    def out() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            codes, n = _summed(parts)
            for at in range(0, len(codes), 1 << 17):
                yield pd.DataFrame({"lang": lang, "code": codes[at : at + (1 << 17)].view(np.int64), "c": n[at : at + (1 << 17)]})

    for b in batches:
        for lang, texts in b.groupby("lang").text:
            got = [g for t in texts for g in gram_codes(t)]
            if got:
                part = np.unique(np.concatenate(got), return_counts=True)
                held.setdefault(lang, []).append(part)
                fresh += len(part[0])
        if fresh > _FLUSH:
            held = {lang: [_summed(parts)] for lang, parts in held.items()}
            fresh = 0
            if sum(len(p[0][0]) for p in held.values()) > _FLUSH:
                yield from out()
                held = {}
    yield from out()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.0), k - 0.01) for k, x in enumerate(d, 1))


def discount_columns() -> list[Column]:
    """The same from columns n1 to n4."""
    n = [F.col(f"n{j}").cast("double") for j in (1, 2, 3, 4)]
    y = F.when(n[0] > 0, n[0] / (n[0] + 2 * n[1])).otherwise(0.0)
    d = [F.when(n[k - 1] > 0, k - (k + 1) * y * n[k] / n[k - 1]).otherwise(0.5 * k) for k in (1, 2, 3)]
    return [F.least(F.greatest(x, F.lit(0.0)), F.lit(k - 0.01)) for k, x in enumerate(d, 1)]


def kneser_ney(grams: DataFrame) -> DataFrame:
    """From exact counts (lang, code, c) of the highest order: lang, kind, code, c, value for every table of the model."""
    level, levels = C.staged(grams, "counted").withColumn("k", F.lit(ORDER)), []
    for k in range(ORDER, 0, -1):
        levels.append(level)
        if k > 1:
            rest = F.col("code").bitwiseAND(F.lit((1 << CHAR_BITS * (k - 1)) - 1))
            level = level.groupBy("lang", rest.alias("code")).agg(F.count("*").alias("c")).withColumn("k", F.lit(k - 1))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every = C.staged(every.withColumn("ctx", F.shiftrightunsigned("code", CHAR_BITS)), "grams")
    numbers = [F.sum((F.col("c") == j).cast("long")).alias(f"n{j}") for j in (1, 2, 3, 4)]
    few = every.groupBy("k", "lang").agg(*numbers, F.count("*").alias("kinds"))
    few = C.staged(few.select("k", "lang", *(d.alias(f"d{j}") for j, d in enumerate(discount_columns(), 1)), (F.col("kinds") + 1.0).alias("kinds")), "discounts")
    contexts = every.groupBy("k", "lang", "ctx").agg(F.sum("c").alias("total"), *(F.sum((F.col("c") == j).cast("long")).alias(f"n{j}") for j in (1, 2)), F.sum((F.col("c") > 2).cast("long")).alias("n3"))
    contexts = contexts.join(few, ["k", "lang"]).withColumn("gamma", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
    contexts = C.staged(contexts.select("k", "lang", "ctx", "total", "gamma", "d1", "d2", "d3", "kinds"), "contexts")
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = every.join(contexts, ["k", "lang", "ctx"]).withColumn("own", (F.col("c") - cut) / F.col("total"))
    own = C.staged(own.select("k", "lang", "code", "c", "own", "gamma", "kinds"), "own")
    lower, out = None, None
    for k in range(1, ORDER + 1):
        here = own.where(F.col("k") == k)
        if lower is None:
            p = here.withColumn("p", F.col("own") + F.col("gamma") / F.col("kinds"))
        else:
            rest = F.col("code").bitwiseAND(F.lit((1 << CHAR_BITS * (k - 1)) - 1))
            p = here.withColumn("rest", rest).join(lower.select("lang", F.col("code").alias("rest"), F.col("p").alias("q")), ["lang", "rest"])
            p = p.withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        lower = C.staged(p.select("lang", "code", "c", "p"), f"p{k}") if k < ORDER else p.select("lang", "code", "c", "p")
        found = lower.select("lang", F.lit(k).alias("kind"), "code", "c", F.log("p").alias("value"))
        out = found if out is None else out.unionByName(found)
    back = contexts.where("k > 1").select("lang", (1 - F.col("k")).alias("kind"), F.col("ctx").alias("code"), F.col("total").alias("c"), F.log(F.greatest("gamma", F.lit(1e-12))).alias("value"))
    return out.unionByName(back)


def piece_of(code: Column, kind: Column, pieces: Column) -> Column:
    """Which piece of a language's model an entry is in; null for those that every piece has."""
    pair = F.when(kind == -3, code.bitwiseAND(F.lit(0xFFFFFFFF))).when(kind == -2, code).otherwise(F.shiftrightunsigned(code, CHAR_BITS).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(kind.isin(4, 3, -3, -2), F.pmod(F.pmod(pair * F.lit(_SPREAD), F.lit(_PRIME)), pieces))


def pieces_of(codes: np.ndarray, pieces: int) -> np.ndarray:
    """The same for n-grams of the highest order."""
    pair = (codes >> np.uint64(CHAR_BITS)) & np.uint64(0xFFFFFFFF)
    return pair * np.uint64(_SPREAD) % np.uint64(_PRIME) % np.uint64(pieces)


class Model:
    """For each language and kind (the order, or minus the length of a context) sorted n-grams and their values.

    pieces: for each language how many there are, and which of them the tables have.
    """

    def __init__(self, tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], pieces: dict[str, tuple[int, list[int]]] | None = None) -> None:
        self.tables = tables
        self.pieces = pieces or {lang: (1, [0]) for lang, _ in tables}

    def own(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """The n-grams that the pieces here are for."""
        n, mine = self.pieces.get(lang, (1, []))
        if len(mine) == n:
            return codes
        return codes[np.isin(pieces_of(codes, n), mine)]

    def look(self, lang: str, kind: int, codes: np.ndarray) -> np.ndarray:
        """Values of n-grams, not a number where one isn't stored."""
        if (lang, kind) not in self.tables:
            return np.full(len(codes), np.nan, np.float32)
        keys, values = self.tables[lang, kind]
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return np.where(keys[at] == codes, values[at], np.float32(np.nan))

    def log_probabilities(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Of n-grams, backing off where one isn't stored."""
        out = self.look(lang, ORDER, codes)
        lost = np.flatnonzero(np.isnan(out))
        penalty = np.zeros(len(lost), np.float32)
        for k in range(ORDER - 1, 0, -1):
            if not len(lost):
                break
            tail = codes[lost] & np.uint64((1 << CHAR_BITS * (k + 1)) - 1)
            penalty += np.nan_to_num(self.look(lang, -k, tail >> np.uint64(CHAR_BITS)), nan=0.0)
            got = self.look(lang, k, tail & np.uint64((1 << CHAR_BITS * k) - 1)) + penalty
            if k == 1:
                got = np.nan_to_num(got, nan=-20.0)
            hit = ~np.isnan(got)
            out[lost[hit]] = got[hit]
            lost, penalty = lost[~hit], penalty[~hit]
        return out


def counted_model(docs: DataFrame) -> DataFrame:
    """lang, kind, code, value of the whole model. docs: lang (not null) and text."""
    C.ready(docs.sparkSession)
    with C.scratch() as keep:
        grams = docs.mapInPandas(count_grams, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))
        return keep(C.staged(kneser_ney(grams).select("lang", "kind", "code", F.col("value").cast("float").alias("value")), "model"))


def loads(model: DataFrame, most: int) -> list[dict[str, tuple[int, list[int]]]]:
    """Models and pieces packed into loads of about `most` entries: for each load its languages, with their number of pieces and those here."""
    low = F.col("kind").isin(1, 2, -1)
    sizes = model.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(low).alias("low")).orderBy(F.desc("n"), "lang").collect()
    out, rooms = [], []
    for lang, n, few in sizes:
        pieces = max(1, -(-(n - few) // most))
        size = few + -(-(n - few) // pieces)
        for p in range(pieces):
            k = next((k for k, room in enumerate(rooms) if room >= size and lang not in out[k]), None)
            if k is None:
                out.append({})
                rooms.append(most)
                k = len(out) - 1
            out[k][lang] = (pieces, [p])
            rooms[k] -= size
    return out


def load(model: DataFrame, part: dict[str, tuple[int, list[int]]]) -> Model:
    """The arrays of one load."""
    spark = model.sparkSession
    plan = spark.createDataFrame([(lang, k, n, mine[0]) for k, (lang, (n, mine)) in enumerate(part.items())], "lang string, key int, pieces long, mine long")
    rows = model.join(F.broadcast(plan), "lang")  # a row for each language of the load
    piece = piece_of(F.col("code"), F.col("kind"), F.col("pieces"))
    got = rows.where(piece.isNull() | (piece == F.col("mine"))).select("key", F.col("kind").cast("byte").alias("kind"), "code", "value").toArrow()
    key, kind, codes, values = got["key"].to_numpy(), got["kind"].to_numpy(), got["code"].to_numpy().view(np.uint64), got["value"].to_numpy()
    names, tables = list(part), {}
    order = np.argsort(key.astype(np.int32) * 16 + kind, kind="stable")
    told = key[order].astype(np.int32) * 16 + kind[order]
    edges = [0, *(np.flatnonzero(told[1:] != told[:-1]) + 1).tolist(), len(told)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            at = order[a:b]
            at = at[np.argsort(codes[at])]
            tables[names[key[at[0]]], int(kind[at[0]])] = (codes[at], values[at])
    return Model(tables, part)


def fit(docs: DataFrame) -> Model:
    """A whole model of a small table. docs: lang (not null) and text."""
    model = counted_model(docs)
    return load(model, {r.lang: (1, [0]) for r in model.select("lang").distinct().collect()})


_MEASURES = ("log_ppl", "log_word")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_ENTRIES) -> DataFrame:
    """Counts and log perplexity of every document, by the model of the language's other half."""
    spark = docs.sparkSession
    half = F.pmod(F.xxhash64(F.col(text_col)), F.lit(2)).cast("string")
    texts = C.on_all_cores(docs.select(id_col, lang_col, text_col)).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), half.alias("half"), F.col(text_col).alias("text"))
    table = counted_model(texts.select(F.concat("half", "lang").alias("lang"), "text"))
    texts = texts.withColumn("other", F.concat(F.when(F.col("half") == "0", "1").otherwise("0"), "lang"))
    parts = loads(table, most)
    done = [_pass(spark, texts, load(table, part), part) for part in parts]
    rest = texts.where(~F.col("other").isin(sorted({lang for part in parts for lang in part})))
    done.append(_pass(spark, rest, Model({}), None))
    rows = reduce(DataFrame.unionByName, done)
    whole = rows.where("pieces = 1").select("doc_id", "other", *_COUNTS, "n_grams", "total")
    if len(parts) > 1:
        # of texts in several passes the first has the counts; equal rows have equal sums
        cut = rows.where("pieces > 1").groupBy("doc_id", "other", "same").agg(*(F.max(c).alias(c) for c in (*_COUNTS, "n_grams")), F.sum("total").alias("total"), F.count("n_words").alias("copies"))
        cut = cut.withColumn("total", F.col("total") / F.col("copies")).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        whole = whole.unionByName(cut.select(*whole.columns))
    return whole.select("doc_id", "other", *_COUNTS, "n_grams", F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).alias("log_ppl"))


def _pass(spark, texts: DataFrame, model: Model, part: dict[str, tuple[int, list[int]]] | None) -> DataFrame:
    """Sums of one load; with the base counts where it has the language's first piece. Without a load, texts that no model scores."""
    held = spark.sparkContext.broadcast(model)  # about MOST_ENTRIES entries

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, total double, pieces long")
    def counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = held.value
        for texts, keys in batches:
            rows = []
            for text, key in zip(texts, keys, strict=True):
                pieces, mine = model.pieces.get(key, (1, [0]))
                known, total, n = key in model.pieces, 0.0, 0
                if known:
                    for codes in gram_codes(text):
                        total -= float(model.log_probabilities(key, model.own(key, codes)).sum(dtype=np.float64))
                        n += len(codes)
                rows.append((*(base_counts(text) if mine[0] == 0 else (None,) * 5), n, total if known else None, pieces))
            out = pd.DataFrame(rows, columns=[*_COUNTS, "n_grams", "total", "pieces"]).astype({"total": "float64"})
            yield out.astype({c: "Int64" for c in _COUNTS})

    rows = texts.where(F.col("other").isin(list(part))) if part is not None else texts
    same = F.xxhash64(F.lit(9), F.col("text"))
    rows = rows.select("doc_id", "other", same.alias("same"), counted("text", "other").alias("x")).select("doc_id", "other", "same", "x.*")
    rows = C.staged(rows, "counts")
    held.destroy()
    return rows


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_ENTRIES) -> DataFrame:
    """Counts, perplexity and verdict of every document."""
    rows = measured(docs, id_col, text_col, lang_col, most).withColumn("log_word", F.when(F.col("n_words") > 0, F.col("log_ppl") * F.col("n_grams") / F.col("n_words")))
    parts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quarters = rows.where("log_ppl is not null").groupBy("other").agg(*(F.percentile_approx(c, parts, 10000).alias(c) for c in _MEASURES), F.percentile_approx("n_grams", 0.5, 10000).alias("usual"))
    spreads = []
    for c in _MEASURES:
        least = F.lit(MIN_SPREAD) * F.coalesce(F.col(c)[1] / F.col("log_ppl")[1], F.lit(1.0))
        spreads += [F.col(c)[1].alias(f"{c}_mid"), F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, least).alias(f"{c}_spread")]
    bands = C.staged(quarters.select("other", "usual", *spreads), "bands")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = rows.join(bands, "other", "left")  # a row for each half of a language, broadcast if Spark finds the written table small
    wider = F.sqrt(F.greatest(F.lit(1.0), F.col("usual") / F.greatest(F.lit(1), F.col("n_grams"))))
    inside = F.lit(True)
    for c in _MEASURES:
        off = (F.col(c) - F.col(f"{c}_mid")) / (F.col(f"{c}_spread") * wider)
        inside = inside & F.coalesce(off.between(-BELOW, ABOVE), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), F.exp("log_ppl").alias("perplexity"), F.exp("log_word").alias("word_perplexity"))


def base_sql() -> str:
    """Base counts and verdict in DuckDB SQL."""
    word, lines = r"[^\x20\x09-\x0D]", "list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT r, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS g FROM i),
f AS (SELECT r, k FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, count(DISTINCT k + m) AS n FROM f, (SELECT unnest(range({WINDOW})) AS m) GROUP BY r),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
  (len({lines}) - len(list_distinct({lines})))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c ON d.r = c.r)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM x"""
