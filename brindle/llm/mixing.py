r"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Sources share a multiple of all words by
weight; no target exceeds twice its source, the excess going to the others by
weight. A source's documents are ordered by key; ranges of the key space
(about ROWS_PER_RANGE documents each) are summed, the prefix sums over the
ranges say in which one the budget ends, and only the documents of that one
range are ordered to find the exact cut. The decision is then a comparison with
the source's cut key, so no document is shuffled, however large its source.
Whole epochs come first; the last, partial one ends within a document if need be.

Defined cases: a null text has size 0; a null source is a source, ordered last;
a null id counts as an empty one in the key; rows with the same id and size
share a key, and the words left at the cut are dealt evenly among them (rounded
down); a source without words has target 0; an empty table gives no rows. Other
columns of the input play no part in plan and taken, whatever their names; mix
keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import common as C

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
ROWS_PER_RANGE = 1024
#: Up to so many sources their table is broadcast; beyond, it is joined by salted source.
BROADCAST_SOURCES = 20_000
_SALTS = 32
_SPOT_BITS, _KEY_BITS = 40, 48


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(C.WORD)), F.lit(0)).cast("long")


def key_of(id_col: str, size: Column) -> Column:
    """48 random bits, the same for equal ids and sizes."""
    told = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(told), 1, _KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: one row a source (source, source_size, n). Adds sid, target, budget, epochs, rest."""
    every = Window.partitionBy()  # one row for each source, aggregated already
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") - 1) % len(weights) + 1)
    t = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    t = t.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(share)
    left = total - F.coalesce(F.sum("most").over(by_room), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0))
    # a unit of weight gets what is left once the sources with less room are full: the largest such quotient
    t = t.withColumn("unit", left / heavy).withColumn("unit", F.max("unit").over(every))
    t = t.withColumn("target", F.least("most", F.col("unit") * F.col("weight")))
    t = t.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    t = t.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    return t.select("source", "sid", "source_size", "n", "target", "epochs", "rest")


def range_of(key: Column, n: Column) -> Column:
    """The part of the key space; a source has one for every ROWS_PER_RANGE documents."""
    parts = F.least(F.ceil(n / F.lit(ROWS_PER_RANGE)), F.lit(1 << 22)).cast("long")
    return F.shiftright(F.shiftright(key, _KEY_BITS - _SPOT_BITS) * parts, _SPOT_BITS)


def with_sources(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows with their source's part of the plan, without moving rows where the plan is small."""
    told = plan.withColumnRenamed("source", "_source")
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(told), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    told = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = rows.withColumn("_salt2", F.pmod(F.col("_key"), F.lit(_SALTS)).cast("int"))
    return rows.join(told, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt2"))).drop("_source", "_salt", "_salt2")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, int]:
    """rows: source, _size, _key of all documents. For each source its target, epochs, cut key and words left for a row there."""
    sizes = rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    told = C.staged(targets(sizes, weights), "targets")
    n_sources = told.count()
    placed = with_sources(rows.select("source", "_size", "_key"), told, n_sources).withColumn("part", range_of(F.col("_key"), F.col("n")))
    parts = placed.groupBy("sid", "part").agg(F.sum("_size").alias("words"))
    parts = parts.withColumn("before", F.sum("words").over(Window.partitionBy("sid").orderBy("part")) - F.col("words"))
    ends = told.select("sid", "rest").join(parts, "sid").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    # at most one range a source: sources that take a part of an epoch
    at_end = C.staged(ends.select(F.col("sid").alias("_sid"), F.col("part").alias("_part"), "before"), "ends")
    inner = placed.join(F.broadcast(at_end) if n_sources <= BROADCAST_SOURCES else at_end, (F.col("sid") == F.col("_sid")) & (F.col("part") == F.col("_part")))
    keys = inner.groupBy("sid", "_key", "before", "rest").agg(F.sum("_size").alias("words"), F.count("*").alias("same"))
    keys = keys.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("sid").orderBy("_key")))
    cut = keys.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    cut = cut.select(F.col("sid").alias("_sid"), F.col("_key").alias("cut"), F.expr("(rest - (upto - words)) div same").alias("at_cut"))
    told = told.join(cut, F.col("sid") == F.col("_sid"), "left").drop("_sid", "sid", "n", "rest")
    return C.staged(told, "plan"), n_sources


def in_part(key: Column) -> Column:
    """Words of the partial epoch that a document gives."""
    return F.when(key < F.col("cut"), F.col("_size")).when(key == F.col("cut"), F.col("at_cut")).otherwise(F.lit(0)).cast("long")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    size = size_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("_size"))
    rows = C.staged(rows.withColumn("_key", key_of("doc_id", F.col("_size"))), "sizes")
    out = with_sources(rows, *plan(rows))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("_size") + in_part(F.col("_key"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: a row for each time a document is taken, the last one of a source cut to its budget.

    A cut text keeps its first words, joined by single spaces.
    """
    names = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_doc"), F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"))
    inner = inner.withColumn("_size", size_of("_text")).withColumn("_key", key_of("_id", F.col("_size")))
    told, n_sources = plan(C.staged(inner.select("source", "_size", "_key"), "sizes"))
    out = with_sources(inner, told, n_sources)
    last = in_part(F.col("_key"))
    more = F.coalesce(F.col("_key") < F.col("cut"), F.lit(False)) | (last > 0)
    times = F.concat(F.array_repeat(F.col("_size"), F.col("epochs").cast("int")), F.when(more, F.array(last)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_take", F.explode(times))
    short = F.array_join(F.slice(F.regexp_extract_all(F.col("_text"), F.lit(C.WORD), F.lit(0)), F.lit(1), F.greatest(F.col("_take"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("_take") < F.col("_size"), short).otherwise(F.col("_text"))
    return out.select(*(text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in names))


def oracle(weights: tuple[int, ...] = WEIGHTS) -> str:
    """The same rows in DuckDB SQL."""
    case = " ".join(f"WHEN {k} THEN {w}.0" for k, w in enumerate(weights))
    digits = _KEY_BITS // 4
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, {digits}))::BIGINT AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
w AS (SELECT *, CASE (sid - 1) % {len(weights)} {case} END AS weight, source_size * {MOST} AS most FROM n),
u AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * {SHARE} - coalesce(sum(most::DOUBLE) OVER o, 0)) / (sum(weight::DOUBLE) OVER () - coalesce(sum(weight::DOUBLE) OVER o, 0)) AS unit
      FROM w WINDOW o AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, sid, source_size, least(most::DOUBLE, max(unit) OVER () * weight::DOUBLE) AS target FROM u),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
g AS (SELECT source, key, sum(size)::BIGINT AS words, count(*) AS same FROM k GROUP BY source, key),
c AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY key))::BIGINT - words AS before FROM g)
SELECT k.doc_id, k.size, b.source_size, b.target,
  (b.epochs * k.size + CASE WHEN c.before + c.words <= b.budget - b.epochs * b.source_size THEN k.size
    WHEN c.before >= b.budget - b.epochs * b.source_size THEN 0
    ELSE (b.budget - b.epochs * b.source_size - c.before) // c.same END)::BIGINT AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.key = c.key"""


