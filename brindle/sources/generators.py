"""Synthetic documents, made by row number: any size, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("notice", "caution", "failure", "detail")
OUTCOMES = (0, 1, 2, 3, 7)
START, STEP = 1_500_000_000_000, 250
#: Words of a message, of this many different ones.
WORDS, VOCABULARY = 24, 300
#: Of a hundred documents so many have the field, if fields are sparse.
SHARES = {"duration_ms": 80, "size": 65, "level": 90, "outcome": 10}


def _random(seed: int, below: int, *more: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), *more), F.lit(below))


def _words(seed: int, n: int, vocabulary: int) -> Column:
    """n words, of which those with small numbers are frequent."""
    def word(k: Column) -> Column:
        share = _random(seed, 1 << 20, k) / F.lit(float(1 << 20))
        return F.concat(F.lit("term"), F.floor(share * share * vocabulary).cast("string"))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), word), " ")


def _one_of(values: tuple, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_random(seed, len(values)) + 1).cast("int"))


def logs(spark: SparkSession, n: int, sparse: bool = False, seed: int = 1) -> DataFrame:
    """doc_id, timestamp, level, trace_id, message, duration_ms, size, outcome. sparse: fields that only some documents have."""
    rows = spark.range(n).withColumnRenamed("id", "doc_id").select(
        "doc_id",
        (F.lit(START) + F.col("doc_id") * STEP + _random(seed, STEP)).alias("timestamp"),
        _one_of(LEVELS, seed + 1).alias("level"),
        F.sha1(F.concat(F.lit(f"{seed}/"), F.col("doc_id").cast("string"))).alias("trace_id"),
        _words(seed + 2, WORDS, VOCABULARY).alias("message"),
        _random(seed + 3, 5_000).alias("duration_ms"),
        _random(seed + 4, 1 << 22).alias("size"),
        _one_of(OUTCOMES, seed + 5).cast("long").alias("outcome"),
    )
    if sparse:
        rows = rows.withColumns({c: F.when(_random(seed + 10 + k, 100) < share, F.col(c)) for k, (c, share) in enumerate(SHARES.items())})
    return rows


def texts(spark: SparkSession, n: int, n_bytes: int, seed: int = 1) -> DataFrame:
    """doc_id and a message of about so many bytes."""
    return spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", _words(seed, max(1, n_bytes // 8), 10 * VOCABULARY).alias("message"))


def json_lines(spark: SparkSession, n: int) -> DataFrame:
    """value: JSON lines with a key that schemas don't name."""
    rows = logs(spark, n).select("timestamp", "level", "trace_id", "message", "duration_ms", F.concat(F.lit("extra"), F.col("doc_id").cast("string")).alias("unnamed"))
    return rows.select(F.to_json(F.struct("*")).alias("value"))
