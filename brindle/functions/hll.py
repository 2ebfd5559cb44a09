"""HyperLogLog with 4096 registers of four bits, as aggregations; and built-in sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers by the low 12 bits of a hash, ranks up to 15.
LOG_K, TOP_RANK = 12, 15
K = 1 << LOG_K


def register(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(K - 1).cast("long")).cast("int")


def rank(hashed: Column) -> Column:
    """Place of the first one among the 52 high bits, 53 without one, at most TOP_RANK."""
    rest = F.shiftrightunsigned(hashed, LOG_K)
    width = F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    return F.least(F.lit(64 - LOG_K + 1) - width, F.lit(TOP_RANK))


def registers(rows: DataFrame, hashed: Column, *keys: str) -> DataFrame:
    """One row for each register met: keys, reg, rho. Unions are unions of such rows, aggregated again."""
    return rows.select(*keys, register(hashed).alias("reg"), rank(hashed).alias("rho")).groupBy(*keys, "reg").agg(F.max("rho").alias("rho"))


def union(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.unionByName(right).groupBy(*keys, "reg").agg(F.max("rho").alias("rho"))


def estimate(regs: DataFrame, *keys: str) -> DataFrame:
    """The number of distinct hashes by keys; linear counting where few registers are set."""
    total = F.lit(float(K)) - F.count("*") + F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho").cast("double"))), F.lit(0.0))
    raw = F.lit(0.7213 / (1 + 1.079 / K) * K * K) / total
    empty = F.lit(K) - F.count("*")
    small = F.lit(float(K)) * F.log(F.lit(float(K)) / F.nullif(empty, F.lit(0)))
    return regs.groupBy(*keys).agg(F.when((raw <= 2.5 * K) & (empty > 0), small).otherwise(raw).alias("estimate"))


def to_bytes(values: dict[int, int]) -> bytes:
    """Registers packed two a byte, the lower one in the low half, behind a byte with LOG_K."""
    out = bytearray([LOG_K]) + bytearray(K // 2)
    for reg, rho in values.items():
        out[1 + reg // 2] |= rho << (4 * (reg % 2))
    return bytes(out)


def from_bytes(data: bytes) -> dict[int, int]:
    if len(data) < 1 + K // 2 or data[0] != LOG_K:
        raise ValueError("not a sketch of this size")
    both = ((2 * k + half, (b >> 4 * half) & 15) for k, b in enumerate(data[1 : 1 + K // 2]) for half in (0, 1))
    return {reg: rho for reg, rho in both if rho}


def estimated(values: dict[int, int]) -> float:
    """The estimate of collected registers."""
    total = K - len(values) + math.fsum(2.0**-r for r in values.values())
    raw = 0.7213 / (1 + 1.079 / K) * K * K / total
    return K * math.log(K / (K - len(values))) if raw <= 2.5 * K and len(values) < K else raw
