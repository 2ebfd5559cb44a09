"""Helpers shared by the training-data operators: staging, bounded samples, text codes.

Nothing here collects an unbounded result: samples are bounded by documented
parameters, staged tables live in the folder that all executors share.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.shipping import ready, shared_dir  # noqa: F401
from brindle.functions.shipping import spread as on_all_cores  # noqa: F401

#: Words, everywhere in this package: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Small partitions are merged up to the advised size, for staged tables to have few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at its end, but those given to the function that it yields.

    Only for work whose results are written or collected inside: others would read what is gone.
    """
    before, kept = len(_staged), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    yield keep
    inside = _staged[before:]
    _staged[before:] = [x for x in inside if x[1] in kept]
    for spark, path in inside:
        if path not in kept:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def sweep() -> None:
    """Delete all staged tables; a long session may call it when it has used its results."""
    while _staged:
        try:
            _delete(*_staged.pop())
        except Exception:  # the JVM may be gone already
            return


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def class_sample(rows: DataFrame, key: str, label: str, per_class: int, seed: int, most: int = 1 << 62) -> tuple[DataFrame, int]:
    """About per_class rows of each label value, chosen by a hash of the key, and at most how many there may be.

    rows: key and label columns, null in neither. With very many labels fewer
    rows of each are chosen, for the sample to stay at about `most` rows; none
    is left out. The counts are over all rows, a row a label is collected;
    choosing needs no shuffle and gives the same rows on every run.
    """
    counts = rows.groupBy(label).count().collect()
    per_class = max(16, min(per_class, most // max(1, len(counts))))  # of so many a hash hardly leaves out all
    space = 1 << 30
    limits = [x for value, n in counts for x in (F.lit(value), F.lit(min(space, int(space * per_class / n) + 1)))]
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(space))
    chosen = rows.where(spot < F.try_element_at(F.create_map(*limits), F.col(label))) if limits else rows.where(F.lit(False))
    return chosen, 4 * per_class * max(1, len(counts))


def text_chunks(text: str, size: int, overlap: int):
    """Pieces of at most size characters that share overlap characters with the next."""
    if len(text) <= size:
        yield text
        return
    for at in range(0, len(text) - overlap, size - overlap):
        yield text[at : at + size]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def spread(h: np.ndarray, bits: int) -> np.ndarray:
    """uint32 hashes mixed and cut to the given number of bits, as int32 for indexing."""
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def gram_ids(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed ids of all runs of n codes."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32)
    h = np.full(m, (0x9E3779B1 * n) & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= codes[k : k + m]
    return spread(h, bits)


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 15), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 20:
            _powers[name] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _hash_words(data: np.ndarray) -> np.ndarray:
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    turn = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = turn[::2], turn[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(data), "p"), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power(_P_INV, len(data), "i")[starts])


def word_hashes(text: str, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words of the text, in order; equal on every machine."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= piece:
        return _hash_words(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(out)


_MIX = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """64-bit hashes of all runs of n words, in order."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = h * _MIX[k % 5] + words[k : k + m]
        h ^= h >> np.uint64(29)
    return mix64(h)
