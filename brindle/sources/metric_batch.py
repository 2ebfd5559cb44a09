"""Binary batches of points: little-endian length and bytes of name and labels, time, value; a record cut short ends a batch."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.functions.shipping import ship

_SCHEMA = "metric_name string, labels string, ts_ms long, value double, seq long"


def encode(points) -> bytes:
    out = bytearray()
    for name, labels, t, v in points:
        for text in (name.encode(), labels.encode()):
            out += struct.pack("<H", len(text)) + text
        out += struct.pack("<qd", t, v)
    return bytes(out)


def decode(data: bytes) -> Iterator[tuple[str, str, int, float]]:
    at = 0
    while True:
        texts = []
        for _ in range(2):
            if at + 2 > len(data):
                return
            n = int.from_bytes(data[at : at + 2], "little")
            if at + 2 + n > len(data):
                return
            texts.append(data[at + 2 : at + 2 + n].decode("utf-8", "replace"))
            at += 2 + n
        if at + 16 > len(data):
            return
        yield (*texts, *struct.unpack_from("<qd", data, at))
        at += 16


def encoded(points: DataFrame) -> DataFrame:
    """content: points as batches, of as many points as an Arrow batch has."""
    ship(points.sparkSession)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if b.num_rows:
                content = encode(zip(*(c.to_pylist() for c in b.columns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    return points.select("metric_name", "labels", "ts_ms", "value").mapInArrow(batches, "content binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Points of all batch files under a path; seq counts within a file."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def decoded(rows: DataFrame) -> DataFrame:
    """Points of the batches in the column content; seq counts within a batch."""
    ship(rows.sparkSession)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [(*p, k) for k, p in enumerate(decode(content.as_py() or b""))]
                if rows:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["metric_name", "labels", "ts_ms", "value", "seq"])

    return rows.select("content").mapInArrow(points, _SCHEMA)
