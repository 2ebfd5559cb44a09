"""The table of terms, and what it says about the corpus."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.shipping import ready, shared_dir, spread
from brindle.functions.tokens import pieces
from brindle.plans.schema import Schema

_TERMS = re.compile(r"[^ \t\n\f\r]+")


def _by_document(tokenized: bool, field: str):
    """For mapInArrow over ids and values: a row for each term of a document, without a shuffle, since a document is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, owners, ends, flat = [], [], [0], []
            for k, value in enumerate(b.column(1).to_pylist()):
                places: dict[str, list[int]] = {}
                for n, text in enumerate(value if isinstance(value, list) else (value,)):
                    if text is not None:
                        for i, t in enumerate(_TERMS.findall(text) if tokenized else (text,), n << 32):
                            places.setdefault(t, []).append(i)
                terms += places
                owners += [k] * len(places)
                for at in places.values():
                    flat += at
                    ends.append(len(flat))
            offsets = np.array(ends, np.int32)
            positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
            arrays = [pa.array([field] * len(terms), pa.string()), pa.array(terms, pa.string()), b.column(0).take(pa.array(owners, pa.int32())), pa.array(np.diff(offsets).astype(np.int64)), positions]
            yield pa.RecordBatch.from_arrays(arrays, ["field", "term", "id", "freq", "positions"])

    return run


def postings(docs: DataFrame, schema: Schema, id_col: str = "doc_id", only: list[str] | None = None) -> DataFrame:
    """field, term, id, freq, positions, of documents with unique ids. Positions of different values are further apart than any phrase reaches."""
    ready(docs.sparkSession)
    id_type, parts = docs.schema[id_col].dataType.simpleString(), []
    for spec in schema.fields.values():
        if not spec.indexed or spec.name not in docs.columns or (only and spec.name not in only):
            continue
        col = F.col(spec.name)
        rows = docs.where(col.isNotNull()).select(F.col(id_col).alias("id"), col.alias("value"))
        rows = spread(rows) if spec.tokenized else rows
        if not spec.tokenized and not isinstance(docs.schema[spec.name].dataType, T.ArrayType):
            parts.append(rows.select(F.lit(spec.name).alias("field"), F.col("value").alias("term"), "id", F.lit(1).cast("long").alias("freq"), F.array(F.lit(0).cast("long")).alias("positions")))
        else:
            parts.append(rows.mapInArrow(_by_document(spec.tokenized, spec.name), f"field string, term string, id {id_type}, freq long, positions array<long>"))
    if not parts:
        raise ValueError("no indexed field")
    return reduce(DataFrame.unionByName, parts)


def write_postings(table: DataFrame, path: str) -> None:
    """Sorted by field and term, so that the reader's statistics leave out what a query doesn't ask for."""
    table.repartitionByRange("field", "term", "id").sortWithinPartitions("field", "term", "id").write.mode("errorifexists").parquet(path)


def term_stats(docs: DataFrame, schema: Schema, only: list[str] | None = None) -> DataFrame:
    """field, term, df (documents, a row each), ttf (occurrences)."""
    parts = []
    for spec in schema.fields.values():
        if not spec.indexed or spec.name not in docs.columns or (only and spec.name not in only):
            continue
        col, many = F.col(f"`{spec.name}`"), isinstance(docs.schema[spec.name].dataType, T.ArrayType)
        values = F.filter(col, lambda v: v.isNotNull()) if many else col
        if spec.tokenized:
            values = F.flatten(F.transform(values, pieces)) if many else pieces(values)
        elif not many:
            values = F.array(values)
        rows = spread(docs.select(col)).select(values.alias("_found"))
        # every occurrence, and every term of a document once: sums in each task, then one small shuffle
        every, once = (rows.select(F.explode(x).alias("term"), F.lit(n).alias("df"), F.lit(1 - n).alias("ttf")) for x, n in (("_found", 0), (F.array_distinct("_found"), 1)))
        parts += [x.where(F.col("term") != "" if spec.tokenized else F.col("term").isNotNull()).select(F.lit(spec.name).alias("field"), "term", "df", "ttf") for x in (every, once)]
    if not parts:
        raise ValueError("no indexed field")
    return reduce(DataFrame.unionByName, parts).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))


def stats_of(table: DataFrame) -> DataFrame:
    """The same from postings."""
    return table.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("freq").alias("ttf"))


def dictionary(stats: DataFrame, field: str, start: str = "") -> DataFrame:
    """The terms of a field from `start` on, in byte order."""
    return stats.where((F.col("field") == field) & (F.col("term") >= start)).orderBy("term")


#: Rows of a range that is ordered in one task, about.
ROWS_PER_RANGE = 100_000


def sorted_dictionary(docs: DataFrame, field: str, ranges: int = 0) -> DataFrame:
    """The distinct values of a field in byte order with their ordinals, which are sums over ranges of values."""
    values = docs.where(F.col(field).isNotNull()).select(F.col(field).alias("value")).distinct()
    return placed(values, [F.col("value").asc()], "ord", ranges, ROWS_PER_RANGE)


def placed(rows: DataFrame, order: list[Column], name: str, ranges: int, per_range: int) -> DataFrame:
    """rows with their place in an order, from 0 on: the rows are dealt to ranges, as many as the table asks for, and written;
    a place is the place in the range after the sizes of the ranges before, so that no task orders all rows."""
    spark = rows.sparkSession
    n = ranges or max(1, -(-rows.count() // per_range))
    path = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row a range
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_in", inner).join(before, "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_before")


def point_stats(docs: DataFrame, schema: Schema) -> DataFrame:
    """field, min, max, docs of every field with points."""
    fields = [f.name for f in schema.fields.values() if f.points and f.name in docs.columns]
    if not fields:
        raise ValueError("no field with points")
    one = [bounds(docs.select(F.col(f"`{n}`").alias("_v")), "_v").select(F.lit(n).alias("field"), F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), "docs") for n in fields]
    return reduce(DataFrame.unionByName, one)


def bounds(docs: DataFrame, field: str) -> DataFrame:
    """min, max, docs of a numeric field."""
    col = F.col(field)
    if isinstance(docs.schema[field].dataType, T.ArrayType):
        return docs.agg(F.min(F.array_min(col)).alias("min"), F.max(F.array_max(col)).alias("max"), F.count_if(F.size(col) > 0).alias("docs"))
    return docs.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("docs"))
