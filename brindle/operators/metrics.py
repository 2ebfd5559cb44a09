"""Time series: points in, deduplicated series, downsampled buckets out.

Points are long rows: metric_name, labels (a label string), ts_ms, value, and
for merges shard and seq, the order of arrival.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.labels import labels_str

SERIES = ("metric_name", "labels")
FIVE_MINUTES, ONE_HOUR, ONE_DAY = 300_000, 3_600_000, 86_400_000


def points(rows: DataFrame, name: Column, labels: Column, ts_ms: Column, value: Column, shard: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Rows as points. labels: a map, or a label string already."""
    text = labels_str(labels) if rows.select(labels).schema[0].dataType.typeName() == "map" else labels
    extra = ([shard.cast("int").alias("shard")] if shard is not None else []) + ([seq.cast("long").alias("seq")] if seq is not None else [])
    return rows.select(name.alias("metric_name"), text.alias("labels"), ts_ms.cast("long").alias("ts_ms"), value.cast("double").alias("value"), *extra)


def bucket_of(ts_ms: Column, gran_ms: int) -> Column:
    """The start of the bucket, rounding towards zero."""
    return ts_ms - ts_ms % F.lit(gran_ms)


def packed(pts: DataFrame, chunk_ms: int = ONE_DAY) -> DataFrame:
    """A row for a series and a stretch of time: first and last time, the number of points, and the points in time order.

    The stretch bounds a row, however long the series.
    """
    rows = pts.groupBy(*SERIES, bucket_of(F.col("ts_ms"), chunk_ms).alias("chunk"))
    samples = F.array_sort(F.collect_list(F.struct(F.col("ts_ms").alias("t"), F.col("value").alias("v"))))
    return rows.agg(F.min("ts_ms").alias("time_min"), F.max("ts_ms").alias("time_max"), F.count("*").alias("sample_count"), samples.alias("samples")).drop("chunk")


def unpacked(series: DataFrame) -> DataFrame:
    return series.select(*SERIES, F.explode("samples").alias("s")).select(*SERIES, F.col("s.t").alias("ts_ms"), F.col("s.v").alias("value"))


def series_stats(pts: DataFrame) -> DataFrame:
    return pts.groupBy(*SERIES).agg(F.min("ts_ms").alias("time_min"), F.max("ts_ms").alias("time_max"), F.count("*").alias("sample_count"))


def merged(pts: DataFrame, order: tuple[str, ...] = ("shard", "seq")) -> DataFrame:
    """Each series' first point at a time, by shard and arrival; later ones at the same time go, within a task before anything is shuffled."""
    first = F.min_by("value", F.struct(*order))
    return pts.groupBy(*SERIES, "ts_ms").agg(first.alias("value"))


@dataclass(frozen=True)
class MergeStats:
    input_docs: int
    output_docs: int
    input_points: int
    output_points: int
    merged_groups: int


def merge_stats(pts: DataFrame, after: DataFrame, part: str = "part") -> MergeStats:
    """part: the flush a point came with; a document is a series of one flush of one shard."""
    docs = pts.groupBy(*SERIES, "shard", part).agg(F.count("*").alias("n")).groupBy(*SERIES).agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    a = docs.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("docs") > 1)).first()
    return MergeStats(a[0], a[1], a[2], after.count(), a[3])


def downsampled(pts: DataFrame, gran_ms: int, apart: tuple[str, ...] = ()) -> DataFrame:
    """count, sum, min, max and delta of every bucket of every series; points that differ in `apart` don't share a bucket.

    delta is last minus first in time, or last alone after a counter's reset.
    NaN counts in sums but not in min and max, which are null if there is
    nothing else. point_max is the last time in the bucket.
    """
    number = F.when(~F.isnan("value"), F.col("value"))
    rows = pts.groupBy(*SERIES, *apart, bucket_of(F.col("ts_ms"), gran_ms).alias("bucket_time")).agg(
        F.count("*").alias("count"),
        F.sum("value").alias("sum"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.min_by("value", "ts_ms").alias("_first"),
        F.max_by("value", "ts_ms").alias("_last"),
        F.max("ts_ms").alias("point_max"),
    )
    delta = F.when(F.col("_last") < F.col("_first"), F.col("_last")).otherwise(F.col("_last") - F.col("_first"))
    return rows.select(*SERIES, *apart, F.lit(gran_ms).cast("long").alias("gran_ms"), "bucket_time", "count", "sum", "min", "max", delta.alias("delta"), "point_max")


def rolled_up(buckets: DataFrame, gran_ms: int) -> DataFrame:
    """Buckets to coarser ones: counts, sums and deltas add up."""
    rows = buckets.groupBy(*SERIES, bucket_of(F.col("bucket_time"), gran_ms).alias("bucket_time"))
    out = rows.agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("delta").alias("delta"), F.max("point_max").alias("point_max"))
    return out.select(*SERIES, F.lit(gran_ms).cast("long").alias("gran_ms"), "bucket_time", "count", "sum", "min", "max", "delta", "point_max")


def by_time(pts: DataFrame) -> DataFrame:
    """Points ordered by series and time, over ranges of both: a hot series has as many as it needs."""
    return pts.repartitionByRange(*SERIES, "ts_ms").sortWithinPartitions(*SERIES, "ts_ms")


def merge_shards(pts: DataFrame, path: str) -> dict[str, DataFrame]:
    """Points of several shards, deduplicated once and written; both granularities are made from what was written."""
    spark = pts.sparkSession
    by_time(merged(pts)).write.mode("errorifexists").parquet(f"{path}/compact")
    out = {"compact": spark.read.parquet(f"{path}/compact")}
    for name, gran in (("5m", FIVE_MINUTES), ("1h", ONE_HOUR)):
        downsampled(out["compact"], gran).write.mode("errorifexists").parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def series_of(pts: DataFrame) -> DataFrame:
    """The series that occur."""
    return pts.select(*SERIES).distinct()


@dataclass
class ShardMetadata:
    """What is known about a shard, as a JSON manifest with camel-case keys; empty lists and unknown values are left out."""

    org_id: str
    date: str
    shard_id: int
    total_samples: int = 0
    series_count: int = 0
    min_time: int = 0
    max_time: int = 0
    size_bytes: int = 0
    sealed: bool = False
    merged: bool = False
    resolution: str = "raw"
    downsample_done: bool = False
    level: str = "L0"
    state: str = "ACTIVE"
    write_start_time: int = 0
    write_end_time: int = 0
    series_hll: str = ""
    series_estimate: int = 0
    merged_from: tuple[int, ...] = ()
    source_shard_ids: tuple[int, ...] = ()
    covered_shard_ids: tuple[int, ...] = ()
    covered_by: int | None = None
    covered_at: int | None = None
    source_size_bytes: int | None = None
    source_shard_count: int | None = None
    source_series_estimate: int | None = None
    created_at: int = 0
    updated_at: int = 0

    def to_json(self) -> str:
        camel = lambda n: n.split("_")[0] + "".join(x.title() for x in n.split("_")[1:])
        return json.dumps({camel(k): list(v) if isinstance(v, tuple) else v for k, v in vars(self).items() if v is not None and v != ()}, indent=2)

    @staticmethod
    def from_json(text: str) -> ShardMetadata:
        import re

        got = {re.sub("[A-Z]", lambda m: "_" + m[0].lower(), k): tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}
        return ShardMetadata(**got)

    def with_series(self, registers: dict[int, int]) -> ShardMetadata:
        """Remember a sketch of the series and its estimate."""
        import base64
        import math

        from brindle.functions import hll

        self.series_hll = base64.b64encode(hll.to_bytes(registers)).decode()
        self.series_estimate = math.ceil(hll.estimated(registers))
        return self

    def with_points(self, pts: DataFrame) -> ShardMetadata:
        """Counts and times of the shard's points."""
        n, low, high = pts.agg(F.count("*"), F.min("ts_ms"), F.max("ts_ms")).first()
        self.total_samples, self.min_time, self.max_time = n, low or 0, high or 0
        self.series_count = series_of(pts).count()
        return self


def write_metadata(spark, path: str, told: ShardMetadata) -> None:
    _overwrite(spark, f"{path}/metadata.json", told.to_json())


def read_metadata(spark, path: str) -> ShardMetadata:
    return ShardMetadata.from_json(spark.read.text(f"{path}/metadata.json", wholetext=True).first()[0])


def _overwrite(spark, name: str, text: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()
