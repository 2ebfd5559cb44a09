"""A shard of points as a versioned table, and the work on closed shards."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import metrics
from brindle.sources.store import Writer, open_snapshot

POINTS = T.StructType([T.StructField("metric_name", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("part", T.IntegerType())])


class Shard:
    """Points are buffered, flushed (seen by this object), and committed (seen by readers).

    With max_series or max_total_points the buffer is flushed by a write that
    takes it above either.
    """

    def __init__(self, spark: SparkSession, path: str, append: bool = False, max_series: int | None = None, max_total_points: int | None = None) -> None:
        self.spark, self.path, self.max_series, self.max_total_points = spark, path, max_series, max_total_points
        self.writer = Writer(spark, path, POINTS, append=append)
        self.part = len(self.writer.committed)

    def write_points(self, pts: DataFrame) -> None:
        """metric_name, labels, ts_ms, value of any number of series, and seq if the order of arrival is known."""
        seq = F.col("seq") if "seq" in pts.columns else F.monotonically_increasing_id()
        self.writer.add(pts.select("metric_name", "labels", F.col("ts_ms").cast("long"), F.col("value").cast("double"), seq.cast("long").alias("seq"), F.lit(self.part).alias("part")))
        if self.full():
            self.flush()

    def write_point(self, name: str, labels: str, ts_ms: int, value: float) -> None:
        self.write_series(name, labels, [(ts_ms, value)])

    def write_series(self, name: str, labels: str, points: list[tuple[int, float]]) -> None:
        """Points of one series, in the order of arrival."""
        self.write_many([(name, labels, t, v) for t, v in points])

    def write_many(self, points: list[tuple[str, str, int, float]]) -> None:
        """Points of several series, in the order of arrival."""
        before = self.part
        self.write_points(self.spark.createDataFrame([(*p, k) for k, p in enumerate(points)], "metric_name string, labels string, ts_ms long, value double, seq long"))
        self.part += self.part == before

    def full(self) -> bool:
        """Whether the buffer is above a limit."""
        if self.max_series is None and self.max_total_points is None or not self.writer.buffered:
            return False
        series = reduce(DataFrame.unionByName, self.writer.buffered).groupBy(*metrics.SERIES).agg(F.count("*").alias("n"))
        got = series.agg(F.count("*").alias("series"), F.coalesce(F.sum("n"), F.lit(0)).alias("points")).first()
        return any(most is not None and n > most for n, most in ((got.series, self.max_series), (got.points, self.max_total_points)))

    def flush(self) -> None:
        self.writer.flush()
        self.part += 1

    def commit(self) -> int:
        self.flush()
        return self.writer.commit()

    def close(self) -> int | None:
        """Commit what isn't committed yet; the shard takes no more points."""
        version = self.commit() if self.writer.buffered or self.writer.staged else None
        self.writer = None
        return version

    def points(self) -> DataFrame:
        return self.writer.live()


def read(spark: SparkSession, path: str) -> DataFrame:
    return open_snapshot(spark, path)


def ordered_points(shards: list[DataFrame]) -> DataFrame:
    """Points of several shards with the shard's number; earlier shards win at equal times."""
    numbered = [s.withColumn("shard", F.lit(k)) for k, s in enumerate(shards)]
    return reduce(DataFrame.unionByName, numbered).withColumn("seq", F.struct("part", "seq"))


def merge_intra(spark: SparkSession, path: str, out: str) -> metrics.MergeStats:
    """A shard's points deduplicated into a new shard, ordered by series and time."""
    pts = ordered_points([read(spark, path)])
    metrics.by_time(metrics.merged(pts)).write.mode("errorifexists").parquet(out)
    return metrics.merge_stats(pts, spark.read.parquet(out))


def merge_cross(spark: SparkSession, paths: list[str], out: str) -> tuple[dict[str, DataFrame], metrics.MergeStats]:
    """Several shards into compact, 5m and 1h tables."""
    pts = ordered_points([read(spark, p) for p in paths])
    tables = metrics.merge_shards(pts, out)
    return tables, metrics.merge_stats(pts, tables["compact"])


@dataclass(frozen=True)
class DownsampleStats:
    """A document is a series of one flush."""

    input_docs: int
    output_docs: int
    input_points: int


def downsample(spark: SparkSession, path: str, out: str, gran_ms: int) -> tuple[DataFrame, DownsampleStats]:
    """Buckets of a shard's points as they are, a row for each series, flush and bucket; and how much went in and out."""
    pts = read(spark, path)
    metrics.downsampled(pts, gran_ms, ("part",)).write.mode("errorifexists").parquet(out)
    made = spark.read.parquet(out)
    count = lambda rows, n: rows.groupBy(*metrics.SERIES, "part").agg(n.alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    (input_docs, input_points), (output_docs, _) = count(pts, F.count("*")), count(made, F.count("*"))
    return made, DownsampleStats(input_docs, output_docs, input_points)
