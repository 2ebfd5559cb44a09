"""Ingest and downsampling of streams, and search over committed and arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.metrics import SERIES
from brindle.operators.search import Searcher
from brindle.plans.schema import Schema
from brindle.sources.store import Writer, open_snapshot


def ingest(stream: DataFrame, path: str, checkpoint: str, schema_of: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is a commit of the table at path; a batch that is run again commits once."""
    spark, struct = stream.sparkSession, (schema_of or stream).schema

    def commit(rows: DataFrame, batch: int) -> None:
        writer = Writer(rows.sparkSession, path, struct, append=True)
        writer.add(rows)
        writer.commit(batch, checkpoint)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live(path: str, arriving: DataFrame) -> DataFrame:
    """The last committed version and documents that aren't committed yet."""
    return open_snapshot(arriving.sparkSession, path).unionByName(arriving)


def live_searcher(path: str, arriving: DataFrame, schema: Schema, id_col: str = "doc_id") -> Searcher:
    return Searcher(live(path, arriving), schema, id_col)


def downsampled(stream: DataFrame, gran: str = "5 minutes", lateness: str | None = None) -> DataFrame:
    """Streaming buckets of points (metric_name, labels, ts_ms, value). Without a lateness every late point counts, and state is kept for all buckets."""
    number = F.when(~F.isnan("value"), F.col("value"))
    rows = stream.withColumn("_ts", F.timestamp_millis("ts_ms"))
    rows = rows.withWatermark("_ts", lateness) if lateness else rows
    out = rows.groupBy(*SERIES, F.window("_ts", gran).alias("w")).agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.min(number).alias("min"), F.max(number).alias("max"), F.min_by("value", "ts_ms").alias("_first"), F.max_by("value", "ts_ms").alias("_last"))
    delta = F.when(F.col("_last") < F.col("_first"), F.col("_last")).otherwise(F.col("_last") - F.col("_first"))
    return out.select(*SERIES, F.unix_millis("w.start").alias("bucket_time"), "count", "sum", "min", "max", delta.alias("delta"))


def into_table(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end into files, a folder for each trigger; in complete mode the last one is the result."""
    spark, done = stream.sparkSession, []

    def write(rows: DataFrame, batch: int) -> None:
        name = f"{path}/rows-{batch}"
        rows.write.mode("overwrite").parquet(name)  # a trigger that is run again replaces what it wrote
        done[:] = [name] if mode == "complete" else [*done, name]

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(*done) if done else spark.createDataFrame([], stream.schema)


def into_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end into a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
