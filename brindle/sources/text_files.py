"""Text files and folders of them as documents, a line each. Large files are read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points up to the blank are trimmed from lines.
_EDGE = r"^[\x{0}-\x{20}]+|[\x{0}-\x{20}]+$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """message, source, split, line of every line that isn't empty and is UTF-8.

    Lines are numbered within a file from 1, counting those left out: a line's
    number is its place in its split of the file, after the lines of the splits
    before, so that only the lines of one split are ordered together.
    """
    rows = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    rows = rows.select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_seq"))
    sizes = rows.groupBy("source", "split").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("source").orderBy("split")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("source", "split").orderBy("_seq"))
    lines = rows.withColumn("_place", place).join(before, ["source", "split"])
    fine = F.is_valid_utf8("value")
    message = F.regexp_replace(F.when(fine, F.col("value")).otherwise(""), _EDGE, "")
    return lines.select(message.alias("message"), "source", "split", (F.col("_before") + F.col("_place")).cast("long").alias("line")).where(F.col("message") != "")


def numbered(rows: DataFrame, start: int = 0) -> DataFrame:
    """doc_id, message, source, line in the order of files and lines. Offsets are sums over splits of files."""
    sizes = rows.groupBy("source", "split").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(Window.orderBy("source", "split")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("source", "split").orderBy("line")) - 1
    return rows.withColumn("_place", place).join(before, ["source", "split"]).select((F.col("_place") + F.col("_before") + start).cast("long").alias("doc_id"), "message", "source", "line")


def cycled(rows: DataFrame, n: int) -> DataFrame:
    """Numbered rows repeated from the first on until there are n."""
    size = rows.count()
    if not size:
        return rows
    times = -(-n // size)
    more = rows.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return more.withColumn("doc_id", F.col("doc_id") + F.col("_round") * F.lit(size)).drop("_round").where(F.col("doc_id") < n)
