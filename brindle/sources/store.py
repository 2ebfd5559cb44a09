"""A versioned table: immutable segments of Parquet files, and manifests that list them.

A commit writes its manifest under another name and renames it to the next
version, which fails if a writer was faster; readers see whole versions only.
All files go through Hadoop's file system. Where a rename isn't atomic or doesn't
fail for a name that exists, as in plain object stores, one writer at a time is
safe and two that commit at once are not.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.terms import placed


class Store:
    """The folder of a table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found or version is not None and version not in found:
            raise FileNotFoundError(f"{self.path}: no committed version" + (f" {version}" if version is not None else ""))
        at = found[-1] if version is None else version
        return json.loads(self._read(f"versions/v{at:09d}.json")) | {"version": at}

    def write_segment(self, rows: DataFrame) -> str:
        name = f"segments/{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return name

    def commit(self, segments: list[dict], schema: str, after: int, extra: dict | None = None) -> int:
        """The version after `after`. Raises FileExistsError if another writer has made it."""
        self._fs.mkdirs(self._path("versions"))
        pending = f"versions/pending-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(pending), False)
        stream.write(bytearray(json.dumps({"segments": segments, "schema": schema, **(extra or {})}).encode()))
        stream.close()
        target = self._path(f"versions/v{after + 1:09d}.json")
        if self._fs.exists(target) or not self._fs.rename(self._path(pending), target):
            self._fs.delete(self._path(pending), False)
            raise FileExistsError(f"{self.path}: version {after + 1} exists")
        return after + 1

    def segments(self, listed: list[dict], schema: str) -> DataFrame:
        struct = T.StructType.fromJson(json.loads(schema))
        if not listed:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(*(f"{self.path}/{s['name']}" for s in listed))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def _schema_text(struct: T.StructType) -> str:
    """The schema as a manifest has it: names and types; anything may be missing, as in files."""
    text = json.dumps(json.loads(struct.json()), sort_keys=True)
    return text.replace('"nullable": false', '"nullable": true').replace('"containsNull": false', '"containsNull": true').replace('"valueContainsNull": false', '"valueContainsNull": true')


def open_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The documents of a committed version, the last one if none is named."""
    store = Store(spark, path)
    told = store.manifest(version)
    return store.segments(told["segments"], told["schema"])


#: Bytes of a file of a merged segment, about.
MERGED_BYTES = 512 << 20


class Writer:
    """Adds documents: flushed segments are seen by this writer alone until they are committed."""

    def __init__(self, spark: SparkSession, path: str, struct: T.StructType, append: bool = False, sort: tuple[str, bool, bool] | None = None, id_col: str = "doc_id", max_buffered: int | None = None, max_bytes: int | None = None) -> None:
        """sort: a field, whether descending, whether missing values come first.

        max_buffered and max_bytes: what is added is flushed once so many documents
        (counted, where the caller doesn't say how many) or bytes (as Spark
        estimates them) are buffered.
        """
        self.store = Store(spark, path)
        self.struct, self.schema, self.sort, self.id_col = struct, _schema_text(struct), sort, id_col
        found = self.store.versions()
        if found and not append:
            raise FileExistsError(f"{path}: the table exists")
        self.version = found[-1] if found else 0
        told = self.store.manifest() if found else {"segments": [], "schema": self.schema}
        if json.loads(told["schema"]) != json.loads(self.schema):
            raise ValueError("the table has another schema")
        self.committed, self.staged = told["segments"], []
        self.batches: dict[str, int] = told.get("batches", {})
        self.buffered: list[DataFrame] = []
        self.max_buffered, self.max_bytes, self.documents, self.bytes = max_buffered, max_bytes, 0, 0

    def add(self, rows: DataFrame, n: int | None = None) -> None:
        rows = rows.select(*self.struct.names)
        self.buffered.append(rows)
        if self.max_buffered is not None:
            self.documents += rows.count() if n is None else n
        if self.max_bytes is not None:
            self.bytes += int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if self.max_buffered is not None and self.documents >= self.max_buffered or self.max_bytes is not None and self.bytes >= self.max_bytes:
            self.flush()

    def flush(self) -> None:
        self.documents = self.bytes = 0
        for rows in self.buffered:
            rows = ordered(rows, self.sort, self.id_col) if self.sort else rows
            self.staged.append({"name": self.store.write_segment(rows)})
        self.buffered = []

    def commit(self, batch: int | None = None, stream: str = "") -> int:
        """With a batch number of a stream, whose numbers grow, a second commit of the same or an earlier batch changes nothing."""
        if batch is not None and batch <= self.batches.get(stream, -1):
            self.buffered, self.staged = [], []
            return self.version
        self.flush()
        batches = self.batches | ({stream: batch} if batch is not None else {})
        self.version = self.store.commit(self.committed + self.staged, self.schema, self.version, {"batches": batches})
        self.committed, self.staged, self.batches = self.committed + self.staged, [], batches
        return self.version

    def live(self) -> DataFrame:
        """Committed, flushed and buffered documents."""
        rows = self.store.segments(self.committed + self.staged, self.schema)
        for more in self.buffered:
            rows = rows.unionByName(more)
        return rows

    def force_merge(self, files: int | None = None) -> int:
        """All segments into one, of `files` files or else of one for each MERGED_BYTES; the old ones go once the new version
        stands. An empty table stays as it is."""
        self.flush()
        old = self.committed + self.staged
        if not old:
            return self.version
        files = files or -(-sum(self.store.size(s["name"]) for s in old) // MERGED_BYTES) or 1
        rows = self.store.segments(old, self.schema)
        rows = ordered(rows, self.sort, self.id_col, files) if self.sort else rows.coalesce(files) if files == 1 else rows.repartition(files)
        name = self.store.write_segment(rows)
        try:
            self.version = self.store.commit([{"name": name}], self.schema, self.version, {"batches": self.batches})
        except Exception:
            self.store.delete(name)
            raise
        self.committed, self.staged = [{"name": name}], []
        for s in old:
            self.store.delete(s["name"])
        return self.version


def sort_key(sort: tuple[str, bool, bool]):
    field, descending, missing_first = sort
    col = F.col(field)
    if descending:
        return col.desc_nulls_first() if missing_first else col.desc_nulls_last()
    return col.asc_nulls_first() if missing_first else col.asc_nulls_last()


def ordered(rows: DataFrame, sort: tuple[str, bool, bool], id_col: str = "doc_id", files: int | None = None) -> DataFrame:
    """Rows in the order of a field, ties by id, over range partitions."""
    keys = [sort_key(sort), F.col(id_col).asc()]
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


#: Rows of a range that is ordered in one task, about.
ROWS_PER_RANGE = 100_000


def sorted_ids(rows: DataFrame, sort: tuple[str, bool, bool], id_col: str = "doc_id", ranges: int = 0) -> DataFrame:
    """doc_id and sorted_doc_id, the place in the order of a field, ties by id. Ranges of (key, id) also split rows that share a key."""
    keyed = rows.select(id_col, F.col(sort[0]).alias("_key"))
    order = [sort_key(("_key", *sort[1:])), F.col(id_col).asc()]
    return placed(keyed, order, "sorted_doc_id", ranges, ROWS_PER_RANGE).select(id_col, "sorted_doc_id")
