"""Versions, merges, sorting, JSON and text ingest, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.operators.search import Searcher
from brindle.plans.query import Phrase, Term
from brindle.plans.schema import FieldSpec, Schema
from brindle.sources import jsonl, store, text_files
from brindle.streaming import live

STRUCT = "doc_id long, level string, message string, ts long"


def rows(spark, start, n):
    return spark.createDataFrame([(i, "INFO", f"w{i % 5}", i * 10) for i in range(start, start + n)], STRUCT)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_visibility(spark, tmp_path):
    path = str(tmp_path / "t")
    w = store.Writer(spark, path, rows(spark, 0, 1).schema)
    w.add(rows(spark, 0, 10))
    w.flush()
    with pytest.raises(FileNotFoundError):
        store.open_snapshot(spark, path)
    w.add(rows(spark, 10, 5))
    assert ids(w.live()) == list(range(15))
    assert w.commit() == 1
    assert ids(store.open_snapshot(spark, path)) == list(range(15))
    with pytest.raises(FileExistsError):
        store.Writer(spark, path, rows(spark, 0, 1).schema)
    with pytest.raises(ValueError):
        store.Writer(spark, path, spark.range(1).schema, append=True)


def test_versions_and_rival_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    a = store.Writer(spark, path, rows(spark, 0, 1).schema)
    b = store.Writer(spark, path, rows(spark, 0, 1).schema)
    a.add(rows(spark, 0, 3))
    a.commit()
    b.add(rows(spark, 3, 3))
    with pytest.raises(FileExistsError):
        b.commit()
    c = store.Writer(spark, path, rows(spark, 0, 1).schema, append=True)
    c.add(rows(spark, 3, 3))
    assert c.commit(batch=5) == 2
    again = store.Writer(spark, path, rows(spark, 0, 1).schema, append=True)
    again.add(rows(spark, 3, 3))
    assert again.commit(batch=5) == 2
    assert ids(store.open_snapshot(spark, path)) == list(range(6)) and ids(store.open_snapshot(spark, path, 1)) == [0, 1, 2]


def test_streams_have_batches_of_their_own(spark, tmp_path):
    path = str(tmp_path / "t")
    for stream, batch, n in (("one", 0, 1), ("two", 0, 2), ("one", 0, 2), ("one", 1, 3), ("two", 0, 3), ("one", 0, 3)):
        w = store.Writer(spark, path, rows(spark, 0, 1).schema, append=True)
        w.add(rows(spark, 0, 1))
        w.commit(batch, stream)
        assert store.open_snapshot(spark, path).count() == n
    assert store.Store(spark, path).manifest()["batches"] == {"one": 1, "two": 0}


def test_writer_flushes_by_itself(spark, tmp_path):
    struct = rows(spark, 0, 1).schema
    w = store.Writer(spark, str(tmp_path / "a"), struct, max_buffered=10)
    for k, flushed in ((4, 0), (4, 0), (4, 3), (9, 3), (1, 5)):
        w.add(rows(spark, 0, k))
        assert len(w.staged) == flushed
    assert w.documents == 0 and w.buffered == [] and ids(w.live()) == sorted([*range(4)] * 3 + [*range(9), 0])
    with pytest.raises(FileNotFoundError):
        store.open_snapshot(spark, str(tmp_path / "a"))
    w = store.Writer(spark, str(tmp_path / "b"), struct, max_bytes=1)
    w.add(rows(spark, 0, 3))
    assert len(w.staged) == 1 and w.bytes == 0
    w = store.Writer(spark, str(tmp_path / "c"), struct)
    w.add(rows(spark, 0, 3))
    assert len(w.buffered) == 1


def test_merged_segments_have_files_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MERGED_BYTES", 1500)
    path = str(tmp_path / "t")
    w = store.Writer(spark, path, rows(spark, 0, 1).schema)
    for k in range(4):
        w.add(rows(spark, 100 * k, 100))
        w.commit()
    w.force_merge()
    got = store.open_snapshot(spark, path)
    assert len(got.inputFiles()) > 1 and len(list((tmp_path / "t" / "segments").iterdir())) == 1 and ids(got) == list(range(400))


def test_force_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    w = store.Writer(spark, path, rows(spark, 0, 1).schema, sort=("ts", True, False))
    assert w.force_merge() == 0
    for k in range(3):
        w.add(rows(spark, 4 * k, 4))
        w.commit()
    w.force_merge()
    got = store.open_snapshot(spark, path)
    assert [r.ts for r in got.collect()] == sorted((r.ts for r in got.collect()), reverse=True)
    assert len({f for f in got.inputFiles()}) == 1 and ids(got) == list(range(12))
    assert len(list((tmp_path / "t" / "segments").iterdir())) == 1


@pytest.mark.parametrize("ranges", [1, 3, 8])
@pytest.mark.parametrize("per_range", [2, 100_000])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("missing_first", [False, True])
def test_sorted_ids(spark, ranges, per_range, descending, missing_first, monkeypatch):
    monkeypatch.setattr(store, "ROWS_PER_RANGE", per_range)
    keys = [30, 10, None, 20, 20, 10, None, 5, 5, 5]
    df = spark.createDataFrame(list(enumerate(keys)), "doc_id long, ts long")
    got = {r.doc_id: r.sorted_doc_id for r in store.sorted_ids(df, ("ts", descending, missing_first), ranges=ranges).collect()}
    present = sorted((i for i, k in enumerate(keys) if k is not None), key=lambda i: (-keys[i] if descending else keys[i], i))
    missing = [i for i, k in enumerate(keys) if k is None]
    order = missing + present if missing_first else present + missing
    assert sorted(got, key=got.get) == order and sorted(got.values()) == list(range(10))


SPEC = "timestamp:longpoint+numericdv+stored,level:keyword+sorteddv,trace_id:keyword,message:text+positions,latency_ms:intpoint+numericdv+stored"


def bind(spark, lines, spec):
    df = spark.createDataFrame(list(enumerate(lines)), "n long, value string")
    got, schema = jsonl.bind(df, Schema.parse(spec), order=F.col("n"), keep=("n",))
    return {r.n: r.asDict() for r in got.collect()}, schema


def test_json_lines(spark):
    lines = ['{"latency_ms": "42", "level": 200, "message": 12345, "noise": 1}', '{"latency_ms": " 7 ", "level": true}', "{not json", "[1, 2, 3]", "42", "", '{"timestamp": "not-a-number", "latency_ms": 9999999999, "level": "x"}', '{"level": {"a": 1}, "message": [1], "trace_id": null, "timestamp": 1.5}', "{}"]
    got, schema = bind(spark, lines, SPEC)
    assert set(got) == {0, 1, 6, 7, 8} and list(schema.fields) == ["timestamp", "level", "trace_id", "message", "latency_ms"]
    assert (got[0]["latency_ms"], got[0]["level"], got[0]["message"]) == (42, "200", "12345")
    assert (got[1]["latency_ms"], got[1]["level"]) == (7, "true")
    assert (got[6]["timestamp"], got[6]["latency_ms"], got[6]["level"]) == (None, None, "x")
    assert all(v is None for k, v in got[7].items() if k != "n")
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert tuple(jsonl.counts(df).first()) == (5, 3)


def test_strict_json(spark):
    lines = ['{"level":1,"level":2}', '{"level": 1} more', "{'level': 1}", '{"level": NaN}', '{"latency_ms": 5.0}', '{"latency_ms": "1e3"}', '{"latency_ms": "+7"} \t', '{"level":"\\u00e9", "":5}']
    got, _ = bind(spark, lines, SPEC)
    assert {k: (v["level"], v["latency_ms"]) for k, v in got.items()} == {0: ("1", None), 4: (None, None), 5: (None, None), 6: (None, 7), 7: ("é", None)}


def test_unknown_keys(spark):
    lines = ['{"a": 7, "b": "x", "c": true, "d": 1.5, "e": null, "f": {"x": 1}}', '{"a": "later", "e": 3}']
    got, schema = bind(spark, lines, "$policy=dynamic,b:text")
    kinds = {k: (f.kind, f.points, f.doc_values) for k, f in schema.fields.items()}
    assert kinds == {"b": ("text", False, None), "a": ("long", True, "numeric"), "c": ("keyword", False, None), "d": ("keyword", False, None), "e": ("long", True, "numeric")}
    assert (got[0]["a"], got[0]["c"], got[0]["d"], got[1]["a"], got[1]["e"]) == (7, "true", "1.5", None, 3)
    got, schema = bind(spark, lines, "$policy=stored-only,b:text")
    assert not schema.fields["a"].indexed and schema.fields["a"].stored and got[1]["a"] == "later"
    got, schema = bind(spark, ['{"message": "m", "message_raw": "r"}'], "message_raw:keyword+sorteddv@message")
    assert got[0]["message_raw"] == "m"
    got, _ = bind(spark, ['{"w": "s"}', '{"w": 5}'], "w:sorteddv")
    assert (got[0]["w"], got[1]["w"]) == ("s", "5")


def test_too_many_unknown_keys(spark, monkeypatch):
    monkeypatch.setattr(jsonl, "MOST_KEYS", 3)
    bind(spark, ['{"a": 1, "b": 2, "c": 3}'], "$policy=dynamic")
    with pytest.raises(ValueError):
        bind(spark, ['{"a": 1, "b": 2}', '{"c": 3, "d": 4}'], "$policy=dynamic")


def test_text_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "two.log").write_bytes(b"third line\r\n\n \x00 fourth \t\nbad \xff line\n")
    (tmp_path / "a.log").write_text("first\nsecond é")
    got = text_files.numbered(text_files.read(spark, str(tmp_path))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.message, r.line) for r in got] == [(0, "first", 1), (1, "second é", 2), (2, "third line", 1), (3, "fourth", 3)]
    more = text_files.cycled(text_files.numbered(text_files.read(spark, str(tmp_path))), 10).orderBy("doc_id").collect()
    assert [r.message for r in more][:6] == ["first", "second é", "third line", "fourth", "first", "second é"] and len(more) == 10


def test_large_text_files_are_split(spark, tmp_path):
    texts = {name: [f"{name} line {k} " + "x" * (k % 50) if k % 7 else "" for k in range(300)] for name in ("a", "b")}
    for name, lines in texts.items():
        (tmp_path / f"{name}.log").write_text("\n".join(lines))
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = text_files.read(spark, str(tmp_path))
        assert rows.select("source", "split").distinct().count() > 4
        got = text_files.numbered(rows).orderBy("doc_id").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    want = [(x.strip(), k + 1) for name in ("a", "b") for k, x in enumerate(texts[name]) if x]
    assert [(r.message, r.line) for r in got] == want and [r.doc_id for r in got] == list(range(len(want)))


def test_late_points_and_watermarks(spark, tmp_path):
    src = str(tmp_path / "points")
    for t in (0, 3_600_000, 7_200_000, 10):  # the last comes far behind the watermark
        spark.createDataFrame([("m", "$#$", t, 1.0)], "metric_name string, labels string, ts_ms long, value double").coalesce(1).write.mode("append").parquet(src)
        import time

        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.bucket_time: r["count"] for r in live.into_table(live.downsampled(stream, lateness="10 minutes"), str(tmp_path / "late"), "append").collect()}
    assert got[0] == 1 and 3_600_000 in got


def test_streams(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "table")
    for k in range(3):
        rows(spark, 10 * k, 10).write.mode("append").parquet(src)
    struct = rows(spark, 0, 1).schema
    for _ in range(2):  # the second run finds nothing new
        live.ingest(spark.readStream.schema(struct).option("maxFilesPerTrigger", 2).parquet(src), path, str(tmp_path / "progress")).awaitTermination()
    assert ids(store.open_snapshot(spark, path)) == list(range(30))
    schema = Schema.of(FieldSpec.text("message", positions=True), FieldSpec.keyword("level"), FieldSpec.long_point("ts").with_doc_values("numeric"))
    s = live.live_searcher(path, rows(spark, 30, 5), schema)
    r = s.search(Term("level", "INFO"), ("ts", True), 5)
    assert (r.docs, r.total) == ([34, 33, 32, 31, 30], 35)
    assert s.count(Phrase("message", ("w1",))) == 7


def test_stream_buckets(spark, tmp_path):
    src = str(tmp_path / "points")
    spark.createDataFrame([("m", "$#$", t, v) for t, v in [(0, 100.0), (1000, 50.0), (2000, 80.0), (300000, 1.0)]], "metric_name string, labels string, ts_ms long, value double").repartition(3).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.bucket_time: (r["count"], r["sum"], r["delta"]) for r in live.into_table(live.downsampled(stream), str(tmp_path / "buckets")).collect()}
    assert {r.bucket_time for r in live.into_memory(live.downsampled(stream), "buckets").collect()} == set(got)
    assert got == {0: (3, 230.0, 80.0), 300000: (1, 1.0, 0.0)}
