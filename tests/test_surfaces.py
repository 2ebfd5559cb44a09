"""Document-at-a-time ingest, binary batches, shards, generators and the command line."""

from __future__ import annotations

import json

import pytest

from brindle.__main__ import main
from brindle.operators import metrics, shards
from brindle.plans.schema import FieldSpec, Schema
from brindle.sources import generators, metric_batch, store
from brindle.sources.documents import Documents

SCHEMA = Schema.of(FieldSpec.text("message"), FieldSpec.keyword("level"), FieldSpec.long_point("ts").with_doc_values("numeric"), FieldSpec.int_point("n"), FieldSpec.sorted_dv("tag"))


def test_documents(spark, tmp_path):
    struct = spark.createDataFrame([], "doc_id long, message string, level array<string>, ts long, n int, tag string").schema
    d = Documents(store.Writer(spark, str(tmp_path / "t"), struct), SCHEMA, max_buffered=2)
    for k in range(3):
        d.begin()
        d.add("message", f"m{k}")
        d.add("level", "a")
        d.add("level", "b")
        d.add("ts", k)
        assert d.end() == k
    for field, value in [("nofield", 1), ("ts", "x"), ("ts", True), ("n", 1 << 31), ("message", 5), ("tag", "x" * 40_000)]:
        d.begin()
        with pytest.raises(ValueError):
            d.add(field, value)
        with pytest.raises(ValueError):
            d.end()
    d.begin()
    d.add("ts", 1)
    with pytest.raises(ValueError):
        d.add("ts", 2)
    d.begin()
    d.add("message", "last")
    assert d.end() == 3
    assert [d.location(k) for k in (0, 2, 3, 4, -1)] == ["flushed", "flushed", "buffer" if len(d.rows) else "flushed", None, None]
    d.commit()
    assert d.location(3) == "committed"
    got = store.open_snapshot(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.message, r.level, r.ts) for r in got] == [(0, "m0", ["a", "b"], 0), (1, "m1", ["a", "b"], 1), (2, "m2", ["a", "b"], 2), (3, "last", None, None)]


def test_buffered_documents(spark, tmp_path):
    schema = Schema.of(FieldSpec.text("message"), FieldSpec.long_point("ts"), FieldSpec.binary_dv("raw").with_stored())
    struct = spark.createDataFrame([], "doc_id long, message string, ts long, raw binary").schema
    d = Documents(store.Writer(spark, str(tmp_path / "t"), struct), schema, max_buffered=100, max_bytes=60)
    for k in range(4):
        d.begin()
        d.add("message", "m" * 10)
        d.add("ts", k)
        d.add("raw", bytes([k]))
        d.end()
    # a document has 19 bytes: the fourth takes the buffer to 76
    assert [d.location(k) for k in range(5)] == ["flushed"] * 4 + [None] and d.bytes == 0
    d.begin()
    d.add("message", "é")
    last = d.end()
    assert d.location(last) == "buffer" and d.buffered(last) == {"message": "é"} and d.buffered(0) is None
    assert d.commit() == 1 and d.location(last) == "committed" and d.buffered(last) is None
    got = store.open_snapshot(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [bytes(r.raw) if r.raw is not None else None for r in got] == [b"\x00", b"\x01", b"\x02", b"\x03", None]


def test_binary_batches(spark, tmp_path):
    pts = [("cpu", "$#$a=é$#$", 1000, 1.5), ("", "", -5, float("inf"))]
    data = metric_batch.encode(pts)
    assert list(metric_batch.decode(data)) == pts
    assert all(list(metric_batch.decode(data[:n])) == (pts[:1] if n >= 33 else []) for n in (0, 1, 5, 20, 32, 33, len(data) - 1))
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").write_bytes(data[:-1])
    assert metric_batch.read(spark, str(tmp_path)).count() == 3


def points(spark, rows):
    return spark.createDataFrame(rows, "metric_name string, labels string, ts_ms long, value double")


def test_shards(spark, tmp_path):
    a = shards.Shard(spark, str(tmp_path / "a"))
    a.write_points(points(spark, [("A", "$#$", 1000 * k, float(k)) for k in (1, 2, 3)]).coalesce(1))
    a.flush()
    with pytest.raises(FileNotFoundError):
        shards.read(spark, str(tmp_path / "a"))
    a.write_points(points(spark, [("A", "$#$", 2000, 99.0), ("A", "$#$", 3000, 99.0), ("A", "$#$", 4000, 4.0)]).coalesce(1))
    a.write_point("B", "$#$", 5, 1.0)
    a.commit()
    assert a.points().count() == 7 == shards.read(spark, str(tmp_path / "a")).count()
    stats = shards.merge_intra(spark, str(tmp_path / "a"), str(tmp_path / "m"))
    assert (stats.output_docs, stats.input_points, stats.output_points) == (2, 7, 5)
    got = {(r.metric_name, r.ts_ms): r.value for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got == {("A", 1000): 1.0, ("A", 2000): 2.0, ("A", 3000): 3.0, ("A", 4000): 4.0, ("B", 5): 1.0}
    b = shards.Shard(spark, str(tmp_path / "b"))
    b.write_points(points(spark, [("A", "$#$", 4000, 44.0), ("A", "$#$", 400_000, 5.0)]))
    b.commit()
    tables, stats = shards.merge_cross(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "out"))
    assert (tables["compact"].count(), stats.output_points, tables["5m"].count(), tables["1h"].count()) == (6, 6, 3, 2)
    assert tables["compact"].where("ts_ms = 4000").first().value == 4.0
    made, stats = shards.downsample(spark, str(tmp_path / "b"), str(tmp_path / "d"), metrics.ONE_HOUR)
    assert made.first()["count"] == 2 and stats == shards.DownsampleStats(1, 1, 2)
    made, stats = shards.downsample(spark, str(tmp_path / "a"), str(tmp_path / "e"), metrics.ONE_HOUR)
    assert stats == shards.DownsampleStats(3, 3, 7) and sorted((r.metric_name, r["count"]) for r in made.collect()) == [("A", 3), ("A", 3), ("B", 1)]


def test_shards_flush_by_themselves(spark, tmp_path):
    a = shards.Shard(spark, str(tmp_path / "a"), max_total_points=5)
    for k in range(6):
        a.write_series("m", "$#$", [(10 * k, 1.0), (10 * k + 1, 2.0)])
        assert a.points().select("part").distinct().count() == k + 1 and (a.writer.buffered == []) == (k in (2, 5))
    with pytest.raises(FileNotFoundError):
        shards.read(spark, a.path)
    assert a.close() == 1 and shards.read(spark, a.path).count() == 12
    b = shards.Shard(spark, str(tmp_path / "b"), max_series=2)
    b.write_many([("m", "$#$x=1$#$", 1, 1.0), ("m", "$#$x=2$#$", 1, 1.0)] * 4)
    assert len(b.writer.buffered) == 1
    b.write_many([("n", "$#$", 1, 1.0)])
    assert b.writer.buffered == [] and len(b.writer.staged) == 2
    c = shards.Shard(spark, str(tmp_path / "c"))
    assert not c.full() and c.close() is None


def test_generators(spark):
    rows = generators.logs(spark, 200).collect()
    assert all(r.level in generators.LEVELS and len(r.message.split()) == generators.WORDS and 0 <= r.duration_ms < 5_000 for r in rows)
    assert rows == generators.logs(spark, 200).collect() != generators.logs(spark, 200, seed=2).collect()
    sparse = generators.logs(spark, 2_000, sparse=True)
    for name, share in generators.SHARES.items():
        assert abs(sparse.where(f"{name} is not null").count() - 20 * share) < 150
    assert [json.loads(r.value)["unnamed"] for r in generators.json_lines(spark, 5).collect()] == [f"extra{k}" for k in range(5)]
    assert all(150 < len(r.message) < 260 for r in generators.texts(spark, 50, 200).collect())


def test_command_line(spark, tmp_path, capsys):
    src, table, spec = str(tmp_path / "in"), str(tmp_path / "t"), "timestamp:longpoint+numericdv,level:keyword,message:text+positions"
    assert main(["jsongen", src, "--docs", "50"]) == 0
    assert main(["jsonindex", src, table, "--schema", spec]) == 0
    assert main(["forcemerge", table]) == 0
    capsys.readouterr()
    assert main(["search", table, '{"query": {"type": "match_all"}, "top_n": 1}', "--schema", spec]) == 0
    assert main(["search", table, "(NOT (TERM level nosuch))", "--schema", spec, "--top", "0"]) == 0
    assert [json.loads(x)["total"] for x in capsys.readouterr().out.splitlines()] == [50, 50]
    (tmp_path / "q").write_text("TERM\tlevel\tnosuch\nTERMS\tlevel\t" + ",".join(generators.LEVELS) + "\n")
    assert main(["searchdump", table, str(tmp_path / "q"), "--schema", spec]) == 0
    assert [json.loads(x.rsplit("\t", 1)[1])["total"] for x in capsys.readouterr().out.splitlines()] == [0, 50]
    for more, found in (([], [0, 50]), (["--topn", "3"], [0, 3]), (["--no-fast-count"], [-1, -1])):
        assert main(["searchbench", table, str(tmp_path / "q"), "--schema", spec, "--iter", "1", *more]) == 0
        assert [json.loads(x)["found"] for x in capsys.readouterr().out.splitlines()] == found
    assert main(["logwrite", str(tmp_path / "logs"), "--docs", "20", "--sort", "timestamp"]) == 0
    capsys.readouterr()
    assert main(["searchdump", str(tmp_path / "logs")]) == 0
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert lines[0] == ["maxDoc", "20"] and sum(x[0] == "TERM" and x[1] == "level" and x[4] == "high" for x in lines) == 3
    totals = {x[0]: json.loads(x[1])["total"] for x in lines if x[1].startswith("{")}
    assert totals["matchall"] == 20 and {k.split()[0] for k in totals} == {"matchall", "term", "and", "or", "terms", "prefix", "wildcard", "bool", "phrase", "range"}
    tops = {x[2]: int(x[3]) for x in lines if x[0] == "TERM" and x[1] == "level" and x[4] == "high"}
    assert all(totals[f"term level={t}"] == n for t, n in tops.items())
    assert sorted(n for k, n in totals.items() if k.startswith("range timestamp"))[-1] == 20
    for verb in ("write", "bench", "logbench"):
        assert main([verb, str(tmp_path / verb), "--docs", "30"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert "'docs': 30" in out[0] and [json.loads(x)["what"] for x in out[1:]] == ["rows", "postings"] * 2
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.log").write_text("one\ntwo\n")
    assert main(["index", str(tmp_path / "text"), str(tmp_path / "lines"), "--docs", "5"]) == 0
    assert "'docs': 5" in capsys.readouterr().out
