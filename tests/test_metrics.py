"""Labels, merges, buckets, sketches and manifests on hand-made points."""

from __future__ import annotations

import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.functions import hll, labels
from brindle.operators import metrics as X

POINTS = "metric_name string, labels string, ts_ms long, value double, shard int, seq long"


def buckets(spark, rows, gran=X.FIVE_MINUTES):
    pts = spark.createDataFrame([("m", "$#$", t, v) for t, v in rows], "metric_name string, labels string, ts_ms long, value double")
    return {r.bucket_time: r for r in X.downsampled(pts, gran).collect()}


def test_labels(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({},), (None,), ({"k": "x=y"},)], "m map<string,string>")
    got = [r[0] for r in df.select(labels.labels_str(F.col("m"))).collect()]
    assert got == ["$#$a=1$#$b=2$#$", "$#$", "$#$", "$#$k=x=y$#$"]
    back = spark.createDataFrame([(x,) for x in [*got, "$#$novalue$#$a=1$#$a=2$#$"]], "s string").select(labels.parse_labels(F.col("s")).alias("m"), labels.label(F.col("s"), "a").alias("a")).collect()
    assert [r.m for r in back] == [{"a": "1", "b": "2"}, {}, {}, {"k": "x=y"}, {"a": "2"}]
    assert [r.a for r in back] == ["1", None, None, None, "2"]


def test_series_hash(spark):
    got = spark.createDataFrame([("cpu", "$#$a=1$#$")], "n string, l string").select(labels.series_hash(F.col("n"), F.col("l"))).first()[0]
    low = lambda s: xxhash.xxh64_intdigest(s.encode("utf-16-le")) % (1 << 32)
    assert got % (1 << 64) == low("cpu") * (1 << 32) + low("$#$a=1$#$")


def test_buckets(spark):
    one = buckets(spark, [(301000, 10.0), (303000, 30.0), (302000, 20.0)])[300000]
    assert (one["count"], one["sum"], one["min"], one["max"], one["delta"], one["point_max"]) == (3, 60.0, 10.0, 30.0, 20.0, 303000)
    reset = buckets(spark, [(0, 100.0), (1, 50.0), (2, 80.0)])[0]
    assert (reset["sum"], reset["delta"]) == (230.0, 80.0)
    assert set(buckets(spark, [(-1, 1.0), (-300001, 2.0), (299999, 3.0)])) == {0, -300000}
    mixed = buckets(spark, [(0, math.nan), (1, 5.0)])[0]
    assert math.isnan(mixed["sum"]) and (mixed["min"], mixed["max"]) == (5.0, 5.0)
    nothing = buckets(spark, [(0, math.nan)])[0]
    assert nothing["min"] is None and nothing["max"] is None
    ends = buckets(spark, [(0, math.inf), (1, -math.inf), (2, -0.0)])[0]
    assert (ends["min"], ends["max"]) == (-math.inf, math.inf)


def test_rollup(spark):
    rows = [("m", "$#$", 300_000, i * 300_000, 10, 100.0 + i, float(i), 20.0 + i, 5.0, 0) for i in range(12)]
    fine = spark.createDataFrame(rows, "metric_name string, labels string, gran_ms long, bucket_time long, count long, sum double, min double, max double, delta double, point_max long")
    r = X.rolled_up(fine, X.ONE_HOUR).first()
    assert (r["bucket_time"], r["count"], r["sum"], r["min"], r["max"], r["delta"]) == (0, 120, 1266.0, 0.0, 31.0, 60.0)


def test_first_of_equal_times_stays(spark):
    rows = [("m", "$#$", t, v, 0, k) for k, (t, v) in enumerate([(1000, 1.0), (2000, 2.0), (3000, 3.0), (2000, 99.0), (3000, 99.0), (4000, 4.0)])]
    got = X.merged(spark.createDataFrame(rows, POINTS)).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.value) for r in got] == [(1000, 1.0), (2000, 2.0), (3000, 3.0), (4000, 4.0)]
    late = [("m", "$#$", 1, 7.0, 1, 0), ("m", "$#$", 1, 8.0, 0, 9)]
    assert X.merged(spark.createDataFrame(late, POINTS)).first().value == 8.0


def test_merge_statistics(spark):
    rows = [("A", "$#$", t, 1.0, 0, t, 0) for t in (1, 2, 3)] + [("A", "$#$", t, 1.0, 0, t, 1) for t in (4, 5)] + [("B", "$#$", t, 1.0, 0, t, 1) for t in (1, 2, 3, 4)]
    pts = spark.createDataFrame(rows, POINTS + ", part int")
    assert X.merge_stats(pts, X.merged(pts)) == X.MergeStats(3, 2, 9, 9, 1)
    none = pts.where("false")
    assert X.merge_stats(none, X.merged(none)) == X.MergeStats(0, 0, 0, 0, 0)


def test_shards_to_three_tables(spark, tmp_path):
    pts = spark.createDataFrame([("m", "$#$", t, float(k), k % 2, k) for k, t in enumerate([0, 60000, 120000, 300000, 300000, 600000])], POINTS)
    got = X.merge_shards(pts, str(tmp_path / "merged"))
    assert {k: v.count() for k, v in got.items()} == {"compact": 5, "5m": 3, "1h": 1}


def test_packing_is_exact(spark):
    odd = [math.nan, math.inf, -math.inf, -0.0, 0.0, 1.7976931348623157e308, 5e-324]
    pts = spark.createDataFrame([("m", "$#$", 10 * k + k % 3, v) for k, v in enumerate(odd)], "metric_name string, labels string, ts_ms long, value double")
    got = X.unpacked(X.packed(pts)).orderBy("ts_ms").collect()
    assert [str(r.value) for r in got] == [str(v) for v in odd]
    r = X.series_stats(pts).first()
    assert (r.time_min, r.time_max, r.sample_count) == (0, 60, 7)


@pytest.mark.parametrize("n,tolerance", [(0, 0), (1, 0.01), (100, 0.2), (10_000, 0.06)])
def test_sketch(spark, n, tolerance):
    random.seed(n)
    hashes = [random.getrandbits(64) - (1 << 63) for _ in range(n)]
    rows = spark.createDataFrame([(h,) for h in hashes + hashes], "h long")
    regs = hll.registers(rows, F.col("h"))
    values = {r.reg: r.rho for r in regs.collect()}
    expected: dict[int, int] = {}
    for h in hashes:
        u = h % (1 << 64)
        rho = min(15, 53 - (u >> 12).bit_length())
        expected[u & 4095] = max(rho, expected.get(u & 4095, 0))
    assert values == expected
    got = hll.estimate(regs).first()[0]
    assert abs(got - n) <= tolerance * n + 1e-6
    assert math.isclose(got, hll.estimated(values), abs_tol=1e-6)
    assert hll.from_bytes(hll.to_bytes(values)) == values and len(hll.to_bytes(values)) == 2049
    with pytest.raises(ValueError):
        hll.from_bytes(b"\x0b" + bytes(2048))


def test_manifest(spark, tmp_path):
    told = X.ShardMetadata("org", "2026-01-01", 7, merged_from=(1, 2), covered_by=9).with_series({3: 4})
    text = told.to_json()
    assert '"orgId": "org"' in text and "coveredAt" not in text and "sourceShardIds" not in text
    assert X.ShardMetadata.from_json(text) == told
    X.write_metadata(spark, str(tmp_path), told)
    X.write_metadata(spark, str(tmp_path), told)
    assert X.read_metadata(spark, str(tmp_path)) == told
    pts = spark.createDataFrame([("m", "$#$", 5, 1.0, 0, 0), ("n", "$#$", 9, 1.0, 0, 0)], POINTS)
    s = X.ShardMetadata("o", "d", 1).with_points(pts)
    assert (s.total_samples, s.series_count, s.min_time, s.max_time) == (2, 2, 5, 9)
