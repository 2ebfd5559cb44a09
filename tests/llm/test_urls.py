"""URL rules by a plain reading, and trees that learn."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from brindle.llm import urls as U

PAGES = "page_id long, url string, html string, host string, score double, label int"
URLS = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://A.NET/x?y=/z", "http://net/", "http://xnet/", "https://example.net/en/1", "https://sub.Example.NET/en/", "https://example.net/en", "http://example.com/de/1", "http://myexample.com/de/1", "http://a.b.org/fr/#x", "http://a.org/fr?x", "http://a.org?q=/fr/", "x://y://z/net/", "http://É.net/é/", "://net/", "http://a.net\n/x", "http://a.com/" + "p/" * 5000]


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for _, rule in U.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None, "clash", 1.0, 1) for i, u in enumerate(URLS)] + [(None, URLS[8], None, None, None, None), (3, URLS[3], "x", None, None, None)], PAGES)
    got = U.judged(df).collect()
    said = {rule: verdict for verdict, rule in U.RULES}
    assert len(got) == len(URLS) + 2
    for r in got:
        u = URLS[8] if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path, r.rule) == brute(u)
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == said[r.rule])
    assert U.judged(df.where("false")).count() == 0
    assert {r.verdict for r in U.judged(df.where("page_id in (0, 1, 2)")).collect()} == {"allow"}


def test_trees_learn_lexical_differences(spark):
    rows = [(i, f"https://h{i % 7}.site.com/{'a/' * (i % 6)}{'9' * 8 if i % 2 else 'words'}.html" + ("?a=1&b=2" if i % 2 else ""), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, url string, label int")
    host, path = U.parts(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    model = U.learn(df.where("id < 300"))
    got = model.with_statistics(U.lexical(df)).select("label", (model.score() > 0).cast("int").alias("p")).collect()
    assert all(r.label == r.p for r in got)
    assert "Python" not in model.with_statistics(U.lexical(df)).select(model.score())._jdf.queryExecution().toString()


def plain_features(url):
    url = url or ""
    host, path, _ = brute(url)
    query = re.search(r"\?([^#]*)", url)
    n = len(url)
    shares = [url.count(c) / n for c in set(url)]
    return {
        "url_length": n, "host_length": len(host), "path_length": len(path), "host_depth": host.count("."), "path_depth": path.count("/"),
        "digit_ratio": sum(c in "0123456789" for c in url) / n if n else 0, "entropy": -sum(p * math.log2(p) for p in shares), "parameters": query[1].count("&") + 1 if query and query[1] else 0, "fragment": float("#" in url),
        "host_suffix": host.rsplit(".", 1)[-1], "path_suffix": (re.search(r"\.([A-Za-z0-9]+)$", path) or ["", ""])[1], "path_start": (re.search(r"^/([^/]*)/", path) or ["", ""])[1],
    }


def plain_score(model, url):
    x = plain_features(url)
    for name, (known, rest) in model.statistics.items():
        x[name] = known.get(x[name], rest)

    def leaf(node):
        return node if isinstance(node, float) else leaf(node[2] if x[node[0]] <= node[1] else node[3])

    return model.bias + sum(map(leaf, model.trees))


def test_scores_by_a_plain_reading(spark):
    rows = [(i, f"http://h{i % 9}.a{i % 4}.{'net' if i % 3 else 'org'}/{'fr/' if i % 2 else ''}{'p/' * (i % 5)}{i * 7919 % 1000}{['', '.html', '.pdf'][i % 3]}{'?a=1&b=2' if i % 7 == 0 else ''}", None, None, 0.0, 0) for i in range(600)]
    rows += [(1000 + i, u, None, None, 0.0, 0) for i, u in enumerate(URLS) if u is None or "\n" not in u]
    df = spark.createDataFrame(rows, PAGES)
    labels = {r[0]: brute(r[1])[2] for r in rows}
    said = {rule: int(verdict == "block") for verdict, rule in U.RULES}
    told = spark.createDataFrame([(r[0], r[1], *brute(r[1])[:2], said[labels[r[0]]]) for r in rows if labels[r[0]]], "id long, url string, host string, path string, label int")
    model = U.learn(told)
    assert len(model.trees) == U.ROUNDS and any(not isinstance(t, float) for t in model.trees)
    for r in U.judged(df).collect():
        url = next(x[1] for x in rows if x[0] == r.page_id)
        z = plain_score(model, url)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        assert r.verdict == (("block" if said[r.rule] else "allow") if r.rule else "block" if z > 0 else "allow")


def test_features(spark):
    df = spark.createDataFrame([("http://a.b.com/x1/y.html?p=1&q=2#f",), (None,)], "url string")
    host, path = U.parts(F.col("url"))
    r, none = U.lexical(df.withColumn("host", host).withColumn("path", path)).collect()
    assert (r.url_length, r.host_depth, r.path_depth, r.parameters, r.fragment) == (34, 2, 2, 2, 1)
    assert (r.host_suffix, r.path_suffix, r.path_start) == ("com", "html", "x1")
    assert r.digit_ratio == pytest.approx(3 / 34) and 3 < r.entropy < 5
    assert none.url_length == 0 and none.entropy == 0 and none.parameters == 0
