"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

DataFrame functions only. A rule names a host (with all its subdomains) and the
start of a path; the longest fitting rule decides. Other URLs get the verdict of
boosted trees over lengths, depth, digit ratio, character entropy, parameter
counts and statistics of the host's and the path's suffix. The trees learn from
the URLs that rules label: a bounded, hash-chosen sample is put in bins, equal
rows are counted once, and every level of a tree is one aggregation of gradient
sums by node, feature and bin; the driver sees only those sums (nodes x features
x bins) and picks the splits. A finished tree is a nested CASE expression.

Defined cases: a null URL, or one without `://`, has an empty host and path and
no rule; the method judges it by its features like any other (all zero for
null); without labelled URLs of both kinds every such URL is allowed; repeated
rows are judged row by row; an empty table gives no rows. Other columns of the
input play no part, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C

#: (verdict, rule) as given; a rule is host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: At most about so many labelled URLs of each verdict are learned from.
PER_CLASS = 10_000
ROUNDS, DEPTH, BINS, RATE, PENALTY = 8, 3, 16, 0.4, 1.0
#: Of each suffix kind the most frequent ones of the sample have a statistic of their own.
SUFFIXES = 100
NUMBERS = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters", "fragment")
STATISTICS = ("host_suffix", "path_suffix", "path_start")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(rows: DataFrame) -> DataFrame:
    """rows: url, host, path. Adds the features."""
    url, host, path = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "host", "path"))
    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    chars = F.array_distinct(F.split(url, ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return rows.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "host_depth": F.regexp_count(host, F.lit(r"\.")).cast("double"),
            "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
            "digit_ratio": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0),
            "entropy": F.when(n > 0, F.round(entropy, 9)).otherwise(0.0),
            "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "host_suffix": F.substring_index(host, ".", -1),
            "path_suffix": F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1),
            "path_start": F.regexp_extract(path, r"^/([^/]*)/", 1),
        }
    )


@dataclass
class Trees:
    """Statistics of suffixes, and trees as (feature, limit, left, right) or leaf values."""

    statistics: dict[str, tuple[dict[str, float], float]]
    trees: list
    bias: float

    def score(self) -> Column:
        """The log odds that a URL with its features should be blocked."""
        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + self._branch(tree)
        return total

    def _branch(self, node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, limit, left, right = node
        return F.when(F.col(name) <= F.lit(limit), self._branch(left)).otherwise(self._branch(right))

    def with_statistics(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: self._told(name) for name in self.statistics}) if self.statistics else rows

    def _told(self, name: str) -> Column:
        known, rest = self.statistics[name]
        if not known:
            return F.lit(rest)
        table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
        return F.coalesce(F.try_element_at(table, F.col(name)), F.lit(rest))


def learn(labelled: DataFrame, per_class: int = PER_CLASS) -> Trees:
    """labelled: id, url, host, path and label (1 to block)."""
    sample = C.staged(lexical(C.class_sample(labelled, "id", "label", per_class, 7)[0]).drop("id", "url", "host", "path"), "urls")
    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Trees({}, [], -1.0)
    bias = math.log(counts[1] / counts[0])
    statistics = {}
    for name in STATISTICS:
        got = sample.groupBy(name).agg(F.count("*").alias("n"), F.sum("label").alias("bad")).orderBy(F.desc("n"), name).limit(SUFFIXES).collect()
        prior = counts[1] / (counts[0] + counts[1])
        statistics[name] = ({r[0]: round((r.bad + 5 * prior) / (r.n + 5), 6) for r in got}, round(prior, 6))
    model = Trees(statistics, [], bias)
    names = NUMBERS + STATISTICS
    rows = model.with_statistics(sample)
    levels = [k / BINS for k in range(1, BINS)]
    edges = rows.agg(*(F.percentile_approx(c, F.array(*map(F.lit, levels)), 10000).alias(c) for c in names)).first()
    limits = {c: sorted(set(edges[c])) for c in names}
    # equal rows of bins count once: their number is what is carried on
    upper = {c: F.element_at(F.filter(F.array(*map(F.lit, [*limits[c], float("inf")])), lambda e: e >= F.col(c)), 1) for c in names}
    binned = C.staged(rows.select(*(upper[c].alias(c) for c in names), "label").groupBy(*names, "label").agg(F.count("*").alias("n")), "bins")
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-model.score()))
        graded = binned.withColumn("g", F.col("n") * (p - F.col("label"))).withColumn("h", F.col("n") * p * (1 - p))
        splits: dict[int, tuple] = {}
        values: dict[int, float] = {}
        open_nodes = [1]
        for depth in range(DEPTH):
            sums = _sums(graded, names, splits, open_nodes)
            nexts = []
            for node in open_nodes:
                found, value = _best(sums.get(node, {}), limits)
                values[node] = value
                if found:
                    splits[node] = found[:2]
                    values[2 * node], values[2 * node + 1] = found[2:]
                    nexts += [2 * node, 2 * node + 1]
            open_nodes = nexts
            if not open_nodes:
                break
        model.trees.append(_built(1, splits, values))
    return model


def _node(splits: dict[int, tuple], at: int = 1) -> Column:
    if at not in splits:
        return F.lit(at)
    name, limit = splits[at]
    return F.when(F.col(name) <= F.lit(limit), _node(splits, 2 * at)).otherwise(_node(splits, 2 * at + 1))


def _sums(graded: DataFrame, names, splits, open_nodes) -> dict:
    """Gradient sums by node, feature and bin."""
    bins = F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("e")) for c in names))
    rows = graded.select(_node(splits).alias("node"), F.explode(bins).alias("b"), "g", "h").where(F.col("node").isin(open_nodes))
    out: dict = {}
    for r in rows.groupBy("node", "b.f", "b.e").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out.setdefault(r.node, {}).setdefault(r.f, {})[r.e] = (r.g, r.h)
    return out


def _best(by_feature: dict, limits: dict) -> tuple[tuple | None, float]:
    """The split of a node with the largest gain, with the values of its sides; and the node's own value."""
    leaf = lambda g, h: round(-RATE * g / (h + PENALTY), 6)
    if not by_feature:
        return None, 0.0
    first = by_feature[min(by_feature)]
    total_g, total_h = math.fsum(g for g, _ in first.values()), math.fsum(h for _, h in first.values())
    best, gain = None, 1e-3
    for name in sorted(by_feature):
        g = h = 0.0
        for limit in limits[name]:
            dg, dh = by_feature[name].get(limit, (0.0, 0.0))
            g, h = g + dg, h + dh
            if min(h, total_h - h) < 1.0:
                continue
            better = round(g * g / (h + PENALTY) + (total_g - g) ** 2 / (total_h - h + PENALTY) - total_g**2 / (total_h + PENALTY), 6)
            if better > gain:
                best, gain = (name, float(limit), leaf(g, h), leaf(total_g - g, total_h - h)), better
    return best, leaf(total_g, total_h)


def _built(at: int, splits: dict, values: dict):
    if at not in splits:
        return float(values.get(at, 0.0))
    return (*splits[at], _built(2 * at, splits, values), _built(2 * at + 1, splits, values))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for said, rule in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    rows = rows.withColumn("told", verdict)
    labelled = rows.where("told is not null").select(F.col("page_id").alias("id"), "url", "host", "path", (F.col("told") == "block").cast("int").alias("label"))
    model = learn(labelled)
    scored = model.with_statistics(lexical(rows))
    by_method = F.when(model.score() > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("told", by_method).alias("verdict"), (1 / (1 + F.exp(-model.score()))).alias("score"))


def rules_sql(rules=RULES) -> str:
    """Hosts, paths and rules in DuckDB SQL."""
    cases = ""
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, start = rule.split("/", 1)
        cases += f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{rule}'"
    return rf"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE{cases} END AS rule FROM p"""
