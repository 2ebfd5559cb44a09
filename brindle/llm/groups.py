"""Joins with hot keys, connected components by alternating stars, and streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C


#: Keys with more rows than this are hot; of all rows no more than one in MOST_HOT keys can be, as the limit grows with the table.
SPLIT, MOST_HOT = 512, 1_000_000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with a table that has one row a key, and in _n the number of rows with that key.

    Both are written tables. Rows of hot keys stay where they are and meet the
    table's few hot rows by broadcast, the others are shuffled by key.
    """
    most, total = table.agg(F.max("_n"), F.sum("_n")).first()
    if not most or most <= SPLIT:
        return rows.join(table.drop("_n"), keys)
    limit = max(SPLIT, total // MOST_HOT)
    hot, rest = (table.where(c).drop("_n") for c in (F.col("_n") > limit, F.col("_n") <= limit))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). node and root, its component's least node, for every node of an edge.

    Large-star and small-star steps in turn: each replaces a node's edges by
    edges to the least neighbour. The edge list is written every round and
    never grows; the rounds end when it no longer changes. The edges of a
    star's centre don't meet in one task.
    """
    edges = C.staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    told = _digest(edges)
    for _ in range(most_rounds):
        with C.scratch() as keep:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            # no node has more edges later in the round than now
            hot = (both.groupBy("a").count().agg(F.max("count")).first()[0] or 0) > SPLIT
            meet = (lambda rows, table: spread_join(rows, C.staged(table, "stars"), ["a"])) if hot else (lambda rows, table: rows.join(table.drop("_n"), "a"))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n"))
            large = meet(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = C.staged(large, "large")
            small = meet(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            edges = keep(C.staged(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "edges"))
        was, told = told, _digest(edges)
        if was == told:
            break
    else:
        raise RuntimeError("components didn't converge")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def over_groups(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable:
    """For mapInArrow over rows sorted by keys: calls work once with each whole group, one group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, out, n = None, [], 0
        for b in batches:
            rows = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            at = 0
            for k in range(1, len(rows) + 1):
                if k < len(rows) and rows[k] == rows[at]:
                    continue
                if key is not None and rows[at] != key:
                    if (got := work(pa.Table.from_batches(held))) is not None:
                        out.append(got)
                        n += got.num_rows
                    held = []
                key = rows[at]
                held.append(b.slice(at, k - at))
                at = k
            if n > 4096:
                yield from out
                out, n = [], 0
        if held and (got := work(pa.Table.from_batches(held))) is not None:
            out.append(got)
        yield from out

    return run
