"""Approximate nearest neighbours with randomly rotated one-bit codes.

Every vector is rotated by one random orthonormal matrix per dimension and kept
as the signs of its coordinates, packed into 64-bit words, with two scalars: its
norm and the cosine between the rotated vector and its signs. A query's rotated
coordinates are rounded to QUERY_BITS bits and kept as as many packed planes, so
that its product with a code is a weighted count of common bits. That gives an
estimate of the inner product and a bound of its error. Vectors are scanned in
chunks; of a query's first chunk the FIRST best by estimate are scored to have a
limit, afterwards its twentieth best score so far is the limit, and codes whose
upper bound reaches the limit are reranked with their original vectors.

A stated query set is compared with all rows in blocks: a block of queries, of
QUERY_BYTES at most, is broadcast, and the codes and vectors are scanned where
they lie. No vector is shuffled; a task's state is its block's best neighbours.

Scores are the inner products of the original vectors in double precision,
summed in the order of the components. Lengths are taken apart from directions,
so that neither very large nor very small components overflow or vanish. A
product that isn't a number, as sums of opposite overflows give, counts as least.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors of different
dimensions aren't compared; rows that share an id are queries and candidates
each for itself; ties go to the smaller id, also between any number of equal
vectors; an empty table gives no rows. Other columns of the input play no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import common as C

TOP = 20
#: Bytes of the query vectors that are broadcast at a time, and codes that are searched at a time.
QUERY_BYTES, CODE_BLOCK = 32 << 20, 16384
QUERY_BITS = 4
#: The error bound in standard deviations or so; 1.9 is usual, more costs rerankings and loses fewer neighbours.
EPSILON = 3.0
#: Candidates per query that are scored before its first limit is known.
FIRST = 64
#: Rounding of products in double and single precision, in parts of the lengths; smaller products may have lost digits.
ROUNDING, SINGLE, VANISHED = 1e-12, 1e-5, 1e-290
_PAIRS = 512


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(4 + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; the largest component is divided out before anything is squared."""
    most = np.abs(vectors).max(axis=1)
    scaled = vectors / most[:, None]
    length = np.sqrt((scaled * scaled).sum(axis=1))
    with np.errstate(over="ignore"):
        return scaled / length[:, None], most * length


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words, word by word."""
    packed = np.packbits(bits, axis=-1)
    packed = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)])
    return np.ascontiguousarray(np.moveaxis(packed.view(np.uint64), -1, 0))


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms and cosines of rows of vectors."""
    units, norms = directions(vectors)
    turned = units @ rotation(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), norms, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


class Queries:
    """Vectors of one dimension, rotated and rounded: coordinates are low + step * (the number in the planes)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: int) -> None:
        self.rows, self.ids, self.vectors, self.top = rows, ids, vectors, top
        n, self.d = vectors.shape
        units, self.norms = directions(vectors)
        self.short = units.astype(np.float32)
        turned = units @ rotation(self.d)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        near = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.lost = np.sqrt(((self.low[:, None] + self.step[:, None] * near - turned) ** 2).sum(axis=1))
        self.sums = near.sum(axis=1, dtype=np.int64)
        self.planes = [words((near >> j) & 1) for j in range(QUERY_BITS)]
        self.place = {int(r): k for k, r in enumerate(rows)}
        self.best_ids, self.best = np.full((n, top), np.iinfo(np.int64).max), np.full((n, top), -np.inf)
        self.found = np.zeros(n, np.int64)

    def counts(self, k: int, bits: np.ndarray) -> np.ndarray:
        """Sums of query k's rounded coordinates where codes have a bit, by counting the bits common with its planes."""
        out = np.zeros(bits.shape[1], np.int32)
        for j, planes in enumerate(self.planes):
            for w, word in enumerate(bits):
                out += np.bitwise_count(word & planes[w, k]).astype(np.int32) << j
        return out

    def search(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, packed: np.ndarray, norms: np.ndarray, cosines: np.ndarray) -> int:
        """Take a chunk of codes into account; the number of pairs that were reranked."""
        d, top = self.d, self.top
        packed = np.pad(packed, [(0, 0), (0, -packed.shape[1] % 8)])
        bits = np.ascontiguousarray(packed.view(np.uint64).T)
        ones = np.bitwise_count(bits).sum(axis=0, dtype=np.int32)
        # in parts of the largest norm and the query's, single precision reaches; its rounding is in the bound
        norms = np.minimum(norms, np.finfo(np.float64).max)
        most = norms.max()
        size = norms / most / cosines
        unit = (size / np.sqrt(d)).astype(np.float32)
        unit_ones = unit * ones
        width = EPSILON * (np.sqrt(np.maximum(1 - cosines**2, 0) / max(d - 1, 1)) + self.lost.max() / np.sqrt(d))
        width = (width * size + SINGLE * (1 + size)).astype(np.float32)
        units, lengths = directions(vectors)[0].astype(np.float32), (norms / most).astype(np.float32)
        own = {self.place[int(r)]: c for c, r in enumerate(rows) if int(r) in self.place}
        reranked = 0
        for k in range(len(self.ids)):
            query = self.vectors[k]
            guess = np.multiply(self.counts(k, bits), np.float32(2 * self.step[k]), dtype=np.float32)
            guess -= np.float32(d * self.low[k] + self.step[k] * self.sums[k])
            guess *= unit
            guess += np.float32(2 * self.low[k]) * unit_ones
            if k in own:
                guess[own[k]] = -np.inf
            with np.errstate(over="ignore", invalid="ignore"):
                limit = self.best[k, -1]
                if self.found[k] < top and len(ids) > FIRST + 1:
                    near = np.argpartition(guess, len(ids) - FIRST)[-FIRST:]
                    near = near[near != own[k]] if k in own else near
                    reached = vectors[near] @ query - ROUNDING * norms[near] * self.norms[k]
                    limit = max(limit, np.partition(reached, len(near) - top)[len(near) - top]) if len(near) >= top else limit
                # a limit that has overflowed or vanished tells nothing of the order
                bar = limit / self.norms[k] / most if np.isfinite(limit) and abs(limit) > VANISHED else -np.inf
                guess += width
                chosen = guess >= np.float32(bar)
                if k in own:
                    chosen[own[k]] = False
                chosen = np.flatnonzero(chosen)
                if len(chosen) > top:
                    short = np.take(units, chosen, axis=0) @ self.short[k]
                    chosen = chosen[short * lengths[chosen] >= np.float32(bar) - np.float32(SINGLE)]
                reached, slack = vectors[chosen] @ query, ROUNDING * norms[chosen] * self.norms[k]
                fine = ~(reached + slack < limit)
                chosen, reached, slack = chosen[fine], reached[fine], slack[fine]
                if len(chosen) > 4 * top:
                    low = reached - slack
                    chosen = chosen[~(reached + slack < np.partition(low, len(low) - top)[len(low) - top])]
                if not len(chosen):
                    continue
                scores = exact(self.vectors, vectors, np.full(len(chosen), k), chosen)
            reranked += len(chosen)
            had = self.found[k]
            every = np.concatenate((self.best[k, :had], scores))
            who = np.concatenate((self.best_ids[k, :had], ids[chosen]))
            order = np.lexsort((who, -ordered(every)))[:top]
            self.found[k] = len(order)
            self.best[k, : len(order)], self.best_ids[k, : len(order)] = every[order], who[order]
        return reranked

    def results(self) -> pa.RecordBatch:
        has = np.arange(self.top) < self.found[:, None]
        n = self.found
        arrays = [np.repeat(self.rows, n), np.repeat(self.ids, n), self.best_ids[has], self.best[has]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["query_row", "query_id", "vec_id", "score"])


def ordered(scores: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(scores), -np.inf, scores)


def exact(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, in double precision, first component first."""
    out = np.empty(len(a))
    for at in range(0, len(a), _PAIRS):
        x, y = left[a[at : at + _PAIRS]], right[b[at : at + _PAIRS]]
        total = np.zeros(len(x))
        for k in range(x.shape[1]):
            total += x[:, k] * y[:, k]
        out[at : at + _PAIRS] = total
    return out


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index: row, id, d, v, bits, norm, cosine of every usable row, written."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull()).where(usable(F.col("v")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                v = flat.reshape(-1, d) if len(at) == len(sizes) else np.stack([np.array(lists[int(k)].as_py()) for k in at])
                bits, norms, cosines = codes(v)
                arrays = [ids.take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norms), pa.array(cosines)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "d", "v", "bits", "norm", "cosine"])

    index = rows.mapInArrow(encode, "id long, d int, v binary, bits binary, norm double, cosine double")
    return C.staged(index.withColumn("row", F.monotonically_increasing_id()), "codes")


def _read(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t[column].to_pylist()), kind).reshape(t.num_rows, -1)


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    C.ready(spark)
    index = coded(vectors, id_col, vector_col)
    asked = index.where(F.col("id") % every == 0)
    size = asked.agg(F.coalesce(F.sum(F.col("d") * 8), F.lit(0))).first()[0]
    blocks = -(-size // QUERY_BYTES) or 1
    done = []
    for k in range(blocks):
        few = asked.where(F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(blocks)) == k).select("row", "id", "d", "v").toArrow()  # about QUERY_BYTES
        done.append(index.mapInArrow(_searching(spark.sparkContext.broadcast(few), top), "query_row long, query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc(F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))), "vec_id")
    got = reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(order))
    return got.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _searching(few, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, waiting = {}, {}
        for d in few.value["d"].unique().to_pylist():
            t = few.value.filter(pa.compute.equal(few.value["d"], d))
            asked[d] = Queries(t["row"].to_numpy(), t["id"].to_numpy(), _read(t, "v", np.float64), top)

        def work(d: int) -> None:
            t = pa.Table.from_batches(waiting.pop(d))
            asked[d].search(t["row"].to_numpy(), t["id"].to_numpy(), _read(t, "v", np.float64), _read(t, "bits", np.uint8), t["norm"].to_numpy(), t["cosine"].to_numpy())

        for b in batches:
            for d in b.column("d").unique().to_pylist():
                if d in asked:
                    waiting.setdefault(d, []).append(b.filter(pa.compute.equal(b.column("d"), d)))
                    if sum(x.num_rows for x in waiting[d]) >= CODE_BLOCK:
                        work(d)
        for d in list(waiting):
            work(d)
        for q in asked.values():
            yield q.results()

    return search


def oracle(every: int = 20, top: int = TOP) -> str:
    """Brute force in DuckDB SQL."""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.n, q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
  FROM v AS q JOIN v ON q.vec_id % {every} = 0 AND q.n <> v.n AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {top}"""
