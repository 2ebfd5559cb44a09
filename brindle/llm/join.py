"""N-gram Jaccard join: all pairs of texts whose five-word shingle sets are similar.

1. Every text becomes the set of its hashed shingles; texts with equal sets are
   one representative with a multiplicity, so copies are never compared.
2. MinHash values of the representatives in bands propose buckets. Buckets with
   the same members count once, single ones go.
3. In a bucket MinHash values are compared 16 at a time; a pair whose posterior
   probability of reaching the threshold (uniform prior) falls below TOLERANCE
   is dropped. Surviving pairs connect components; only spanning edges leave a
   task. Large buckets are compared block against block.
4. Pairs are verified exactly on whole shingle sets, block against block, by
   counting common shingles: all pairs of a component, or, in a component of more
   than a block whose buckets have fewer pairs than it has, all pairs of each
   bucket, where a link counts in the first bucket that both texts are in. So
   chains of candidates aren't compared end to end. Each representative gets the
   number of documents it is linked with; exact links make the classes.

No pair list leaves a task, so the output stays at one row per document; the
work in a group of n different near copies is n * n / 2 comparisons in blocks,
which exact numbers of links ask for.

Defined cases: a null text, or one without words, has no links and is its own
class; a text of one to four words counts as one shingle of all its words; a
null id takes part, its class being the least id in it (null if there is none);
repeated rows are documents linked with each other; an empty table gives no
rows. Other columns of the input play no part in links, whatever their names;
first_of_each_class keeps them.

Candidate recall: with 24 bands of 4 values a pair at similarity 0.8 shares no
bucket with probability 4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import common as C
from brindle.llm.groups import components, over_groups, spread_join

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 24, 4, 16
TOLERANCE = 1e-6
#: Members of a bucket, and of a component, that are compared in one task at a time are at most two blocks.
BUCKET_BLOCK, TEXT_BLOCK = 1024, 384
_N = BANDS * ROWS
_random = np.random.default_rng(5)
_A = _random.integers(1, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(1, 1 << 63, _N, dtype=np.uint64)
_COLUMNS = 1024
#: Up to so many row keys (of some 20 bytes) are broadcast to find their documents; beyond, documents are shuffled by key.
BROADCAST_KEYS = 1_000_000


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = C.word_hashes(text or "")
    if 0 < len(words) < n:
        return C.shingle_hashes(words, len(words))
    return np.unique(C.shingle_hashes(words, n))


def minima(grams: np.ndarray) -> np.ndarray:
    out = np.full(_N, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(grams), _COLUMNS):
        part = grams[at : at + _COLUMNS] * _A[:, None]
        part += _B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, for comparing."""
    return (C.mix64(values) >> np.uint64(48)).astype(np.uint16)


def band_hashes(values: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = C.mix64(h * np.uint64(0x9E3779B97F4A7C15) + values.reshape(BANDS, ROWS)[:, k])
    return h.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... compared values: with fewer matches the posterior of reaching the threshold is below the tolerance."""
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(STEP, _N + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(s) + (n - m) * np.log(1 - s)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        reach = p[:, s >= threshold].sum(axis=1) / p.sum(axis=1)
        out.append(int(np.argmax(reach >= tolerance)))
    return out


def survivors(left: np.ndarray, right: np.ndarray, least: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks of signatures that no step drops; of one block, each pair once."""
    rows, cols = [], []
    for at in range(0, len(left), 256):  # bounded intermediate matrices
        part = left[at : at + 256]
        matches = np.zeros((len(part), len(right)), np.uint8)
        for k in range(STEP):
            matches += part[:, k, None] == right[None, :, k]
        a, b = np.nonzero(matches >= least[0])
        a += at
        if same:
            a, b = a[a < b], b[a < b]
        n = matches[a - at, b].astype(np.int32)
        for step in range(1, len(least)):
            if not len(a):
                break
            here = slice(step * STEP, (step + 1) * STEP)
            for lo in range(0, len(a), 1 << 16):
                n[lo : lo + (1 << 16)] += (left[a[lo : lo + (1 << 16)], here] == right[b[lo : lo + (1 << 16)], here]).sum(axis=1)
            keep = n >= least[step]
            a, b, n = a[keep], b[keep], n[keep]
        rows.append(a)
        cols.append(b)
    return np.concatenate(rows), np.concatenate(cols)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n places joined by pairs, the least place each is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def common_counts(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set the places, among the values that two sets or more have, of its values: as one array with offsets."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    keep = often[at]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep]
    return owner, place[at[keep]]


def links(sets: list[np.ndarray], split: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose Jaccard similarity reaches the threshold: across the split, or all if it is 0."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, place = common_counts(sets)
    upper, lower = (slice(0, split), slice(split, len(sets))) if split else (slice(0, len(sets)),) * 2
    common = np.zeros((len(sizes[upper]), len(sizes[lower])), np.float32)
    width = int(place.max()) + 1 if len(place) else 0
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(place, [lo, lo + 4096])
        has = np.zeros((len(sets), min(4096, width - lo)), np.float32)
        has[owner[a:b], place[a:b] - lo] = 1
        common += has[upper] @ has[lower].T
    either = sizes[upper][:, None] + sizes[lower][None, :] - common
    # the counts are whole numbers below 2**24 and exact in float32; the quotient is taken in double precision
    a, b = np.nonzero(common.astype(np.float64) >= threshold * either.astype(np.float64) - 1e-9)
    if split:
        return a, b + split
    return a[a < b], b[a < b]


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text; rows that share one count as equal (by chance some two dozen pairs among 30 billion rows)."""
    return F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col))


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rk, doc_id, n, h1, h2 (digest of the shingle set), sig, bands of every document; the last two null without shingles."""
    C.ready(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sigs, bands = [], [], [], [], []
            for text in b.column(2):
                grams = shingles(text.as_py())
                n.append(len(grams))
                mixed = C.mix64(grams)
                h1.append(int(mixed.sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(C.mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                if len(grams):
                    values = minima(grams)
                    sigs.append(signature(values).tobytes())
                    bands.append(band_hashes(values).tolist())
                else:
                    sigs.append(None)
                    bands.append(None)
            arrays = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rk", "doc_id", "n", "h1", "h2", "sig", "bands"])

    rows = docs.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return C.on_all_cores(rows).mapInArrow(sign, "rk long, doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>")


def in_blocks(rows: DataFrame, group: str, size: Column, key: str, block: int) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: bi <= bj say which pair, mine which of the two blocks a row is of."""
    n = F.ceil(size / F.lit(block)).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(F.lit(9), key), n.cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), n - 1))
    rows = rows.withColumn("_other", other)
    return rows.withColumn("bi", F.least("mine", "_other")).withColumn("bj", F.greatest("mine", "_other")).drop("_other")


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """rows: bucket, rk. bucket and size of those with two members or more, one for each set of members."""
    whole = F.col("rk").cast("decimal(20,0)")
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64(F.lit(1), "rk")).alias("x"), F.sum(F.xxhash64(F.lit(2), "rk").cast("decimal(20,0)")).alias("y"), F.min(whole).alias("z"))
    return buckets.where("size > 1").groupBy("size", "x", "y", "z").agg(F.min("bucket").alias("bucket")).select("bucket", "size")


def in_buckets(reps: DataFrame) -> DataFrame:
    """reps: rk, bands. bucket, rk, size of every representative in a bucket that counts."""
    rows = reps.select("rk", F.explode("bands").alias("bucket"))
    buckets = C.staged(distinct_buckets(rows).withColumn("_n", F.col("size")), "sizes")
    return C.staged(spread_join(rows, buckets, ["bucket"]).select("bucket", "rk", "size"), "buckets")


def candidates(reps: DataFrame, placed: DataFrame) -> DataFrame:
    """reps: rk, sig. Spanning edges a, b between representatives that may be similar."""
    dealt = in_blocks(placed, "bucket", F.col("size"), "rk", BUCKET_BLOCK).select("bucket", "bi", "bj", "mine", "rk")
    dealt = dealt.join(reps.select("rk", "sig"), "rk")
    least = least_matches()

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        rk = group["rk"].to_numpy()
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, _N)
        bi, bj, mine = group["bi"][0].as_py(), group["bj"][0].as_py(), group["mine"].to_numpy()
        if bi == bj:
            a, b = survivors(sig, sig, least, True)
        else:
            left, right = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
            a, b = survivors(sig[left], sig[right], least, False)
            a, b = left[a], right[b]
        if not len(a):
            return None
        root = spanning(a, b, len(rk))
        on = np.flatnonzero(root != np.arange(len(rk)))
        return pa.RecordBatch.from_arrays([pa.array(rk[on]), pa.array(rk[root[on]])], ["a", "b"])

    keys = ["bucket", "bi", "bj"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(over_groups(keys, compare), "a long, b long")


def compared(placed: DataFrame, found: DataFrame) -> DataFrame:
    """found: node, root of candidates' components. Who is compared with whom: part, grp, size, rk, kept.

    part 0: grp is a component. part 1: grp is a bucket within one, kept all such buckets of the row.
    """
    sizes = C.staged(found.groupBy("root").agg(F.count("*").alias("size")).withColumn("_n", F.col("size")), "sizes")
    members = C.staged(spread_join(found, sizes, ["root"]).select(F.col("node").alias("rk"), F.col("root").alias("comp"), "size"), "members")
    whole = members.select(F.lit(0).alias("part"), F.col("comp").alias("grp"), "size", "rk", F.lit(None).cast("array<long>").alias("kept"))
    large = members.where(F.col("size") > TEXT_BLOCK)
    if large.isEmpty():
        return whole
    inner = C.staged(placed.select("bucket", "rk").join(large, "rk").select("comp", F.col("size").alias("all"), F.xxhash64("comp", "bucket").alias("bucket"), "rk"), "inner")
    buckets = C.staged(distinct_buckets(inner.select("bucket", "rk")).withColumn("_n", F.col("size")), "sizes")
    inner = C.staged(spread_join(inner, buckets, ["bucket"]), "inner")
    sparse = inner.groupBy("comp", "all").agg(F.sum("size").alias("work")).where(F.col("work") < F.col("all") * F.col("all")).select("comp")
    sparse = _sized(C.staged(sparse, "sparse"))  # a row for each large component
    inner = C.staged(inner.join(sparse, "comp", "left_semi"), "inner")
    kept = inner.groupBy("rk").agg(F.array_sort(F.collect_list("bucket")).alias("kept"))  # BANDS entries at most
    parts = inner.join(kept, "rk").select(F.lit(1).alias("part"), F.col("bucket").alias("grp"), "size", "rk", "kept")
    return whole.join(sparse.withColumnRenamed("comp", "grp"), "grp", "left_anti").select(*parts.columns).unionByName(parts)


def _firsts(kept: list, a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Of pairs of rows those whose first common bucket is this one."""
    info = np.iinfo(np.int64)
    width = max(map(len, kept))
    left, right = np.full((len(kept), width), info.max), np.full((len(kept), width), info.min)
    for k, x in enumerate(kept):
        left[k, : len(x)] = right[k, : len(x)] = x
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        x, y = left[a[at : at + (1 << 14)]], right[b[at : at + (1 << 14)]]
        common = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[at : at + (1 << 14)] = x[np.arange(len(x)), common.argmax(axis=1)] == bucket
    return out


def verified(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """texts: part, grp, size, rk, kept, m, text. Rows rk, linked (documents), root (a similar representative)."""

    def verify(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        mine, bi, bj = group["mine"].to_numpy(), group["bi"][0].as_py(), group["bj"][0].as_py()
        order = np.argsort(mine, kind="stable")
        split = 0 if bi == bj else int((mine == bi).sum())
        if bi != bj and split in (0, len(mine)):
            return None
        rk, m = group["rk"].to_numpy()[order], group["m"].to_numpy()[order]
        sets = [shingles(group["text"][int(k)].as_py()) for k in order]
        a, b = links(sets, split, threshold)
        if len(a) and group["part"][0].as_py():
            kept = group["kept"].to_pylist()
            first = _firsts([kept[k] for k in order], a, b, group["grp"][0].as_py())
            a, b = a[first], b[first]
        if not len(a):
            return None
        linked = np.bincount(a, weights=m[b], minlength=len(rk)) + np.bincount(b, weights=m[a], minlength=len(rk))
        root = spanning(a, b, len(rk))
        on = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(rk[on]), pa.array(linked[on].astype(np.int64)), pa.array(rk[root[on]])], ["rk", "linked", "root"])

    keys = ["part", "grp", "bi", "bj"]
    dealt = in_blocks(texts, "grp", F.col("size"), "rk", TEXT_BLOCK).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "mine", "rk", "m", "kept", "text").mapInArrow(over_groups(keys, verify), "rk long, linked long, root long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """rk, doc_id, rep (the representative's row key; null without words), class (a key), class_id, n_links of every document."""
    rows = C.staged(signed(docs, id_col, text_col), "signed")
    with C.scratch() as keep:
        reps = rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("rk", "sig", "bands")).alias("x"), F.count("*").alias("m"), F.min("doc_id").alias("first_id"))
        reps = C.staged(reps.select("h1", "h2", "n", "x.*", "m", "first_id"), "reps")
        placed = in_buckets(reps)
        found = C.staged(components(C.staged(candidates(reps, placed), "candidates")), "components")
        members = _sized(C.staged(compared(placed, found).join(reps.select("rk", "m"), "rk"), "members"))
        texts = docs.select(row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text")).join(members, "rk")
        texts = texts.dropDuplicates(["rk", "part", "grp"]) if _repeats(rows) else texts
        exact = C.staged(verified(texts, threshold), "links")
        linked = exact.groupBy("rk").agg(F.sum("linked").alias("linked"))
        roots = components(exact.select(F.col("rk").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rk"), "root")
        told = reps.join(linked, "rk", "left").join(roots, "rk", "left")
        told = C.staged(told.select("h1", "h2", "n", F.col("rk").alias("rep"), "first_id", "m", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rk").alias("class"), F.col("root").isNotNull().alias("joined")), "told")
        # only classes of several representatives need a look at their members
        alone, several = told.where("not joined"), told.where("joined")
        least = C.staged(several.groupBy("class").agg(F.min("first_id").alias("class_id"), F.count("*").alias("_n")), "least")
        names = ["h1", "h2", "n", "rep", "class", "class_id", "n_links", F.col("m").alias("_n")]
        told = spread_join(several, least, ["class"]).select(*names).unionByName(alone.withColumn("class_id", F.col("first_id")).select(*names))
        told = keep(C.staged(told, "told"))
    full = spread_join(rows.where("n > 0").select("rk", "doc_id", "n", "h1", "h2"), told, ["h1", "h2", "n"])
    full = full.select("rk", "doc_id", "rep", "class", "class_id", F.col("n_links").cast("long").alias("n_links"))
    empty = rows.where("n = 0").select("rk", "doc_id", F.lit(None).cast("long").alias("rep"), F.col("rk").alias("class"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)


def _sized(keys: DataFrame) -> DataFrame:
    """A written table of row keys, to be broadcast if it is small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _repeats(rows: DataFrame) -> bool:
    """Whether equal rows occur, which would give a representative's text more than once."""
    return not rows.groupBy("rk").count().where("count > 1").isEmpty()



def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    return classes(docs, id_col, text_col, threshold).select("doc_id", "class_id", "n_links")


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that are linked, directly or by others, with one of a lesser id; with all their columns.

    Of rows with the same id and text one stays, the same on every run.
    """
    told = C.staged(classes(docs, id_col, text_col, threshold), "classes")
    several = told.groupBy("class").agg(F.count("*").alias("_n"), F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "rk")).alias("first")).where("_n > 1")
    rows = spread_join(told, C.staged(several, "several"), ["class"]).select("rk", (F.col("rk") == F.col("first.rk")).alias("stays"))
    key = "_rk"
    while key in map(str.lower, docs.columns):
        key += "_"
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    # a row that is equal to the one that stays shares its key
    lost = C.staged(rows.where("not stays").select(F.col("rk").alias(key)).distinct(), "lost")
    kept = keyed.join(_sized(lost), key, "left_anti")
    twice = C.staged(told.where("rep is not null").groupBy(F.col("rk").alias(key)).count().where("count > 1").select(key), "twice")
    if not twice.isEmpty():  # equal rows share a key: one of them stays
        twice = _sized(twice)
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = kept.join(twice, key, "left_semi").groupBy(key).agg(F.min_by(whole.alias("doc"), F.xxhash64(F.to_json(whole))).alias("doc"))
        kept = kept.join(twice, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(one.select("doc.*"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(threshold: float = THRESHOLD) -> str:
    """All pairs that share a shingle, in DuckDB SQL."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS k FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[k:k + {WORDS - 1}], ' ') AS g FROM i),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE c >= {threshold} * (x.n + y.n - c) - 1e-9),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r, r AS q FROM d UNION SELECT t.r, e.b FROM t JOIN e ON t.q = e.a),
c AS (SELECT t.r, min(d.doc_id) AS class_id FROM t JOIN d ON t.q = d.r GROUP BY t.r)
SELECT d.doc_id, c.class_id, (SELECT count(*) FROM e WHERE e.a = d.r) AS n_links FROM d JOIN c ON d.r = c.r"""
