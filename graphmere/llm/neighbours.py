"""Most similar vectors for every vector: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from math import acos, ceil, log, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmere.operators.joins import spread_join
from graphmere.session import sized, stage

DIM = 64
#: A bucket with more rows is cut into blocks of about so many, so that no task gets an unbounded one.
FULL_BUCKET = 5000
SKETCH_BITS = 128
HOT_ROWS = 200_000
#: The least probability with which a pair just as alike as asked for shares a probed bucket, at any size.
LEAST_HIT = 0.95


@dataclass(frozen=True)
class Index:
    """p-stable hash tables: ``tables`` of ``functions`` each, of width ``width``, with ``probes`` buckets a query."""

    functions: int
    tables: int = 3
    width: float = 3.0
    probes: int = 10
    dim: int = DIM
    seed: int = 7

    @staticmethod
    def for_rows(n: int, dim: int = DIM, least: float = 0.92) -> Index:
        """Functions grow with the logarithm of the rows, so that a bucket holds about as many far vectors at any size.

        Tables grow with the functions, so that a pair of similarity ``least`` is found with LEAST_HIT at any size.
        """
        one = Index(functions=max(6, ceil(1.75 * log(max(n, 2)))), tables=1, dim=dim)
        return replace(one, tables=max(3, ceil(log(1 - LEAST_HIT) / log(1 - hit_probability(one, least)))))


def usable_vectors(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, v): of each (page_id, ord) the row with the lowest chunk_id, if its vector is usable.

    Usable is a vector of ``dim`` finite numbers that are not all zero. Null keys form a key of their own. Only
    keys are shuffled to find what is repeated.
    """
    chunks = chunks.select("chunk_id", "page_id", "ord", "embedding")
    first = chunks.groupBy("page_id", "ord").agg(F.min("chunk_id").alias("keep"), F.count("*").alias("n"))
    first = first.filter("n > 1").select(F.col("page_id").alias("p"), F.col("ord").alias("o"), "keep")
    lost = chunks.join(first, F.col("page_id").eqNullSafe(F.col("p")) & F.col("ord").eqNullSafe(F.col("o"))).filter("chunk_id != keep")
    lost = sized(stage(lost.select("chunk_id")), HOT_ROWS)
    e = F.col("embedding")
    fine = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return chunks.filter(e.isNotNull() & F.coalesce(fine, F.lit(False))).join(lost, "chunk_id", "left_anti").select(F.col("chunk_id").alias("id"), e.alias("v"))


def probe_order(functions: int, probes: int) -> list[list[int]]:
    """Sets of ranks, in the order of their estimated success.

    Rank j stands for the j-th nearest of a vector's 2 * functions bucket borders; the expected squared
    distances of these give each set its score. Both borders of one function are never in one set.
    """
    m = functions
    score = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[list[int]] = [[]]
    heap = [(score[0], [0])]
    while heap and len(out) < probes:
        _, s = heapq.heappop(heap)
        if len({min(x, 2 * m - 1 - x) for x in s}) == len(s):
            out.append(s)
        if (top := s[-1]) + 1 < 2 * m:
            for t in ([*s[:-1], top + 1], [*s, top + 1]):
                heapq.heappush(heap, (sum(score[x] for x in t), t))
    return out


@cache
def hit_probability(index: Index, least: float, trials: int = 20_000) -> float:
    """How likely a pair of similarity ``least`` shares a probed bucket of one table, found from either side.

    Simulated with a fixed seed, less two standard errors. Tables are independent of each other.
    """
    import numpy as np

    rng = np.random.default_rng(index.seed)
    x = rng.random((trials, index.functions))
    y = x + rng.standard_normal(x.shape) * sqrt(max(0.0, 2 - 2 * least)) / index.width
    step = np.floor(y)
    found = np.zeros(trials, bool)
    for part, move in ((x, step), (y - step, -step)):
        near = np.argsort(np.concatenate([part, 1 - part], 1), 1)
        needed = np.take_along_axis(np.concatenate([move == -1, move == 1], 1), near, 1)
        reached = (np.abs(move) < 2).all(1)
        for s in probe_order(index.functions, index.probes):
            found |= reached & (needed.sum(1) == len(s)) & needed[:, s].all(1)
    p = float(found.mean())
    return min(max(p - 2 * sqrt(p * (1 - p) / trials), 1 / trials), 1 - 1e-9)


def _hash_batches(index: Index, queries: bool):
    """Arrow batches of (id, v) to (bucket, id, s0, s1), with a sketch of signs: the home buckets, or all probed ones of ``queries``."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(index.seed)
        m, tables = index.functions, index.tables
        a = rng.standard_normal((index.dim, m * tables)).astype(np.float32)
        shift = rng.uniform(0, index.width, m * tables).astype(np.float32)
        mix = rng.integers(1, 2**63 - 1, m * tables, dtype=np.int64) | 1
        salt = rng.integers(1, 2**63 - 1, tables, dtype=np.int64)
        planes = rng.standard_normal((index.dim, SKETCH_BITS)).astype(np.float32)
        weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
        order = probe_order(m, index.probes)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, index.dim).astype(np.float64)
            v = (v / np.abs(v).max(1, keepdims=True)).astype(np.float32)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            signs = (v @ planes > 0).astype(np.uint64)
            low64, high64 = ((signs[:, x : x + 64] @ weights).view(np.int64) for x in (0, 64))
            x = (v @ a + shift) / index.width
            low = np.floor(x)
            part = (x - low).reshape(-1, tables, m)
            home = (low.astype(np.int64) * mix).reshape(-1, tables, m).sum(2) + salt
            if queries:
                border = np.concatenate([part, 1 - part], 2) ** 2
                move = np.concatenate([-mix.reshape(1, tables, m), mix.reshape(1, tables, m)], 2)
                near = np.argsort(border, 2)
                step = np.take_along_axis(np.broadcast_to(move, near.shape), near, 2)
                home = np.stack([home + step[:, :, s].sum(2) if s else home for s in order], 2)
            keys = home.reshape(len(ids), -1)
            each = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), *(pa.array(np.repeat(c, each)) for c in (ids, low64, high64))], names=["bucket", "id", "s0", "s1"])

    return run


def hash_rows(vectors: DataFrame, index: Index, queries: bool) -> DataFrame:
    return vectors.select("id", "v").mapInArrow(_hash_batches(index, queries), "bucket int, id long, s0 long, s1 long")


def _block_full(home: DataFrame, probe: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``cell``: in full buckets every block of home rows meets every block of probes, each pair once."""
    probes = probe.join(full, "bucket").groupBy("bucket").agg(F.count("*").alias("p"))
    blocks = lambda n: F.ceil(F.col(n) / FULL_BUCKET).cast("int")
    grid = full.join(probes, "bucket").select("bucket", blocks("n").alias("rows"), blocks("p").alias("columns"))
    grid = sized(stage(grid), HOT_ROWS)

    def spread(side: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        cell = lambda i: at * F.col("columns") + i if own == "rows" else i * F.col("columns") + at
        cells = F.when(F.col(own).isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col(other) - 1), cell))
        return side.join(grid, "bucket", "left").select("bucket", F.explode(cells).alias("cell"), "id", "s0", "s1")

    return spread(home, "rows", "columns"), spread(probe, "columns", "rows")


def sketch_bits(least: float) -> int:
    """In how many signs two vectors as alike as ``least`` differ, with four standard deviations on top."""
    p = acos(least) / pi
    return ceil(SKETCH_BITS * p + 4 * sqrt(SKETCH_BITS * p * (1 - p)))


def candidate_pairs(vectors: DataFrame, index: Index, least: float) -> DataFrame:
    """(a, b), a < b, distinct: vectors that share a probed bucket and whose sketches are near enough for ``least``."""
    home = hash_rows(vectors, index, False)
    full = stage(home.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > FULL_BUCKET))
    probe = hash_rows(vectors, index, True)
    keys = ["bucket"]
    if full.take(1):
        home, probe = _block_full(home, probe, sized(full, HOT_ROWS))
        keys.append("cell")
    q = probe.select(*keys, F.col("id").alias("q"), F.col("s0").alias("q0"), F.col("s1").alias("q1"))
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("q0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("q1")))
    near = apart <= sketch_bits(least)
    pairs = home.join(q, keys).filter((F.col("id") != F.col("q")) & near)
    return pairs.select(F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b")).distinct()


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def most_similar(chunks: DataFrame, k: int = 10, least: float = 0.92, index: Index | None = None) -> DataFrame:
    """(chunk_id, neighbour, similarity, rank): the up to ``k`` most similar chunks of each, at least ``least`` alike.

    Chunks with equal vectors form a class; the classes are searched through one representative, and of a
    class's own copies the ``k`` + 1 lowest ids stand for all, so copies are never paired with each other in
    full. Ties, by twelve digits, go to the lower id. Rows without a usable vector, repeated deliveries and further columns are
    ignored; an empty table gives an empty result. Beyond ``least`` the search is approximate: see Index.
    """
    vectors = usable_vectors(chunks)
    keyed = vectors.select("id", F.struct(F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).alias("h"))
    classes = keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    classes = stage(classes)
    copies = stage(spread_join(keyed, classes.select("h", "rep"), "h", "inner", counts=classes).select("id", "rep"))
    heads = vectors.join(sized(copies.filter("id != rep").select("id"), HOT_ROWS), "id", "left_anti")
    index = index or Index.for_rows(vectors.count(), least=least)
    pairs = stage(candidate_pairs(heads, index, least))
    wanted = sized(stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), HOT_ROWS)
    vectors = vectors.join(wanted, "id", "left_semi")
    va, vb = vectors.select(F.col("id").alias("a"), F.col("v").alias("x")), vectors.select(F.col("id").alias("b"), F.col("v").alias("y"))
    scored = pairs.join(va, "a").join(vb, "b").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 12).alias("similarity")).filter(F.col("similarity") >= least)
    scored = stage(scored)
    both = scored.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(scored.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    # The k + 1 lowest ids of each class, itself for a single: enough for any k neighbours other than oneself.
    low = Window.partitionBy("rep").orderBy("id")
    some = copies.withColumn("i", F.row_number().over(low)).filter(F.col("i") <= k + 1).select("rep", F.col("id").alias("neighbour"))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    both = both.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= k).drop("i")
    targets = both.join(some.withColumnRenamed("rep", "other"), "other", "left").select("id", F.coalesce("neighbour", "other").alias("neighbour"), "similarity")
    own = copies.select("rep").distinct().join(some, "rep").select(F.col("rep").alias("id"), "neighbour", F.lit(1.0).alias("similarity"))
    targets = targets.unionByName(own)
    wide = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    targets = targets.withColumn("i", F.row_number().over(wide)).filter(F.col("i") <= k + 1).drop("i")
    # A class's members are many and its targets few: the members are spread.
    members = spread_join(copies.select(F.col("rep").alias("id"), F.col("id").alias("member")), targets, "id", "inner", counts=classes.select(F.col("rep").alias("id"), "n")).drop("id").withColumnRenamed("member", "id")
    members = members.unionByName(targets.join(copies.select(F.col("rep").alias("id")).distinct(), "id", "left_anti"))
    members = members.filter("id != neighbour").withColumn("rank", F.row_number().over(wide)).filter(F.col("rank") <= k)
    return members.select(F.col("id").alias("chunk_id"), "neighbour", "similarity", "rank")
