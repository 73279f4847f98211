"""Near-duplicate records by multi-index hashing of min-hash fingerprints, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmere.operators.joins import spread_join
from graphmere.session import sized, stage

SMALL_ROWS = 200_000
#: A key with about so many records is full: they are paired block by block, each pair of blocks in a cell of its own.
FULL_KEY = 5000
#: Full keys are looked for among one record in so many; this decides how they are joined and not what is found.
LOOK = 50
#: The candidates' ids and cells are broadcast up to so many rows, so that no other texts are shuffled.
WANTED_ROWS = 1_000_000
#: Candidate pairs are verified in cells of about so many hashes.
CELL_HASHES = 100_000
#: Rows of one class that go to one task when classes are written out as pairs.
CLASS_ROWS = 20_000


@dataclass(frozen=True)
class Fingerprint:
    """``segments`` of ``symbols`` min-hash symbols each; any one symbol of a segment may differ.

    Two records with similarity s agree in a symbol with probability s. A segment's Hamming ball of radius one
    holds the other record with probability s^4 + 4 s^3 (1 - s), 0.475 at 0.6, and all ten miss it with
    probability 0.0016. The complete distance is taken over ``length`` symbols, of four bits each.
    """

    segments: int = 10
    symbols: int = 4
    length: int = 64
    seed: int = 11

    def least_agreement(self, least: float) -> int:
        """Equal symbols that records as alike as ``least`` have, less four standard deviations."""
        p = least + (1 - least) / 16
        return int(self.length * p - 4 * (self.length * p * (1 - p)) ** 0.5)


def record_words(title: Column, body: Column) -> Column:
    """Lower-case words of title and body."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(words: Column, size: int) -> Column:
    """The sorted set of hashes of all runs of ``size`` consecutive words."""
    at = lambda i, k: F.get(words, i + k)
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[at(i, k) for k in range(size)]))
    return F.sort_array(F.array_distinct(F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<long>"))))


def _fingerprints(kind: Fingerprint, least_words: int):
    """Arrow batches of (item, h1, h2, n, shingles, words) with the shingles replaced by the fingerprint: two bytes
    for each symbol of a segment, and four bits for each of all symbols in s0 to s3. Items of too few words are
    dropped here, so that the words are not cut out twice."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        rng = np.random.default_rng(kind.seed)
        mult = rng.integers(1, 2**63 - 1, kind.length, dtype=np.uint64) | np.uint64(1)
        add = rng.integers(1, 2**63 - 1, kind.length, dtype=np.uint64)
        used = kind.segments * kind.symbols
        place = np.uint64(4) * np.arange(16, dtype=np.uint64)
        for batch in batches:
            batch = batch.filter(pa.compute.greater_equal(batch.column(5), least_words))
            if not batch.num_rows:
                continue
            lists = batch.column(4)
            values = lists.flatten().to_numpy().view(np.uint64)
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            least = np.empty((len(starts), kind.length), np.uint64)
            for i in range(kind.length):
                h = values * mult[i] + add[i]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                least[:, i] = np.minimum.reduceat(h, starts) >> np.uint64(8)
            symbols = least[:, :used].astype(np.uint16)
            nibbles = ((least >> np.uint64(16)) & np.uint64(15)).reshape(len(starts), 4, 16)
            sketch = np.left_shift(nibbles, place).sum(2).view(np.int64)
            packed = pa.array([r.tobytes() for r in symbols], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed, *(pa.array(sketch[:, i]) for i in range(4))], names=["item", "h1", "h2", "n", "symbols", "s0", "s1", "s2", "s3"])

    return run


def ball_keys(kind: Fingerprint) -> Column:
    """A key for each segment and each of its symbols that may take any value: the members of a Hamming ball of
    radius one around a segment that differ in that symbol all have this key."""
    keys = []
    for s in range(kind.segments):
        for free in range(kind.symbols):
            kept = [F.substring("symbols", 2 * (s * kind.symbols + i) + 1, 2) for i in range(kind.symbols) if i != free]
            keys.append(F.xxhash64(F.lit(s * kind.symbols + free), *kept))
    return F.array(*keys)


def agreement(pairs: list[tuple[Column, Column]]) -> Column:
    """How many of sixteen four-bit symbols in each pair of numbers are equal: the length less the Hamming distance."""
    total = F.lit(0)
    for a, b in pairs:
        x = a.bitwiseXOR(b)
        any_ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + 16 - F.bit_count(any_.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _in_full_keys(keys: DataFrame, full: DataFrame, prints: DataFrame, near: Column, block: int) -> DataFrame:
    """(a, b) of records that share a full key and are near enough.

    The records of a key are cut into blocks, and every two blocks meet in a cell, so no task gets more than two
    blocks and no pair is lost. The distance is taken in the join itself: only near pairs leave it.
    """
    held = keys.join(full.select("key"), "key", "left_semi")
    sizes = held.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = held.join(sized(stage(sizes), SMALL_ROWS), "key").withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sketch = prints.select(F.col("item").alias("rep"), *(f"s{i}" for i in range(4)))
    rows = stage(rows.join(sketch, "rep"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Block i goes to the cells (i, j) and (j, i), of which the lower half is used: (lower block, higher block).
    sided = lambda k, cell: rows.withColumn("other", each).filter(cell).select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.col("rep").alias(k), *(F.col(f"s{x}").alias(f"{k}{x}") for x in range(4)))
    one, two = sided("a", F.col("at") <= F.col("other")), sided("b", F.col("at") >= F.col("other"))
    met = one.join(two, ["key", "i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verified(items: DataFrame, pairs: DataFrame, sizes: DataFrame, size: int, cell_hashes: int) -> DataFrame:
    """(a, b, similarity) of all ``pairs``, by the sets of the texts of ``items``; ``sizes`` (item, n) has the sets' sizes.

    Pairs whose lower record has the same lowest neighbour meet in a cell, so that a set goes once to a cell and not
    once to each pair. A cell of too many hashes is cut in as many parts by a as by b, so no task holds much of it.
    """
    ends = pairs.select(F.col("a").alias("item"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("other")))
    lowest = stage(ends.groupBy("item").agg(F.min("other").alias("cell")).join(sizes, "item").select("item", F.least("item", "cell").alias("cell"), "n"))
    weighed = pairs.join(lowest.withColumnRenamed("item", "a"), "a").join(lowest.select(F.col("item").alias("b"), F.col("n").alias("m")), "b")
    weighed = stage(weighed.select("a", "b", "cell", (F.col("n") + F.col("m")).alias("n")))
    large = stage(weighed.groupBy("cell").agg(F.ceil(F.sqrt(F.sum("n") / cell_hashes)).cast("int").alias("parts")).filter("parts > 1"))
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1)))
    celled = stage(weighed.join(sized(large, SMALL_ROWS), "cell", "left").select("a", "b", F.xxhash64("cell", part("a"), part("b")).alias("at")))
    places = stage(celled.select(F.explode(F.array("a", "b")).alias("item"), "at").groupBy("item").agg(F.collect_set("at").alias("places")))
    # Only the candidates' texts are read again for their sets.
    kept = items.join(sized(places, WANTED_ROWS), "item").select("item", "places", record_words(F.col("title"), F.col("body")).alias("w"))
    kept = kept.select("item", F.explode("places").alias("at"), shingles(F.col("w"), size).alias("sh")).repartition("at")
    cells = kept.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("item", "sh"))).alias("sets"))
    cells = cells.join(celled.groupBy("at").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "at")
    x, y = (lambda p, k=k: F.col("sets")[p[k]] for k in "ab")
    counted = F.transform("pairs", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), (F.size(x(p)) + F.size(y(p))).alias("n"), F.size(F.array_intersect(x(p), y(p))).alias("both")))
    return cells.select(F.inline(counted)).select("a", "b", (F.col("both") / (F.col("n") - F.col("both"))).alias("similarity"))


def near_duplicates(items: DataFrame, least: float = 0.6, size: int = 3, least_words: int = 20, kind: Fingerprint = Fingerprint(), ident: str = "item_seq", full_key: int = FULL_KEY, cell_hashes: int = CELL_HASHES) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs (a, b, similarity) of class representatives, and (item, rep) of every item.

    Items with one set of word runs form a class; its lowest id represents it. Links are exact: the similarity
    of the sets of 64-bit hashes, verified for all candidates. Items of fewer than ``least_words`` words are left out; null title
    and body count as empty; further columns are ignored; an empty table gives empty results.
    """
    words = record_words(F.col("title"), F.col("body"))
    sets = items.select(F.col(ident).alias("item"), words.alias("w")).select("item", F.size("w").alias("words"), shingles(F.col("w"), size).alias("sh"))
    hashed = sets.select("item", F.xxhash64("sh").alias("h1"), F.hash("sh").alias("h2"), F.size("sh").alias("n"), "sh", "words")
    prints = stage(hashed.mapInArrow(_fingerprints(kind, max(least_words, size)), "item long, h1 long, h2 int, n int, symbols binary, s0 long, s1 long, s2 long, s3 long"))
    keyed = prints.select("item", F.struct("h1", "h2", "n").alias("h"))
    classes = stage(keyed.groupBy("h").agg(F.min("item").alias("rep"), F.count("*").alias("n")).filter("n > 1"))
    copies = stage(spread_join(keyed, classes.select("h", "rep"), "h", "inner", counts=classes).select("item", "rep"))
    others = sized(copies.filter("item != rep").select("item"), SMALL_ROWS)
    heads = prints.join(others, "item", "left_anti").select(F.col("item").alias("rep"), "symbols")
    keys = heads.select("rep", F.explode(ball_keys(kind)).alias("key"))
    near = agreement([(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(4)]) >= kind.least_agreement(least)
    seen = heads.filter(F.pmod(F.xxhash64("rep"), F.lit(LOOK)) == 0).select(F.explode(ball_keys(kind)).alias("key"))
    full = stage(seen.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, full_key // (2 * LOOK))))
    crowded = bool(full.take(1))
    full = sized(full, SMALL_ROWS)
    rare = keys.join(full, "key", "left_anti") if crowded else keys
    # A key that only one record has, as most are, gives no pair. Both sides are named anew, so that their plans are equal and the
    # keys, the most there is to shuffle here, are shuffled once for both.
    pairs = rare.select("key", F.col("rep").alias("a")).join(rare.select("key", F.col("rep").alias("b")), "key").filter("a < b").select("a", "b")
    side = lambda k: prints.select(F.col("item").alias(k), *[F.col(f"s{i}").alias(f"{k}{i}") for i in range(4)])
    # By a at once, so that pairs are not shuffled for their distinct ones and once more for the distance.
    pairs = pairs.repartition("a").distinct().join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b")
    if crowded:
        pairs = pairs.unionByName(_in_full_keys(keys, full, prints, near, full_key)).distinct()
    pairs = stage(pairs)
    scored = _verified(items.select(F.col(ident).alias("item"), "title", "body"), pairs, prints.select("item", "n"), size, cell_hashes)
    links = stage(scored.filter(F.col("similarity") >= least))
    alone = prints.select("item").join(others, "item", "left_anti").select("item", F.col("item").alias("rep"))
    return links, alone.unionByName(copies.filter("item != rep"))


def duplicate_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(item_a, item_b), item_a < item_b: all pairs of items of linked classes or of one class.

    A class's rows are spread over tasks by their number, each with all rows of the class it is linked with.
    """
    members = stage(members)
    ab = links.select("a", "b").unionByName(members.filter("item != rep").select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    left = spread_join(members.select(F.col("rep").alias("a"), F.col("item").alias("i")), ab, "a", "inner", CLASS_ROWS)
    out = spread_join(left, members.select(F.col("rep").alias("b"), F.col("item").alias("j")), "b", "inner", CLASS_ROWS).filter("a != b or i < j")
    return out.select(F.least("i", "j").alias("item_a"), F.greatest("i", "j").alias("item_b"))
