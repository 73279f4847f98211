"""Documents packed into containers of fixed capacity, by the histogram of their lengths."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmere.session import stage

CAPACITY = 1024
#: Fixed value: the pre-tokenisation pattern published with GPT-2; (?U) gives \s its Unicode meaning.
PRETOKENS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one length that are ranked by one task.
RANKED_ROWS = 100_000


def token_count(text: Column) -> Column:
    """Number of pre-tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(PRETOKENS)), F.lit(0))


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many containers, {length: items of it in each}) from {length: items}; one entry for each pattern.

    Lengths are placed from the longest down. Each goes into the open pattern with the most room that is left
    (the shortest pack) if it fits there, else it opens containers. Only counts are handled, so the work depends
    on the number of different lengths and not on the number of items.
    """
    room_of: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    full: list[tuple[int, dict[int, int]]] = []
    roomiest = 0

    def put(n: int, pattern: dict[int, int], room: int) -> None:
        nonlocal roomiest
        if room:
            room_of[room].append((n, pattern))
            roomiest = max(roomiest, room)
        else:
            full.append((n, pattern))

    for length in sorted((x for x in counts if x > 0 and counts[x] > 0), reverse=True):
        left = counts[length]
        while left:
            while roomiest and not room_of[roomiest]:
                roomiest -= 1
            if roomiest < length:  # nothing open can take it; a container takes as many as fit
                each = min(capacity // length, left)
                whole, rest = divmod(left, each)
                put(whole, {length: each}, capacity - each * length)
                if rest:
                    put(1, {length: rest}, capacity - rest * length)
                break
            n, pattern = room_of[roomiest].pop()
            each = min(roomiest // length, left)
            used = min(n, left // each)
            if used < n:
                room_of[roomiest].append((n - used, pattern))
            put(used, pattern | {length: each}, roomiest - each * length)
            left -= used * each
    return full + [x for packs in room_of.values() for x in packs]


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first container, items in each, place in it) for each run of slots."""
    out, next_rank, container = [], defaultdict(int), 0
    for n, pattern in patterns:
        place = 0
        for length, each in pattern.items():
            first = next_rank[length]
            out.append((length, first, first + n * each, container, each, place))
            next_rank[length] += n * each
            place += length * each
        container += n
    return out


def length_ranks(items: DataFrame, ident: str, largest: int) -> DataFrame:
    """items with ``rank`` 0.. among those of equal ``tokens``; a frequent length is ranked in many tasks."""
    parts = max(1, -(-largest // RANKED_ROWS))
    items = items.withColumn("part", F.pmod(F.xxhash64(ident, "piece"), F.lit(parts)).cast("int"))
    sums = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = items.groupBy("tokens", "part").count().select("tokens", "part", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("tokens", "part").orderBy(ident, "piece"))
    return items.withColumn("within", within).join(first, ["tokens", "part"]).select(ident, "piece", "tokens", (F.col("first") + F.col("within") - 1).alias("rank"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, first_token, tokens, container, place): where each document, or piece of one, goes.

    A text over ``capacity`` tokens is split into full pieces and a rest; nothing else is split. ``place`` is
    the token offset in the container. Texts without tokens (null, empty) take no room and go to container 0.
    Equal lengths are told apart by their rank, so ties and repeated rows each get their own place; rows that
    repeat a doc_id are placed each. Further columns are ignored; an empty table gives an empty result.

    Only the histogram, at most ``capacity`` + 1 rows, comes to the driver; the patterns go back as a table of
    slot runs, whose number depends on the histogram and not on the documents, and are joined by length and rank.
    """
    spark = documents.sparkSession
    counted = documents.select(F.col(ident).alias("doc"), token_count(F.col(text)).cast("int").alias("n"))
    last = F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)).cast("int")
    items = stage(counted.select("doc", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))).select(
        "doc", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("tokens")
    )
    histogram = {r["tokens"]: r["count"] for r in items.groupBy("tokens").count().collect()}
    slots = _slots(pack_histogram(histogram, capacity))
    runs = spark.createDataFrame(slots or [(-1, 0, 0, 0, 1, 0)], "tokens int, lo long, hi long, container long, each int, place int")
    ranked = length_ranks(items, "doc", max(histogram.values(), default=0))
    hit = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    joined = ranked.join(F.broadcast(runs), (ranked["tokens"] == runs["tokens"]) & hit, "left")
    step = F.col("rank") - F.col("lo")
    return joined.select(
        F.col("doc").alias(ident),
        "piece",
        (F.col("piece") * capacity).alias("first_token"),
        ranked["tokens"].alias("tokens"),
        F.coalesce(F.col("container") + F.floor(step / F.col("each")), F.lit(0)).cast("long").alias("container"),
        F.coalesce(F.col("place") + (step % F.col("each")) * ranked["tokens"], F.lit(0)).cast("int").alias("place"),
    )
