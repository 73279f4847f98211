"""References to records that do not exist, kept as incremental state.

The state is a folder with three logs, cut into buckets by key and only ever appended to: what is known of parents
(an arrival, or an end), the references with their verdict (a row when a reference arrives, and one whenever its
verdict changes), and snapshots of the counts. A batch reads the buckets of its own keys: new references probe the
parent index; arriving parents probe the open orphans of their key and resolve them; deletions probe the settled
references of their key and reopen those seen at or after the deletion. What a batch doesn't touch stays as written.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmere.operators.joins import KEY_ROWS, spread_join
from graphmere.session import scratch, stage, stage_table
from graphmere.sources import store

_BLANK = r"[\s\p{Z}\x{85}]"


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def composed(text: Column) -> Column:
    """Unicode NFC form; Spark has no built-in for it. Plain ASCII text doesn't leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def reference_key(ref: Column) -> Column:
    """The full id that a reference names, null if it names none.

    Anything from the first ``#`` or ``|`` on is cut, then blanks around it and an ending ``.md``.
    """
    key = F.regexp_replace(ref, r"(?s)[#|].*$", "")
    key = F.regexp_replace(key, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")
    return F.nullif(F.regexp_replace(key, r"\.md$", ""), F.lit(""))


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, side, key, seen_at, loaded_at) for each end that names an id."""
    ends = F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("ref")), F.struct(F.lit("target").alias("side"), F.col("target").alias("ref"))))
    out = edges.select("edge_id", "seen_at", "loaded_at", ends.alias("e"))
    out = out.select("edge_id", F.col("e.side").alias("side"), reference_key(F.col("e.ref")).alias("key"), "seen_at", "loaded_at")
    return out.filter("key is not null").withColumn("key", composed(F.col("key")))


def parents(*tables: DataFrame) -> DataFrame:
    """(key, lo, hi): when each row's record existed; hi is null while it does."""
    rows = [t.select(F.col("id").alias("key"), F.col("indexed_at").alias("lo"), F.col("removed_at").alias("hi")) for t in tables]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("key is not null and lo is not null").withColumn("key", composed(F.col("key")))


def existence_spans(log: DataFrame) -> DataFrame:
    """(key, spans): disjoint spans in order, from arrivals (key, lo, hi null) and ends (key, lo, hi).

    An end closes one arrival of its (key, lo); while there are more arrivals than ends the record exists.
    """
    rows = log.groupBy("key", "lo").agg(F.count_if(F.col("hi").isNull()).alias("n"), F.count("hi").alias("ended"), F.max("hi").alias("hi"))
    rows = rows.select("key", "lo", F.when(F.col("n") <= F.col("ended"), F.col("hi")).alias("hi")).filter("hi is null or lo < hi")
    order = Window.partitionBy("key").orderBy("lo")
    far = F.lit(datetime(9999, 1, 1)).cast("timestamp")
    reach = F.max(F.coalesce("hi", far)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("starts", F.when(F.col("lo") <= reach, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("key", "run").agg(F.min("lo").alias("lo"), F.max(F.coalesce("hi", far)).alias("hi"))
    return rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def probe(refs: DataFrame, index: DataFrame, rows: int = KEY_ROWS) -> DataFrame:
    """refs with ``orphan``: no span of the key's parent holds ``seen_at`` (null: nothing holds it)."""
    held = F.exists("spans", lambda s: (s.lo <= F.col("seen_at")) & (F.col("seen_at") < s.hi))
    return spread_join(refs, index, "key", "left", rows).withColumn("orphan", ~F.coalesce(held, F.lit(False))).drop("spans")


_REF = ("edge_id", "side", "key", "seen_at")


@dataclass(frozen=True)
class OrphanState:
    """The state under ``root``, as of the last batch."""

    spark: SparkSession
    root: str

    def log(self, table: str, only: list[int] | None = None) -> DataFrame:
        return store.open_table(self.spark, self.root, table, only=only)

    def references(self, only: list[int] | None = None) -> DataFrame:
        """(edge_id, side, key, seen_at, n, orphan): each reference with its verdict and how often it is repeated."""
        return verdicts(self.log("refs", only))

    @property
    def open(self) -> DataFrame:
        """(edge_id, side, key, seen_at) of the orphans; repeated references as often as they came."""
        rows = self.references().filter("orphan")
        return rows.select(*_REF, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")

    @property
    def snapshots(self) -> DataFrame:
        """(batch, as_of, side, month, orphans) after each batch."""
        return self.log("snapshots")


def verdicts(log: DataFrame) -> DataFrame:
    return log.groupBy(*_REF).agg(F.sum("n").alias("n"), F.max_by("orphan", "batch").alias("orphan"))


def advance(spark: SparkSession, root: str, refs: DataFrame, arrived: DataFrame, removed: DataFrame, as_of: datetime | None = None, buckets: int = 64, rows: int = KEY_ROWS) -> OrphanState:
    """Apply one batch to the state under ``root`` and append what it changes.

    ``refs`` has new references (edge_id, side, key, seen_at), ``arrived`` new parents (key, lo), ``removed`` ends of
    known ones (key, lo, hi). A batch that fails leaves the state before it.
    """
    now, state = store.read_pointer(spark, root), OrphanState(spark, root)
    batch = int(now["generation"]) + 1 if now else 1
    n = now["tables"]["refs"]["buckets"] if now else buckets
    refs = refs.select(*_REF)
    facts = arrived.select("key", "lo", F.lit(None).cast("timestamp").alias("hi")).unionByName(removed.select("key", "lo", "hi"))
    new = refs.select(*_REF, F.lit(1).cast("long").alias("n"), F.lit(None).cast("boolean").alias("was"))
    if now:
        cells = lambda df: [r[0] for r in df.select(store.bucket(F.col("key"), n)).distinct().collect()]
        moved = facts.groupBy("key").agg(F.min(F.when(F.col("hi").isNull(), F.col("lo"))).alias("lo"), F.min("hi").alias("hi"))
        moved = stage(moved)
        later = lambda c: F.coalesce(F.col("seen_at") >= F.col(c), F.lit(False))
        known = spread_join(state.log("refs", cells(moved)), moved, "key", "inner", rows).filter(later("lo") | later("hi"))
        known = known.groupBy(*_REF, "lo", "hi").agg(F.max_by("orphan", "batch").alias("was")).filter((F.col("was") & later("lo")) | (~F.col("was") & later("hi")))
        keys = refs.select("key").unionByName(moved.select("key")).distinct()
        index = existence_spans(state.log("parents", cells(keys)).unionByName(facts).join(keys, "key", "left_semi"))
        new = new.unionByName(known.select(*_REF, F.lit(0).cast("long").alias("n"), "was"))
    else:
        index = existence_spans(facts)
    probed = probe(new, index, rows).filter(F.col("was").isNull() | (F.col("was") != F.col("orphan")))
    told = probed.select(*_REF, "n", "orphan", F.lit(batch).alias("batch"))

    def counts(manifest: dict) -> DataFrame:
        """The counts before, with what the batch's own rows add and take away."""
        mine = store.open_table(spark, root, "refs", manifest).filter(F.col("batch") == batch)
        sign = F.when(F.col("n") > 0, F.col("orphan").cast("long") * F.col("n")).otherwise(F.when(F.col("orphan"), 1).otherwise(-1).cast("long"))
        change = mine.select("side", _month(), sign.alias("orphans"))
        if now:
            change = change.unionByName(state.snapshots.filter(F.col("batch") == batch - 1).select("side", "month", "orphans"))
        total = change.groupBy("side", "month").agg(F.sum("orphans").alias("orphans")).filter("orphans > 0")
        return total.select(F.lit(batch).alias("batch"), F.lit(as_of).cast("timestamp").alias("as_of"), "side", "month", "orphans")

    tables = {"refs": told, "parents": facts, "snapshots": counts}
    store.publish(spark, root, tables, str(batch), {"refs": "key", "parents": "key"}, n, append=True)
    return state


def _month() -> Column:
    return F.date_format("seen_at", "yyyy-MM").alias("month")


def count_orphans(open_refs: DataFrame) -> DataFrame:
    """(side, month, orphans): broken ends by side and month of seen_at."""
    return open_refs.groupBy("side", _month()).agg(F.count("*").alias("orphans"))


def orphan_state(edges: DataFrame, *tables: DataFrame, batches: int = 3, root: str | None = None, rows: int = KEY_ROWS) -> OrphanState:
    """Run the whole history through :func:`advance`, in ``batches`` equal periods of arrival.

    References arrive at loaded_at (null: in the last batch), parents at indexed_at, deletions at removed_at.
    Null and blank ends are no references; a null seen_at is held by no parent; parents without id or indexed_at
    hold nothing; repeated rows count each; other columns are ignored; empty tables give an empty state. ``root``
    is the folder of the state, by default a new one below the checkpoint folder.
    """
    spark = edges.sparkSession
    root = root or scratch(spark, "orphans")
    refs, known = stage_table(references(edges)), stage_table(parents(*tables))
    first, last = refs.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    cuts = [] if first is None else [first + (last - first) * i / batches for i in range(1, batches)]
    bounds = [None, *cuts, None]
    state, buckets = None, max(8, -(-refs.count() // KEY_ROWS))
    for a, b in zip(bounds, bounds[1:]):
        arrives = lambda c, a=a, b=b: F.lit(True) if a is None and b is None else (c < F.lit(b)) if a is None else (c >= F.lit(a)) if b is None else ((c >= F.lit(a)) & (c < F.lit(b)))
        loaded = arrives(F.col("loaded_at"))
        new = refs.filter(loaded | F.col("loaded_at").isNull() if b is None else loaded)
        arrived = known.filter(arrives(F.col("lo")))
        # An end that is dated before its row arrived comes with the row.
        removed = known.filter(F.col("hi").isNotNull() & arrives(F.greatest("lo", "hi")))
        state = advance(spark, root, new, arrived, removed, b, buckets, rows)
    return state
