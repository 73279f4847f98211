"""Incremental maintenance: what a batch of items changes in the pages, edges and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may change of a page without a change of its content.
META = ("trust", "volatile", "freshness", "description", "resource", "source", "authored")


def edges_json(edges: Column) -> Column:
    """Compact JSON of an edge list in authored order; a null weight is left out, whole numbers have no fraction."""
    text = lambda s: F.regexp_extract(F.to_json(F.array(F.coalesce(s, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    number = lambda w: F.when(w == F.floor(w), F.floor(w).cast("string")).otherwise(w.cast("string"))
    one = lambda e: F.concat(F.lit('{"type":'), text(e.type), F.lit(',"target":'), text(e.target), F.coalesce(F.concat(F.lit(',"weight":'), number(e.weight)), F.lit("")), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(edges, F.array().cast("array<struct<type:string,target:string,weight:double>>")), one), ","), F.lit("]"))


def content_hash(title: Column, body: Column, edges: Column) -> Column:
    """First 16 digits of the hash of title, body and edge list; a change of anything else is no change of content."""
    nul = F.lit("\0")
    return F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("")), nul, F.coalesce(body, F.lit("")), nul, edges), 256), 1, 16)


def latest_items(items: DataFrame) -> DataFrame:
    """The last delivery of each id."""
    last = items.filter("id is not null").groupBy("id").agg(F.max(F.struct("received_at", "item_seq")).getField("item_seq").alias("item_seq"))
    return items.join(last.select("item_seq"), "item_seq", "left_semi")


def classify(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, status) of both sides: new, changed, unchanged or absent, by null-safe comparison of content hashes."""
    new, old = incoming.select("id", F.col("content_hash").alias("new")), existing.select("id", F.col("content_hash").alias("old"))
    both = new.withColumn("arrived", F.lit(True)).join(old.withColumn("known", F.lit(True)), "id", "full_outer")
    status = F.when(F.col("arrived").isNull(), "absent").when(F.col("known").isNull(), "new").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return both.select("id", status.alias("status"))


def metadata_changes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, fields, write_actor): what differs besides content; an unknown actor keeps the one that is stored.

    Both sides have trust and volatile as they are stored, with defaults filled in, and times in seconds.
    """
    a, b = incoming.alias("a"), existing.alias("b")
    actor = F.coalesce(F.nullif(F.col("a.write_actor"), F.lit("unknown")), F.col("b.write_actor"))
    differs = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in META] + [F.when(~actor.eqNullSafe(F.col("b.write_actor")), "write_actor")]
    return a.join(b, F.col("a.id") == F.col("b.id")).select(F.col("a.id").alias("id"), F.array_join(F.array_compact(F.array(*differs)), ",").alias("fields"), actor.alias("write_actor")).filter("fields != ''")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after the batch: rows of the batch replace those of the same id; a known actor is kept."""
    cols = existing.columns
    a, b = incoming.select(*cols).alias("a"), existing.alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    pick = lambda c: F.when(F.col("a.id").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    out = {c: pick(c) for c in cols}
    if "write_actor" in cols:
        out["write_actor"] = F.coalesce(F.nullif(F.col("a.write_actor"), F.lit("unknown")), F.col("b.write_actor"), F.col("a.write_actor"))
    return joined.select(*[v.alias(c) for c, v in out.items()])


def replace_rows(table: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """Rows of changed owners replaced by ``rows``."""
    return table.join(rows.select(owner).distinct(), owner, "left_anti").unionByName(rows)


def remove_ids(table: DataFrame, ids: DataFrame, owner: str) -> DataFrame:
    """Rows without those owned by ``ids``; edges that point to them stay and dangle."""
    return table.join(ids.select(F.col("id").alias(owner)), owner, "left_anti")


def prune(table: DataFrame, keep: DataFrame, owner: str) -> DataFrame:
    """Only the rows owned by ``keep``."""
    return table.join(keep.select(F.col("id").alias(owner)), owner, "left_semi")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The first written of edges that are equal in source, type as spelled, and target; only keys are shuffled."""
    first = edges.groupBy("source", "type", "target").agg(F.min("edge_id").alias("edge_id"))
    return edges.join(first.select("edge_id"), "edge_id", "left_semi")


def recall_events(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """(memory, qid, rank, ts): recalled rows as events to append, for :func:`recall_stats`."""
    return rows.select(F.col("id").alias("memory"), "qid", "rank", (F.current_timestamp() if at is None else at).alias("ts"))


def recall_stats(events: DataFrame) -> DataFrame:
    """(memory, hits, last): how often and when last each memory was recalled."""
    return events.groupBy("memory").agg(F.count("*").alias("hits"), F.max("ts").alias("last"))


def hotlist(stats: DataFrame, pages: DataFrame, n: int = 20) -> DataFrame:
    """The n most recalled trusted pages: a report of fixed length."""
    kept = stats.join(pages.filter("trust = 'trusted'").select(F.col("row_no").alias("memory"), "id", "title"), "memory")
    return kept.orderBy(F.desc("hits"), F.desc_nulls_last("last"), "id").limit(n).select("id", "title", "hits", "last")
