"""Changes of memories as changes of the items table: remember, supersede, link, forget, elevate.

Each returns the whole table of items (id, title, body, edges, trust, updated, superseded_by, forgotten, ...) after
the change; the index follows when the items are indexed again, where superseded and forgotten ones drop out.
Null ids name nothing; ids that are not there are passed over; repeated requests have the effect of one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmere.functions import text as T
from graphmere.sources.markdown import EDGES


def tombstoned() -> Column:
    return F.coalesce(F.col("forgotten"), F.lit(False)) | F.col("superseded_by").isNotNull()


def remember(items: DataFrame, new: DataFrame, compact: Callable[[Column], Column] | None = None, clean: Callable[[Column], Column] = T.sanitize, folder: str = "out_memory") -> DataFrame:
    """``items`` with the memories ``new`` (title, body, ...), under ids of their own.

    A body goes through ``compact``, if there is one, and then through ``clean``; a title through ``clean``. A memory
    that is there already, by title and body, is not added again.
    """
    body = F.col("body") if compact is None else compact(F.col("body"))
    rows = new.withColumns({"title": clean(F.col("title")), "body": clean(body)})
    ids = T.memory_ids(rows, items, folder)
    same = lambda c: rows[c].eqNullSafe(ids[c])
    # One row for each content, whatever the requests.
    rows = rows.dropDuplicates(["title", "body"]).join(ids, same("title") & same("body")).drop(ids["title"]).drop(ids["body"])
    rows = rows.join(items.select("id"), "id", "left_anti").withColumn("path", F.concat("id", F.lit(".md")))
    return items.unionByName(rows.select(*[c for c in rows.columns if c in items.columns]), allowMissingColumns=True)


def supersede(items: DataFrame, successions: DataFrame, now: datetime | None = None) -> DataFrame:
    """Items with ``superseded_by`` set by ``successions`` (old, new), of several the highest; the old ones stay as
    they are otherwise. Only successors that are in ``items`` count, so that none is lost before it has one."""
    known = successions.join(items.select(F.col("id").alias("new")).distinct(), "new", "left_semi").filter("old != new")
    by = known.groupBy(F.col("old").alias("id")).agg(F.max("new").alias("_by"))
    out = items.join(by, "id", "left")
    return _stamped(out, F.col("_by").isNotNull(), now).withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("_by")


def link(items: DataFrame, links: DataFrame, now: datetime | None = None) -> DataFrame:
    """Items with the edges of ``links`` (source, type, target) added, unless one of that target and type, however
    it is spelled, is there. A null type is related_to."""
    kind = F.coalesce("type", F.lit("related_to"))
    each = links.filter("source is not null and target is not null").select("source", kind.alias("type"), "target", T.relation(kind).alias("t"))
    each = each.groupBy("source", "t", "target").agg(F.min("type").alias("type"))
    lists = each.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct("type", "target", F.lit(None).cast("double").alias("weight")))).alias("_new"))
    have = F.coalesce("edges", F.array().cast(EDGES))
    key = lambda e: F.concat(T.relation(F.coalesce(e.type, F.lit("related_to"))), F.lit("\0"), e.target)
    out = items.join(lists, "id", "left").withColumn("_keys", F.transform(have, key))
    out = out.withColumn("_add", F.filter(F.coalesce("_new", F.array().cast(EDGES)), lambda e: ~F.array_contains("_keys", key(e))))
    return _stamped(out, F.size("_add") > 0, now).withColumn("edges", F.concat(have, F.col("_add"))).drop("_new", "_keys", "_add")


def forget(items: DataFrame, ids: DataFrame, hard: bool = False, now: datetime | None = None) -> DataFrame:
    """Items with ``ids`` (id) marked as forgotten, or without them if ``hard``."""
    if hard:
        return items.join(ids.select("id").distinct(), "id", "left_anti")
    out = items.join(ids.select("id").distinct().withColumn("_f", F.lit(True)), "id", "left")
    return _stamped(out, F.col("_f"), now).withColumn("forgotten", F.coalesce("_f", "forgotten")).drop("_f")


def elevate(items: DataFrame, ids: DataFrame, now: datetime | None = None) -> DataFrame:
    """Items with ``ids`` (id) trusted."""
    out = items.join(ids.select("id").distinct().withColumn("_f", F.lit(True)), "id", "left")
    return _stamped(out, F.col("_f"), now).withColumn("trust", F.when(F.col("_f"), "trusted").otherwise(F.col("trust"))).drop("_f")


def _stamped(rows: DataFrame, changed: Column, now: datetime | None) -> DataFrame:
    if "updated" not in rows.columns:
        return rows
    stamp = F.date_format(F.current_timestamp() if now is None else F.lit(now), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.withColumn("updated", F.when(F.coalesce(changed, F.lit(False)), stamp).otherwise(F.col("updated")))
