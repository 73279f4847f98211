"""Structured Streaming: items that arrive as files, and telemetry counters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphmere.functions import ranking as R
from graphmere.operators import maintenance as M
from graphmere.session import stage
from graphmere.sources import store


def read_items(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingest(stream: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Each micro-batch is upserted into the published ``items`` table as a new generation.

    Only the buckets of the batch's ids are read and written. Of a stored and a new row of one id the one received
    last stays, then the higher item_seq, so a late delivery doesn't replace a newer one. The generation is named by
    the batch, so a batch that runs again after a failure is published once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stage(M.latest_items(batch))
        now = store.read_pointer(spark, root)
        n = now["tables"]["items"]["buckets"] if now else buckets
        touched = [r[0] for r in rows.select(store.bucket(F.col("id"), n)).distinct().collect()]
        old = store.open_table(spark, root, "items", now, touched) if now else rows.limit(0)
        newer = M.latest_items(old.select("id", "received_at", "item_seq").unionByName(rows.select("id", "received_at", "item_seq")))
        rows = rows.join(newer.select("item_seq"), "item_seq", "left_semi")
        store.publish(spark, root, {"items": M.upsert(old, rows)}, f"batch-{number:012d}", {"items": "id"}, n, touched if now else None)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recall_counts(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, memory, hits): recalls of each memory by day of a stream; later than the watermark doesn't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "memory").agg(F.count("*").alias("hits"))


def freshest(claims: DataFrame) -> DataFrame:
    """A stream of (trust, zone, title, id, freshness): a row whenever a fresher claim takes its title.

    ``claims`` is a stream of pages (id, path, title, trust, freshness). Claims with one (trust, zone, title) compete;
    the freshest by day wins, however late it comes, and of equal days the one that came first. Claims without
    freshness never win over one with it. The state of a title is one id and its day.
    """
    key = ["label", "zone", "title"]
    rows = claims.select(F.coalesce("trust", F.lit("untrusted")).alias("label"), R.zone(F.col("path")).alias("zone"), F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("title"), "id", "freshness")
    out = "trust string, zone string, title string, id string, freshness double"
    return rows.groupBy(*key).applyInPandasWithState(_claim, out, "id string, day long", "update", "NoTimeout")


def _claim(key, batches, state):
    held, won = state.getOption if state.exists else None, None
    for batch in batches:
        for ident, fresh in zip(batch["id"], batch["freshness"]):
            day = -(2**62) if pd.isna(fresh) else int(fresh // 86400)
            if held is None or day > held[1]:
                held, won = (ident, day), (ident, fresh)
    if won is not None:
        state.update(held)
        yield pd.DataFrame({"trust": [key[0]], "zone": [key[1]], "title": [key[2]], "id": [won[0]], "freshness": [won[1]]})
