"""Pages, chunks and edges as they stand now, from their histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmere.functions import text as T
from graphmere.operators.orphans import composed, reference_key

COLUMNS = ("id", "path", "title", "type", "description", "body", "trust", "volatile", "freshness", "resource", "source", "authored", "write_actor")


def current_pages(nodes: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """The latest row of each page that is still there, and the entity pages that no page replaces.

    Only keys are shuffled to find the latest rows; bodies are read once, in the final join.
    """
    last = nodes.filter("id is not null").groupBy("id").agg(F.max(F.struct("indexed_at", "row_no", F.col("removed_at").isNull().alias("live"))).alias("m"))
    live = last.filter("m.live").select(F.col("m.row_no").alias("row_no"))
    pages = nodes.join(live, "row_no", "left_semi").withColumn("path", F.coalesce("path", F.concat("id", F.lit(".md")))).select(*COLUMNS)
    if entities is None:
        return pages
    text = lambda v=None: F.lit(v).cast("string")
    there = entities.filter("removed_at is null and id is not null").groupBy("id").agg(F.min("title").alias("title"))
    extra = there.join(live_ids(last), "id", "left_anti").select(
        "id", F.concat("id", F.lit(".md")).alias("path"), "title", text("entity").alias("type"), text().alias("description"), text("").alias("body"), text("trusted").alias("trust"),
        F.lit(False).alias("volatile"), F.lit(None).cast("double").alias("freshness"), text().alias("resource"), text().alias("source"), F.lit(None).cast("double").alias("authored"), text("unknown").alias("write_actor"),
    )
    return pages.unionByName(extra)


def live_ids(last: DataFrame) -> DataFrame:
    return last.filter("m.live").select("id")


def current_edges(edges: DataFrame) -> DataFrame:
    """(source, type, target, weight): the first written of each distinct edge, with ids as they are meant.

    Ends that name no id are dropped; a null weight is 1; the relation type keeps its normalised spelling.
    """
    e = edges.select("edge_id", reference_key(F.col("source")).alias("source"), T.relation(F.coalesce("type", F.lit("related_to"))).alias("type"), reference_key(F.col("target")).alias("target"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    e = e.filter("source is not null and target is not null").withColumns({"source": composed(F.col("source")), "target": composed(F.col("target"))})
    return e.groupBy("source", "type", "target").agg(F.min_by("weight", "edge_id").alias("weight"))


def current_chunks(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """(chunk_id, page_id, ord, v): the first delivery of each chunk, if its vector is usable; v has length 1."""
    e = F.col("embedding")
    fine = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    first = chunks.groupBy("page_id", "ord").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id")
    kept = chunks.filter(e.isNotNull() & F.coalesce(fine, F.lit(False))).join(first, "chunk_id", "left_semi")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return kept.select("chunk_id", "page_id", "ord", norm.alias("norm"), "embedding").select("chunk_id", "page_id", "ord", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")).alias("v"))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
