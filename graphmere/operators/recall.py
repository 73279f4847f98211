"""The ranking stages after fusion, and the whole of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmere.functions import ranking as R
from graphmere.operators import retrieval as A
from graphmere.operators.index import Tables
from graphmere.session import stage


#: What a page says of itself and a recalled row shows besides.
DECLARED = ("description", "resource", "source", "authored", "write_actor")


def adjust(fused: DataFrame, pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Existing pages of the fused lists with ``adj`` = score x trust x zone x entity, and ``pos`` by it."""
    cols = ["id", "path", "title", "trust", "volatile", "freshness", *(c for c in DECLARED if c in pages.columns)]
    rows = fused.join(pages.select(*cols), "id").join(queries.select("qid", "query"), "qid")
    adj = F.col("score") * R.trust_weight(F.col("trust")) * R.zone_weight(F.col("path")) * R.entity_weight(F.col("query"), F.col("title"), F.col("id"))
    rows = rows.withColumn("adj", F.round(adj, 12)).withColumn("score", F.round("score", 9))
    order = Window.partitionBy("qid").orderBy(F.desc("adj"), F.desc("score"), "id")
    return rows.withColumn("pos", F.row_number().over(order))


def collapse(rows: DataFrame) -> DataFrame:
    """One row for each (trust, zone, title) of a query, in the slot of its first; without trust counts as untrusted.

    The first stays unless it is volatile with a freshness and a later such row is fresher by day: then the
    earliest of the freshest takes the slot. ``duplicates`` is how many others there were, null for none.
    """
    day = F.when(F.col("volatile") & F.col("freshness").isNotNull(), F.floor(F.col("freshness") / 86400))
    rows = rows.withColumns({"day": day, "zone": R.zone(F.col("path")), "key": F.lower(F.trim(F.coalesce("title", F.lit("")))), "label": F.coalesce("trust", F.lit("untrusted"))})
    group = Window.partitionBy("qid", "label", "zone", "key")
    by_pos = group.orderBy("pos")
    rows = rows.withColumns({"slot": F.min("pos").over(group), "n": F.count("*").over(group), "head": F.first("day").over(by_pos), "top": F.max("day").over(group)})
    chosen = F.when(F.col("head").isNull(), F.col("pos") == F.col("slot")).otherwise(F.col("day") == F.col("top"))
    rows = rows.filter(chosen).withColumn("i", F.row_number().over(by_pos)).filter("i = 1")
    return rows.withColumn("duplicates", F.when(F.col("n") > 1, F.col("n") - 1)).drop("i", "n", "head", "top", "day", "key", "label")


def tiebreak(rows: DataFrame, epsilon: float = R.TIE) -> DataFrame:
    """Rows with ``place``: runs of equal ``adj``, measured from the run's first, put the freshest volatile first.

    A run is cut where a row differs from the head of the run by more than ``epsilon``, so chains of small
    steps don't join. Only a query's candidates, some dozens, are folded together.
    """
    listed = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("slot", "id", "adj"))).alias("l"))
    zero = F.struct(F.lit(0).alias("run"), F.lit(None).cast("double").alias("head"), F.array().cast("array<struct<id:string,run:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc.head.isNull() | (F.abs(acc.head - x.adj) > epsilon)
        run = acc.run + F.when(new, 1).otherwise(0)
        return F.struct(run.alias("run"), F.when(new, x.adj).otherwise(acc.head).alias("head"), F.concat(acc.out, F.array(F.struct(x.id.alias("id"), run.alias("run")))).alias("out"))

    runs = listed.select("qid", F.explode(F.aggregate("l", zero, step, lambda a: a.out)).alias("r")).select("qid", "r.id", "r.run")
    rows = rows.join(runs, ["qid", "id"])
    mixed = F.max(F.coalesce("volatile", F.lit(False)).cast("int")).over(Window.partitionBy("qid", "run"))
    fresh = F.when(F.col("mixed") == 1, F.col("freshness"))
    order = Window.partitionBy("qid").orderBy("run", F.col("fresh").desc_nulls_last(), "slot")
    return rows.withColumn("mixed", mixed).withColumn("fresh", fresh).withColumn("place", F.row_number().over(order)).drop("mixed", "fresh")


def rerank(rows: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The first 4k reordered by ``scores`` (qid, id, rr), the unscored after the scored; score stays as it is."""
    cut = rows.filter(F.col("place") <= 4 * k).join(scores, ["qid", "id"], "left")
    order = Window.partitionBy("qid").orderBy(F.col("rr").desc_nulls_last(), "place")
    return cut.withColumn("place", F.row_number().over(order)).drop("rr")


def shape(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows with what they show: volatile only if it is true, freshness as a day, authored as an
    instant in UTC, null where there is none."""
    out = rows.filter(F.col("place") <= k)
    fresh = F.date_format(F.timestamp_seconds(F.floor("freshness")), "yyyy-MM-dd")
    instant = F.date_format(F.timestamp_millis(F.floor(F.col("authored") * 1000)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    shown = ["description", "resource", "source", instant.alias("authored"), "write_actor"] if set(DECLARED) <= set(rows.columns) else []
    return out.select(
        "qid", F.col("place").cast("int").alias("rank"), "id", "path", "title", F.round("score", 6).alias("score"), F.coalesce("trust", F.lit("untrusted")).alias("trust"),
        F.when(F.col("volatile"), True).alias("volatile"), fresh.alias("freshness"), F.col("duplicates").cast("int").alias("duplicates"), *shown,
    )


def candidates(index: Tables, queries: DataFrame, k: int = 5, mode: str = "v2", rrf_k: int = A.RRF_K) -> DataFrame:
    """Fused lists (qid, id, score) for ``queries`` (qid, query, v); v may be null."""
    n = A.list_length(k)
    text = stage(A.text_arm(index.postings, index.lengths, queries, n))
    vector = stage(A.vector_arm(index.chunks, queries.filter("v is not null"), n))
    graph = A.graph_arm(index.edges, index.nodes.select("id"), A.seeds(text, vector, k), k, mode)
    return A.fuse(text, vector, graph, k=rrf_k)


def recall(index: Tables, queries: DataFrame, k: int = 5, mode: str = "v2", reranker=None) -> DataFrame:
    """The k best pages of each query: three arms, fusion, priors, collapse, tie-break, cut and optional rerank.

    ``index`` has the tables of a stored index. ``reranker`` gets the rows with their pages and returns (qid, id, rr).
    """
    k = A.asked_for(k)
    rows = tiebreak(collapse(adjust(candidates(index, queries, k, mode), index.nodes, queries)))
    if reranker is not None:
        rows = stage(rows)
        rows = rerank(rows, reranker(rows.filter(F.col("place") <= 4 * k).join(index.nodes.select("id", "body"), "id")), k)
    return shape(rows, k)


def term_overlap(rows: DataFrame) -> DataFrame:
    """A plain reranker: the share of the query's terms that stand in title and body."""
    from graphmere.functions import text as T

    q = F.array_distinct(T.query_tokens(F.col("query")))
    t = T.index_tokens(F.concat_ws("\n", "title", "body"))
    return rows.select("qid", "id", (F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))).alias("rr"))
