"""Neighbourhoods, typed and similarity edges, degrees and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmere.functions import ranking as R
from graphmere.functions import text as T
from graphmere.operators import retrieval as A
from graphmere.operators.joins import spread_join
from graphmere.session import stage


def head_vectors(chunks: DataFrame) -> DataFrame:
    """The first chunk of each page: it stands for the page."""
    return chunks.filter("ord = 0")


def neighbours_similar(chunks: DataFrame, asked: DataFrame, k: int = 8, least: float | None = None) -> DataFrame:
    """(qid, id, similarity, rnk): the k pages most like each asked page, by head vectors, itself excluded."""
    heads = stage(head_vectors(chunks))
    vectors = heads.join(asked.select(F.col("id").alias("page_id")), "page_id").select(F.col("page_id").alias("qid"), "v")
    found = A.vector_scan(heads, vectors, k + 1, ("page_id",)).withColumnRenamed("page_id", "id").filter("qid != id")
    found = found.withColumn("similarity", F.round("similarity", 9))
    if least is not None:
        found = found.filter(F.col("similarity") >= least)
    return A.ranked(found.select("qid", "id", "similarity"), k, F.desc("similarity"), "id").withColumn("similarity", T.round_half_up(F.col("similarity"), 3))


def neighbour_edges(edges: DataFrame, pages: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, direction, type, other, title, weight): edges of the asked pages both ways; dangling ends keep a null title."""
    titles = pages.select(F.col("id").alias("other"), "title")
    q = asked.select(F.col("id").alias("qid"))
    out = edges.select(F.col("source").alias("qid"), F.lit("out").alias("direction"), "type", F.col("target").alias("other"), "weight")
    back = edges.select(F.col("target").alias("qid"), F.lit("in").alias("direction"), "type", F.col("source").alias("other"), "weight")
    return out.join(q, "qid").unionByName(back.join(q, "qid")).join(titles, "other", "left").select("qid", "direction", "type", "other", "title", "weight")


def typed_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges of which both ends exist, with the family of their type."""
    ids = pages.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns)
    kept = spread_join(kept, ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    return kept.withColumn("family", R.family(F.col("type")))


def pairs(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: linked pages, whatever the direction, type or number of edges; loops are left out."""
    return edges.filter("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def similarity_edges(chunks: DataFrame, typed: DataFrame, asked: DataFrame, k: int = 6, cutoff: float = 0.8) -> DataFrame:
    """(a, b, weight): asked pages and their k most similar, at least ``cutoff``, each pair once, without typed pairs."""
    near = neighbours_similar(chunks, asked, k, cutoff)
    near = near.groupBy(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b")).agg(F.max("similarity").alias("weight"))
    return near.join(pairs(typed), ["a", "b"], "left_anti")


def degree(typed: DataFrame) -> DataFrame:
    """(id, degree) in the simple undirected graph."""
    return pairs(typed).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def communities(typed: DataFrame, rounds: int | None = None, similar: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, community, size, place): communities merged while that gains modularity, named by their lowest page.

    Typed pairs have the largest of their weights; ``similar`` (a, b, weight) adds pairs, ``ids`` pages without
    links, each its own community. In each round a community proposes to the one it gains most with, if that is
    the larger; one that proposes to none takes its suitors in the order of their gain while each still gains
    after all before it. So every merger adds modularity, the best of a round takes place, and the end is
    reached when no merger of two communities gains. ``rounds`` limits the rounds; by default nothing does.
    """
    links = typed.filter("source != target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("weight").cast("double").alias("weight"))
    if similar is not None:
        links = links.unionByName(similar.select("a", "b", F.col("weight").cast("double").alias("weight"))).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    links = stage(links.filter("weight > 0"))
    every = links.select(F.explode(F.array("a", "b")).alias("id"))
    labels = stage((every if ids is None else every.unionByName(ids.select("id"))).distinct().withColumn("label", F.col("id")))
    total = 2 * (links.agg(F.sum("weight")).first()[0] or 0.0)
    both = lambda x, y: F.explode(F.array(F.struct(x.alias("own"), y.alias("other")), F.struct(y.alias("own"), x.alias("other"))))
    between = links.select(both(F.col("a"), F.col("b")).alias("e"), "weight").select("e.*", "weight")
    ends = between.groupBy("own").agg(F.sum("weight").alias("ends"))
    # Pairs of communities with the weight between them, both ways, and the weight of all ends in each.
    between = stage(between.join(ends, "own").join(ends.select(F.col("own").alias("other"), F.col("ends").alias("theirs")), "other"))
    done, pending = 0, 0
    while total and (rounds is None or done < rounds):
        done += 1
        rows = between.withColumn("gain", F.col("weight") - F.col("ends") * F.col("theirs") / total).filter(F.col("gain") > 1e-9 * F.col("weight"))
        best = stage(rows.groupBy("own").agg(F.min_by(F.struct("other", "weight", "ends", "theirs", "gain"), F.struct(-F.col("gain"), -F.col("theirs"), "other")).alias("m")).select("own", "m.*"))
        suitors = best.filter(F.struct("theirs", "other") > F.struct("ends", "own"))
        suitors = suitors.join(suitors.select(F.col("own").alias("other")), "other", "left_anti")
        before = Window.partitionBy("other").orderBy(F.desc("gain"), "own").rowsBetween(Window.unboundedPreceding, -1)
        room = F.col("weight") - F.col("ends") * (F.col("theirs") + F.coalesce(F.sum("ends").over(before), F.lit(0.0))) / total
        taken = suitors.withColumn("room", room).filter("room > 0")
        grown = F.col("theirs") + F.sum("ends").over(Window.partitionBy("other"))
        moves = stage(taken.select("own", F.col("other").alias("to"), grown.alias("now")))
        if not moves.take(1):
            break
        # Where each community that changed is now, and its ends: those that moved and those that took them.
        change = moves.unionByName(moves.select(F.col("to").alias("own"), "to", "now").distinct())

        def moved(df: DataFrame, name: str, sum_: str, change: DataFrame = change) -> DataFrame:
            at = change.select(F.col("own").alias(name), F.col("to").alias("_to"), F.col("now").alias("_now"))
            return df.join(at, name, "left").withColumns({name: F.coalesce("_to", name), sum_: F.coalesce("_now", sum_)}).drop("_to", "_now")

        labels, pending = labels.join(moves.select(F.col("own").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), pending + 1
        if pending == 8:
            labels, pending = stage(labels), 0
        between = moved(moved(between, "own", "ends"), "other", "theirs").filter("own != other")
        between = stage(between.groupBy("own", "other").agg(F.sum("weight").alias("weight"), F.max("ends").alias("ends"), F.max("theirs").alias("theirs")))
    labels = stage(labels)
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("community"))
    # The place is the number of larger communities; only the few different sizes are put in order.
    larger = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.groupBy("size").agg(F.count("*").alias("n")).select("size", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("place"))
    return labels.join(sizes.join(places, "size"), "label").select("id", "community", "size", "place")


def set_hash(lines: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """One row (digest, n): a hash of a bag of ``line`` strings, whatever their order.

    The four 64-bit parts of the lines' hashes are added up modulo 2^64 and the sums are hashed: partial sums are
    combined before they are shuffled, and no task sees or sorts all lines. Null lines count as empty.
    """
    h = lines.select(F.sha2(F.coalesce("line", F.lit("")), 256).alias("h"))
    part = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = h.agg(*(F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)), F.count("*").alias("n"))
    whole = F.concat_ws(",", *(F.pmod(F.col(f"s{i}"), F.lit(str(2**64)).cast("decimal(38,0)")).cast("string") for i in range(4)))
    return sums.select((F.sha2(whole, 256) if algorithm == "sha256" else F.md5(whole)).alias("digest"), "n")


def signature(live: DataFrame, k: int = 6, cutoff: float = 0.8) -> str:
    """What a stored graph was made from: number and content of the pages (id, content_hash), and its parameters."""
    row = set_hash(live.select(F.concat_ws(",", "id", "content_hash").alias("line")), "md5").first()
    return f"graph:{row['n']}:{row['digest']}:sim{k}@{cutoff:g}"


def graph_tables(edges: DataFrame, pages: DataFrame, chunks: DataFrame, k: int = 6, cutoff: float = 0.8) -> dict[str, DataFrame]:
    """The whole graph as tables: nodes (id, label, type, trust, degree, community, place) and links (a, b, type, family, weight)."""
    typed = stage(typed_edges(edges, pages))
    similar = stage(similarity_edges(chunks.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi"), typed, pages.select("id"), k, cutoff))
    found = communities(typed, similar=similar, ids=pages)
    nodes = pages.select("id", T.label(F.col("title"), F.col("id")).alias("label"), "type", "trust")
    nodes = nodes.join(found.select("id", "community", "place"), "id", "left").join(degree(typed), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    links = typed.select(F.col("source").alias("a"), F.col("target").alias("b"), "type", "family", "weight")
    near = similar.select("a", "b", F.lit("similar-to").alias("type"), F.lit("similarity").alias("family"), "weight")
    return {"nodes": nodes, "links": links.unionByName(near)}
