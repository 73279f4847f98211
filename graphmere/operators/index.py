"""The stored index: pages, edges, chunks, postings, lengths and degrees, kept up to date by content hash."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmere.operators import chunking, graph, maintenance, retrieval
from graphmere.operators.embedding import Embedder, embed_chunks
from graphmere.session import sized, stage
from graphmere.sources import markdown, store

NODE = ("id", "path", "title", "type", "description", "body", "content_hash", "embedding_signature", "trust", "volatile", "freshness", "resource", "source", "authored", "write_actor")
#: The column by which each table is cut into buckets: rows of one page are in one bucket of each.
OWNERS = {"nodes": "id", "edges": "source", "chunks": "page_id", "postings": "id", "lengths": "id"}
BUCKET_ROWS = 200_000
SMALL_ROWS = 200_000
#: Versions that take part in the generation: of the parser and of the tables.
PARSER, SCHEMA = "headers-links/2", str(store.SCHEMA_VERSION)


@dataclass
class Tables:
    """The tables of an index."""

    nodes: DataFrame
    edges: DataFrame  # source, type, target, weight
    chunks: DataFrame  # chunk_id or page_id, ord, v
    postings: DataFrame  # term, id, dl, tf_title, tf_description, tf_body
    lengths: DataFrame  # id, dl


def text_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of pages; their texts are cut into words once for both."""
    tokens = retrieval.field_tokens(pages)
    return retrieval.postings_of(tokens), tokens.select("id", "dl")


def prepared(items: DataFrame, signature: str) -> DataFrame:
    """Items as rows of the index: defaults filled in, edges each once by type as spelled and target, content hash.

    Null ids are dropped; of several rows of one id, and of tombstoned ones, the caller has chosen before.
    """
    edges = F.coalesce("edges", F.array().cast(markdown.EDGES))
    rows = items.filter("id is not null").withColumns({
        "path": F.coalesce("path", F.concat("id", F.lit(".md"))), "trust": F.coalesce("trust", F.lit("untrusted")), "volatile": F.coalesce("volatile", F.lit(False)),
        "write_actor": F.coalesce("write_actor", F.lit("unknown")), "edges": F.filter(edges, lambda e: F.coalesce(e.target, F.lit("")) != ""),
    })
    rows = rows.withColumns({"content_hash": maintenance.content_hash(F.col("title"), F.col("body"), maintenance.edges_json(F.col("edges"))), "embedding_signature": F.lit(signature)})
    return rows.select(*NODE, "edges")


def edge_rows(rows: DataFrame) -> DataFrame:
    """(source, type, target, weight): the first of each; a null weight is 1."""
    each = rows.select(F.col("id").alias("source"), F.posexplode("edges").alias("pos", "e"))
    each = each.select("source", F.coalesce("e.type", F.lit("related_to")).alias("type"), "e.target", F.coalesce("e.weight", F.lit(1.0)).alias("weight"), "pos")
    return each.groupBy("source", "type", "target").agg(F.min_by("weight", "pos").alias("weight"))


def generation(nodes: DataFrame, signature: str, scope: str | None = None) -> str:
    """The name of what an index was made from, wherever it was made: path, content hash, trust, source and
    authored of each page, the scope, and the versions of parser, embedding and tables. Not who wrote a page."""
    lines = nodes.select(F.to_json(F.array(markdown.generation_path(F.col("path")), "content_hash", "trust", "source", F.floor(F.col("authored") * 1e6).cast("string"))).alias("line"))
    digest = graph.set_hash(lines).select(F.sha2(F.concat_ws("\n", "digest", F.lit(scope or "all"), F.lit(PARSER), F.lit(signature), F.lit(SCHEMA)), 256)).first()[0]
    return f"v1:{digest}"


def open_index(spark: SparkSession, root: str) -> Tables:
    now = store.read_pointer(spark, root)
    return Tables(*(store.open_table(spark, root, t, now) for t in OWNERS))


def reindex(
    spark: SparkSession, root: str, items: DataFrame, embedder: Embedder, full: bool = True, fresh: bool = False, scope: str | None = None, compact: Callable[[Column], Column] | None = None,
) -> dict[str, int]:
    """Bring the index under ``root`` up to ``items`` and return {files, indexed, skipped, tombstoned, pruned, synced}.

    ``items`` has one row for each page: id, path, title, type, body, edges, trust, volatile, freshness, description,
    resource, source, authored, write_actor, and tombstoned if there are such pages. Pages with a new content hash, or
    made with another embedding, are cut, embedded and written anew with their edges and postings. Of the others only
    metadata that differs is written; an unknown actor never replaces a known one. A ``full`` run prunes pages that
    are not in ``items`` or tombstoned; another run adds only. ``fresh`` forgets the old index first. ``compact`` may
    shorten bodies before they are indexed.

    Only the buckets of pages that differ are written, and if none differ nothing is. The new tables are complete, and
    their pages hash to the generation that was meant, before the pointer moves. A crash before leaves the old index.
    """
    files = items.count()
    dead = F.coalesce(F.col("tombstoned"), F.lit(False)) if "tombstoned" in items.columns else F.lit(False)
    live = items.filter(~dead)
    if compact is not None:
        live = live.withColumn("body", compact(F.col("body")))
    signature = embedder.signature()
    rows = stage(prepared(live, signature))
    now = None if fresh else store.read_pointer(spark, root)
    n = now["tables"]["nodes"]["buckets"] if now else max(8, -(-files // BUCKET_ROWS))
    old = store.open_table(spark, root, "nodes", now) if now else spark.createDataFrame([], rows.drop("edges").schema)
    status = stage(statuses(rows, old))
    count = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    out = {"files": files, "indexed": count.get("new", 0) + count.get("changed", 0), "skipped": count.get("same", 0) + count.get("meta", 0), "tombstoned": files - rows.count(), "pruned": count.get("absent", 0) if full else 0, "synced": count.get("meta", 0)}
    differ = status.filter("status != 'same'" if full else "status not in ('same', 'absent')")
    touched = sorted(r[0] for r in differ.select(store.bucket(F.col("id"), n).alias("b")).distinct().collect())
    if now and not touched:
        return out
    ids = lambda *kinds: sized(status.filter(F.col("status").isin(*kinds)).select("id"), SMALL_ROWS)
    gone = ids("changed", "new", *(["absent"] if full else []))
    here = lambda t: store.open_table(spark, root, t, now, touched)
    anew = rows.join(ids("changed", "new"), "id", "left_semi")
    pieces = embed_chunks(chunking.chunk_pages(anew), embedder)
    meta = rows.join(ids("meta"), "id", "left_semi")
    parts = {"nodes": anew.drop("edges"), "edges": edge_rows(anew), "chunks": pieces}
    # A new description changes the words of a page.
    parts["postings"], parts["lengths"] = text_tables(anew.drop("edges").unionByName(meta.drop("edges")))
    tables = {}
    for t, new in parts.items():
        if now:
            kept = here(t).join(gone.withColumnRenamed("id", OWNERS[t]), OWNERS[t], "left_anti")
            if t in ("postings", "lengths"):
                kept = kept.join(ids("meta"), "id", "left_anti")
            if t == "nodes":
                kept = kept.join(ids("meta"), "id", "left_anti")
                stored = here(t).join(ids("meta", "changed"), "id", "left_semi").select("id", F.col("write_actor").alias("_w"))
                new = known_actors(new.unionByName(meta.drop("edges")), stored)
            new = kept.unionByName(new)
        tables[t] = new
    # What the pages must hash to; the tables are checked against it after they are written.
    rest = old.join(ids("changed", "new", "meta", *(["absent"] if full else [])), "id", "left_anti").select("path", "content_hash", "trust", "source", "authored")
    meant = generation(rest.unionByName(rows.join(ids("changed", "new", "meta"), "id", "left_semi").select(*rest.columns)), signature, scope)
    built = lambda manifest: generation(store.open_table(spark, root, "nodes", manifest), signature, scope) == meant
    store.publish(spark, root, tables, f"{meant}+{actors_mark(status)}" if count.get("meta") else meant, OWNERS, n, touched if now else None, built)
    return out


def remove(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """Take the pages ``ids`` (id) out of all tables and return how many there were; edges that point to them stay.

    Only the buckets of pages that are there are written.
    """
    now = store.read_pointer(spark, root)
    if now is None:
        return 0
    n = now["tables"]["nodes"]["buckets"]
    ids = stage(ids.filter("id is not null").select("id").distinct())
    cells = lambda df: sorted(r[0] for r in df.select(store.bucket(F.col("id"), n)).distinct().collect())
    there = stage(store.open_table(spark, root, "nodes", now, cells(ids)).select("id").join(sized(ids, SMALL_ROWS), "id", "left_semi"))
    touched, count = cells(there), there.count()
    if count:
        gone = sized(there, SMALL_ROWS)
        tables = {t: store.open_table(spark, root, t, now, touched).join(gone.withColumnRenamed("id", o), o, "left_anti") for t, o in OWNERS.items()}
        mark = graph.set_hash(there.select(F.col("id").alias("line"))).first()["digest"][:16]
        store.publish(spark, root, tables, f"{now['generation']}-{mark}", OWNERS, n, touched)
    return count


def actors_mark(status: DataFrame) -> str:
    """Tells a run that changed metadata outside the generation from the one before."""
    return graph.set_hash(status.filter("status = 'meta'").select(F.col("id").alias("line"))).first()["digest"][:16]


def statuses(rows: DataFrame, old: DataFrame) -> DataFrame:
    """(id, status): new, changed, meta, same or absent, by hash, embedding and metadata of each page."""
    cols = ("content_hash", "embedding_signature", *maintenance.META)
    a, b = (x.select("id", F.struct(*cols).alias(k), F.col("write_actor").alias(f"{k}_actor")) for x, k in ((rows, "new"), (old, "old")))
    both = a.join(b, "id", "full_outer")
    same = lambda *c: F.struct(*(F.col(f"new.{x}") for x in c)).eqNullSafe(F.struct(*(F.col(f"old.{x}") for x in c)))
    actor = F.coalesce(F.nullif("new_actor", F.lit("unknown")), "old_actor").eqNullSafe(F.col("old_actor"))
    status = F.when(F.col("new").isNull(), "absent").when(F.col("old").isNull(), "new").when(~same("content_hash", "embedding_signature"), "changed").when(~same(*maintenance.META) | ~actor, "meta").otherwise("same")
    return both.select("id", status.alias("status"))


def known_actors(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` with the stored actor where theirs is unknown."""
    both = rows.join(stored, "id", "left")
    return both.withColumn("write_actor", F.coalesce(F.nullif("write_actor", F.lit("unknown")), "_w", "write_actor")).drop("_w")


def build(spark: SparkSession, root: str, pages: DataFrame, edges: DataFrame, chunks: DataFrame, name: str) -> Tables:
    """An index under ``root`` from pages, edges and chunks that are there already, published as ``name``."""
    n = max(8, -(-pages.count() // BUCKET_ROWS))
    written = lambda t, m: store.open_table(spark, root, t, m)

    def lengths(m: dict) -> DataFrame:
        found = written("postings", m).groupBy("id").agg(F.first("dl").alias("dl"))
        return written("nodes", m).select("id").join(found, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"))

    # Words are counted from the pages as they are written: their texts are shuffled once, the postings not at all.
    tables = {"nodes": pages, "edges": edges, "chunks": chunks, "postings": lambda m: retrieval.postings(written("nodes", m)), "lengths": lengths}
    store.publish(spark, root, tables, name, OWNERS, n, placed=("postings",))
    return open_index(spark, root)
