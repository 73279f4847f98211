"""Named queries over the given tables and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmere.functions import ranking as R
from graphmere.functions import text as T
from graphmere.operators import chunking, graph, index, lifecycle, maintenance, orphans, pages, recall, retrieval, times
from graphmere.operators.embedding import hashed_words
from graphmere.plans import sql as S
from graphmere.session import scratch, stage, stage_table, table
from graphmere.sources import markdown

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(S.chain(S.WRITTEN) + "SELECT item_seq, field, utc_us FROM instants WHERE utc_us IS NOT NULL")
def p1_found(spark, d):
    out = times.normalise_times(table(spark, d, "memory_items"), table(spark, d, "actors"))
    return out.filter("utc_us is not null").select("item_seq", "field", "utc_us")


@query(S.chain(S.WRITTEN) + "SELECT field, status, count(*) AS n FROM instants GROUP BY ALL")
def p1_status(spark, d):
    out = times.normalise_times(table(spark, d, "memory_items"), table(spark, d, "actors"))
    return out.groupBy("field", "status").agg(F.count("*").alias("n"))


_BROKEN = f"""
WITH p AS (SELECT nfc_normalize(id) AS key, indexed_at, removed_at FROM nodes UNION ALL SELECT nfc_normalize(id), indexed_at, removed_at FROM entities),
r AS (SELECT edge_id, 'source' AS side, {S.KEY.format(c="source")} AS key, seen_at FROM edges
      UNION ALL SELECT edge_id, 'target', {S.KEY.format(c="target")}, seen_at FROM edges),
o AS (SELECT edge_id, side, seen_at FROM r WHERE key IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM p WHERE p.key = r.key AND p.indexed_at <= r.seen_at AND (p.removed_at IS NULL OR r.seen_at < p.removed_at)))
"""


def _orphans(spark, d):
    return orphans.orphan_state(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "entities"))


@query(_BROKEN + "SELECT edge_id, side FROM o")
def p4_found(spark, d):
    return _orphans(spark, d).open.select("edge_id", "side")


@query(_BROKEN + "SELECT 'edges' AS referring, side, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans FROM o GROUP BY ALL")
def p4_counts(spark, d):
    last = _orphans(spark, d).snapshots
    return last.filter(F.col("batch") == last.agg(F.max("batch")).first()[0]).select(F.lit("edges").alias("referring"), "side", "month", "orphans")


@query(_BROKEN.replace("WITH p AS", """WITH span AS (SELECT min(epoch_us(loaded_at)) AS a, max(epoch_us(loaded_at)) AS b FROM edges),
cut AS (SELECT 1 AS batch, make_timestamptz(a + round((b - a) / 3.0)::BIGINT) AS t FROM span UNION ALL SELECT 2, make_timestamptz(a + round((b - a) * 2 / 3.0)::BIGINT) FROM span UNION ALL SELECT 3, NULL),
p AS""").replace("seen_at FROM edges", "seen_at, loaded_at FROM edges").replace("o AS (SELECT edge_id, side, seen_at FROM r WHERE key IS NOT NULL", "o AS (SELECT batch, side, seen_at FROM r, cut WHERE key IS NOT NULL AND (t IS NULL OR loaded_at < t)")
.replace("p.indexed_at <= r.seen_at AND (p.removed_at IS NULL OR", "p.indexed_at <= r.seen_at AND (t IS NULL OR p.indexed_at < t) AND (p.removed_at IS NULL OR greatest(p.indexed_at, p.removed_at) >= t OR")
+ "SELECT batch, side, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans FROM o GROUP BY ALL")
def p4_snapshots(spark, d):
    """The counts after each third of the history, as they stood then."""
    return _orphans(spark, d).snapshots.select("batch", "side", "month", "orphans")


# Retrieval. The queries are the titles of the items whose item_seq is divisible by 100, against all pages; those
# of neighbourhoods are the pages whose row_no is.


def _tables(spark, d):
    """Pages, edges and chunks as they stand now, from the given tables."""
    return pages.current_pages(table(spark, d, "nodes"), table(spark, d, "entities")), pages.current_edges(table(spark, d, "edges")), pages.current_chunks(table(spark, d, "chunks"))


_BUILT: dict[tuple[str, str], str] = {}


def stored_index(spark, d):
    """The stored index of the given tables, built by the first query of a session that needs it and then read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        root = scratch(spark, "index")
        index.build(spark, root, *_tables(spark, d), "given")
        _BUILT[key] = root
    return index.open_index(spark, _BUILT[key])


def _pages(spark, d):
    return stored_index(spark, d).nodes


def _edges(spark, d):
    return stored_index(spark, d).edges


def _chunks(spark, d):
    return stored_index(spark, d).chunks


def _asked(spark, d):
    """(qid, query, v): v is the head vector of the item's page, null if it has none."""
    asked = table(spark, d, "memory_items").filter("item_seq % 100 = 0 and title is not null")
    heads = _chunks(spark, d).filter("ord = 0").select(F.col("page_id").alias("id"), "v")
    return stage(asked.select(F.col("item_seq").cast("string").alias("qid"), F.col("title").alias("query"), "id").join(heads, "id", "left").drop("id"))


def _asked_pages(spark, d):
    return _last_rows(table(spark, d, "nodes")).filter("live and row_no % 100 = 0").select("id")


N = retrieval.list_length(5)


def _text_arm(spark, d):
    ix = stored_index(spark, d)
    return retrieval.text_arm(ix.postings, ix.lengths, _asked(spark, d), N)


def _vector_arm(spark, d):
    return retrieval.vector_arm(_chunks(spark, d), _asked(spark, d).filter("v is not null"), N)


def _seeds(spark, d):
    return stage(retrieval.seeds(stage(_text_arm(spark, d)), stage(_vector_arm(spark, d)), 5))


def _fused(spark, d, k=retrieval.RRF_K):
    return recall.candidates(stored_index(spark, d), _asked(spark, d), 5, rrf_k=k)


@query(S.chain(*S.TO_TERMS) + "SELECT qid, term, times FROM qterms")
def fts_query_terms(spark, d):
    return retrieval.query_terms(_asked(spark, d))


@query(f"""SELECT doc_id, len(t) AS tokens, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, {S.TOKENS.format(c="text")} AS t FROM documents)""")
def fts_tokenize(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.index_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query(S.chain(*S.TO_TERMS, S.POSTINGS) + "SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM corpus")
def fts_corpus_stats(spark, d):
    return retrieval.corpus_stats(stored_index(spark, d).lengths).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(S.chain(S.LAST, S.POSTINGS.replace("WHERE term IN (SELECT term FROM qterms) ", "")) + "SELECT term, count(*) AS pages, round(sum(wtf), 3) AS weight FROM post GROUP BY term")
def fts_postings(spark, d):
    return retrieval.weighted(stored_index(spark, d).postings).groupBy("term").agg(F.count("*").alias("pages"), F.round(F.sum("wtf"), 3).alias("weight"))


@query(S.chain(*S.TO_FTS) + "SELECT qid, id, round(score, 6) AS score, rnk FROM fts")
def fts_bm25_topk(spark, d):
    return _text_arm(spark, d).select("qid", "id", F.round("score", 6).alias("score"), F.col("rnk").cast("long").alias("rnk"))


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: length(x) >= 2), lambda x: '"' || x || '"'), ' OR ') AS q FROM documents""")
def fts_query_string(spark, d):
    return table(spark, d, "documents").select("doc_id", T.match_expression(F.col("text")).alias("q"))


@query(S.chain(*S.TO_TERMS, S.VEC) + "SELECT qid, id, round(similarity, 6) AS similarity, rnk FROM vec")
def vec_cosine_topk(spark, d):
    return _vector_arm(spark, d).select("qid", "id", F.round("similarity", 6).alias("similarity"), F.col("rnk").cast("long").alias("rnk"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2) AS t FROM documents) SELECT doc_id, array_to_string(t, ' | ') AS q FROM t""")
def fts_query_any(spark, d):
    return table(spark, d, "documents").select("doc_id", T.any_of(F.col("text")).alias("q"))


@query(S.chain(*S.TO_TERMS, S.POSTINGS) + """, ask AS (SELECT qid, unnest(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda x: length(x) >= 2))) AS term FROM asked),
size AS (SELECT qid, count(*) AS size FROM ask GROUP BY 1),
places AS (SELECT term, id, row_number() OVER (PARTITION BY term, id ORDER BY w DESC) AS j, CASE WHEN w = 10 THEN 1.0 ELSE 0.1 END AS w FROM flat WHERE term IN (SELECT term FROM ask)),
part AS (SELECT term, id, sum(w / (j * j)) / 1.64493406685 AS w FROM places WHERE j <= 256 GROUP BY ALL),
ranked AS (SELECT qid, id, round(sum(w) / any_value(size), 9) AS score FROM part JOIN ask USING (term) JOIN size USING (qid) GROUP BY ALL)
SELECT qid, id, round(score, 6) AS score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rnk FROM ranked) WHERE rnk < 20""")
def fts_rank_topk(spark, d):
    out = retrieval.rank_arm(stored_index(spark, d).postings, _asked(spark, d), N)
    return out.select("qid", "id", F.round("score", 6).alias("score"), F.col("rnk").cast("long").alias("rnk"))


@query(S.chain(*S.TO_TERMS, S.VEC) + ", best AS (SELECT qid, page_id AS id, ord::INT AS ord, round(similarity, 4) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY place) AS i FROM firstv) SELECT qid, id, ord, similarity FROM best WHERE i <= 20")
def vec_best_chunk_per_page(spark, d):
    best = retrieval.best_chunks(_chunks(spark, d), _asked(spark, d).filter("v is not null"), N)
    return best.select("qid", "id", "ord", F.round("similarity", 4).alias("similarity"))


@query(S.chain(*S.TO_SEEDS, S.OUT, S.graph_list("SELECT * FROM outs")) + "SELECT qid, id, round(score, 6) AS score, rnk FROM graph")
def graph_arm_out(spark, d):
    out = retrieval.graph_arm(_edges(spark, d), _pages(spark, d).select("id"), _seeds(spark, d), 5)
    return out.select("qid", "id", F.round("score", 6).alias("score"), F.col("rnk").cast("long").alias("rnk"))


@query(S.chain(*S.TO_SEEDS, S.OUT, S.IN, S.graph_list("SELECT * FROM outs UNION ALL SELECT * FROM ins")) + "SELECT qid, id, round(score, 6) AS score, rnk FROM graph")
def graph_arm_in(spark, d):
    out = retrieval.graph_arm(_edges(spark, d), _pages(spark, d).select("id"), _seeds(spark, d), 5, "v2in")
    return out.select("qid", "id", F.round("score", 6).alias("score"), F.col("rnk").cast("long").alias("rnk"))


@query(S.chain(*S.TO_SEEDS) + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best, id) AS place FROM seeds),
hits AS (SELECT qid, target AS id, min(place) AS place FROM links JOIN ordered ON source = ordered.id GROUP BY ALL)
SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, id) - 1 AS rnk FROM hits) WHERE rnk < 20""")
def graph_arm_legacy(spark, d):
    out = retrieval.graph_arm(_edges(spark, d), _pages(spark, d).select("id"), _seeds(spark, d), 5, "legacy")
    return out.select("qid", "id", F.col("rnk").cast("long").alias("rnk"))


@query(S.chain(S.EDGES) + """SELECT coalesce(a.id, b.id) AS id, coalesce(a.deg, 0) AS indegree, coalesce(b.deg, 0) AS outdegree FROM
(SELECT target AS id, count(DISTINCT source) AS deg FROM links GROUP BY 1) a FULL JOIN (SELECT source AS id, count(DISTINCT target) AS deg FROM links GROUP BY 1) b ON a.id = b.id""")
def hub_degrees(spark, d):
    into, out = retrieval.degrees(_edges(spark, d))
    both = into.withColumnRenamed("deg", "i").join(out.withColumnRenamed("deg", "o"), "id", "full_outer")
    return both.select("id", F.coalesce("i", F.lit(0)).alias("indegree"), F.coalesce("o", F.lit(0)).alias("outdegree"))


@query(S.chain(*S.TO_FUSED) + "SELECT qid, id, round(score, 6) AS score FROM fused")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("qid", "id", F.round("score", 6).alias("score"))


@query(S.chain(*S.TO_SEEDS, S.OUT, S.graph_list("SELECT * FROM outs"), S.fuse(60)) + "SELECT qid, id, round(score, 6) AS score FROM fused")
def rrf_fuse_k60(spark, d):
    return _fused(spark, d, 60).select("qid", "id", F.round("score", 6).alias("score"))


@query(S.chain(*S.TO_FUSED, S.ADJUSTED) + "SELECT qid, id, zone, round(adj, 6) AS adj, pos FROM placed")
def trust_zone_entity_adjust(spark, d):
    out = recall.adjust(_fused(spark, d), _pages(spark, d), _asked(spark, d))
    return out.select("qid", "id", R.zone(F.col("path")).alias("zone"), F.round("adj", 6).alias("adj"), F.col("pos").cast("long").alias("pos"))


@query(S.chain(*S.TO_FUSED, S.ADJUSTED, S.COLLAPSED) + "SELECT qid, id, slot, CASE WHEN n > 1 THEN n - 1 END AS duplicates FROM kept")
def collapse_duplicates(spark, d):
    out = recall.collapse(recall.adjust(_fused(spark, d), _pages(spark, d), _asked(spark, d)))
    return out.select("qid", "id", F.col("slot").cast("long").alias("slot"), "duplicates")


@query(S.chain(*S.TO_FINAL, recursive=True) + "SELECT qid, id, place FROM final")
def recency_tiebreak(spark, d):
    out = recall.tiebreak(recall.collapse(recall.adjust(_fused(spark, d), _pages(spark, d), _asked(spark, d))))
    return out.select("qid", "id", F.col("place").cast("long").alias("place"))


@query(S.chain(*S.TO_FINAL, recursive=True) + S.SHAPE)
def recall_hybrid(spark, d):
    return recall.recall(stored_index(spark, d), _asked(spark, d))


@query(S.chain(*S.TO_FINAL, f"""
words AS (SELECT f.qid, f.id, list_distinct(list_filter({S.TOKENS.format(c="query")}, lambda x: length(x) >= 2)) AS q, {S.TOKENS.format(c="concat_ws(chr(10), f.title, body)")} AS t
  FROM final f JOIN asked a ON a.qid = f.qid JOIN pages p ON p.id = f.id WHERE place <= 20),
rr AS (SELECT qid, id, len(list_filter(q, lambda x: list_contains(t, x))) / greatest(len(q), 1)::DOUBLE AS rr FROM words)""", recursive=True)
+ "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rr DESC NULLS LAST, place)::INT AS rank FROM final JOIN rr USING (qid, id) WHERE place <= 20 QUALIFY rank <= 5")
def recall_rerank(spark, d):
    out = recall.recall(stored_index(spark, d), _asked(spark, d), reranker=recall.term_overlap)
    return out.select("qid", "id", "rank")


@query(S.chain(*S.TO_FINAL, recursive=True) + "SELECT id AS memory, count(*) AS hits FROM final WHERE place <= 5 GROUP BY 1")
def recall_hits(spark, d):
    """The recalled rows as events, counted."""
    rows = recall.recall(stored_index(spark, d), _asked(spark, d))
    return maintenance.recall_stats(maintenance.recall_events(rows)).select("memory", "hits")


# Graph.


@query(S.chain(S.LAST, S.CHUNKS, S.ASKED_PAGES) + """SELECT qid, id, floor(similarity * 1000 + 0.5) / 1000 AS similarity, rnk FROM (
SELECT qid, page_id AS id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, page_id) - 1 AS rnk FROM
(SELECT qid, page_id, round(list_cosine_similarity(q.v, h.v), 9) AS similarity FROM vectors q JOIN heads h ON page_id <> qid)) WHERE rnk < 8""")
def neighbors_similar(spark, d):
    asked = _asked_pages(spark, d)
    return graph.neighbours_similar(_chunks(spark, d), asked).withColumn("rnk", F.col("rnk").cast("long"))


@query(S.chain(S.LAST, S.CHUNKS, S.ASKED_PAGES, S.EDGES) + """, e AS (SELECT source AS qid, 'out' AS direction, type, target AS other, weight FROM links
UNION ALL SELECT target, 'in', type, source, weight FROM links)
SELECT e.qid, direction, e.type, other, p.title, weight FROM e JOIN asked USING (qid) LEFT JOIN pages p ON p.id = other""")
def neighbors_edges(spark, d):
    return graph.neighbour_edges(_edges(spark, d), _pages(spark, d), _asked_pages(spark, d))


_TYPED = S.chain(S.LAST, S.EDGES) + ", typed AS (SELECT * FROM links WHERE source IN (SELECT id FROM pages) AND target IN (SELECT id FROM pages)), pair AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM typed WHERE source <> target)"
_FAMILY = "CASE " + " ".join(f"WHEN type IN ({', '.join(repr(x) for x in kinds)}) THEN '{f}'" for f, kinds in R.FAMILIES.items() if f != "structural") + " ELSE 'structural' END"


def _typed(spark, d):
    return graph.typed_edges(_edges(spark, d), _pages(spark, d))


@query(_TYPED + f" SELECT source, type, target, weight, {_FAMILY} AS family FROM typed")
def graph_typed_edges(spark, d):
    return _typed(spark, d)


@query(_TYPED + "," + S.CHUNKS + "," + S.ASKED_PAGES + """, s AS (SELECT qid, page_id AS id, round(list_cosine_similarity(q.v, h.v), 9) AS similarity FROM vectors q JOIN heads h ON page_id <> qid),
n AS (SELECT * FROM s WHERE similarity >= 0.35 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) <= 6)
SELECT least(qid, id) AS a, greatest(qid, id) AS b, max(floor(similarity * 1000 + 0.5) / 1000) AS weight FROM n
WHERE NOT EXISTS (SELECT 1 FROM pair WHERE a = least(qid, id) AND b = greatest(qid, id)) GROUP BY ALL""")
def graph_similarity_edges(spark, d):
    asked = _asked_pages(spark, d)
    return graph.similarity_edges(_chunks(spark, d), _typed(spark, d), asked, cutoff=0.35)


def _similar(spark, d):
    ids = _pages(spark, d).select("id")
    return graph.similarity_edges(maintenance.prune(_chunks(spark, d), ids, "page_id"), _typed(spark, d), ids, cutoff=0.35)


@query(_TYPED + "," + S.CHUNKS + """, own AS (SELECT page_id, v FROM heads WHERE page_id IN (SELECT id FROM pages)),
s AS (SELECT q.page_id AS qid, h.page_id AS id, round(list_cosine_similarity(q.v, h.v), 9) AS similarity FROM own q JOIN own h ON q.page_id <> h.page_id),
n AS (SELECT * FROM s WHERE similarity >= 0.35 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) <= 6)
SELECT least(qid, id) AS a, greatest(qid, id) AS b, max(floor(similarity * 1000 + 0.5) / 1000) AS weight FROM n
WHERE NOT EXISTS (SELECT 1 FROM pair WHERE a = least(qid, id) AND b = greatest(qid, id)) GROUP BY ALL""")
def graph_similarity_edges_all(spark, d):
    return _similar(spark, d)


@query(_TYPED + " SELECT id, count(*) AS degree FROM (SELECT a AS id FROM pair UNION ALL SELECT b FROM pair) GROUP BY id")
def graph_degree(spark, d):
    return graph.degree(_typed(spark, d))


@query()
def graph_communities(spark, d):
    return graph.communities(_typed(spark, d), similar=_similar(spark, d), ids=_pages(spark, d))


@query(S.chain(S.LAST) + "SELECT count(*) AS pages, TRUE AS once, TRUE AS named, TRUE AS sized, TRUE AS placed, 0 AS mergers FROM pages")
def graph_community_invariants(spark, d):
    """What must hold of any result: each page once, communities named by their lowest page, right sizes and places, and
    no two communities whose merger would add modularity."""
    typed, similar = stage(_typed(spark, d)), stage(_similar(spark, d))
    found = stage(graph.communities(typed, similar=similar, ids=_pages(spark, d)))
    groups = found.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.min("size").alias("size"), F.max("size").alias("most"), F.min("place").alias("place"))
    larger = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = groups.groupBy("size").agg(F.count("*").alias("k")).select("size", F.coalesce(F.sum("k").over(larger), F.lit(0)).alias("ahead"))
    told = groups.join(F.broadcast(sizes), "size").agg(
        F.bool_and(F.col("community") == F.col("low")).alias("named"), F.bool_and((F.col("n") == F.col("size")) & (F.col("most") == F.col("size"))).alias("sized"), F.bool_and(F.col("place") == F.col("ahead")).alias("placed"))
    whole = found.agg(F.count("*").alias("pages"), (F.count_distinct("id") == F.count("*")).alias("once"))
    links = typed.filter("source != target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("weight").alias("w")).unionByName(similar.select("a", "b", F.col("weight").alias("w")))
    links = links.groupBy("a", "b").agg(F.max("w").alias("w")).filter("w > 0")
    name = lambda c: found.select(F.col("id").alias(c), F.col("community").alias(f"{c}c"))
    links = stage(links.join(name("a"), "a").join(name("b"), "b"))
    ends = stage(links.select(F.explode(F.array("ac", "bc")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("ends")))
    total = ends.agg(F.sum("ends")).first()[0] or 1.0
    between = links.filter("ac != bc").groupBy(F.least("ac", "bc").alias("ac"), F.greatest("ac", "bc").alias("bc")).agg(F.sum("w").alias("w"))
    between = between.join(ends.select(F.col("c").alias("ac"), F.col("ends").alias("x")), "ac").join(ends.select(F.col("c").alias("bc"), F.col("ends").alias("y")), "bc")
    better = between.agg(F.count_if(F.col("w") - F.col("x") * F.col("y") / total > 1e-6 * F.col("w")).cast("int").alias("mergers"))
    return whole.join(F.broadcast(told)).join(F.broadcast(better)).select("pages", "once", "named", "sized", "placed", "mergers")


def _set_hash(lines: str, last: str) -> str:
    part = lambda i: f"(coalesce(sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT::HUGEINT), 0) % 18446744073709551616)::VARCHAR"
    return f""", h AS (SELECT sha256(coalesce(line, '')) AS h FROM ({lines})),
b AS (SELECT concat_ws(',', {", ".join(map(part, range(4)))}) AS x, count(*) AS n FROM h) {last} FROM b"""


@query(S.chain(S.LAST) + _set_hash("SELECT concat_ws(',', id, content_hash) AS line FROM live", "SELECT md5(x) AS digest, n"))
def graph_fingerprint(spark, d):
    nodes = table(spark, d, "nodes")
    live = pages.current_pages(nodes).select("id").join(_last_rows(nodes), "id")
    return graph.set_hash(live.select(F.concat_ws(",", "id", "content_hash").alias("line")), "md5")


def _last_rows(nodes):
    last = nodes.groupBy("id").agg(F.max(F.struct("indexed_at", "row_no")).getField("row_no").alias("row_no"))
    return nodes.join(last.select("row_no"), "row_no", "left_semi").select("id", "content_hash", "row_no", F.col("removed_at").isNull().alias("live"))


@query(S.chain(S.LAST) + _set_hash(r"""SELECT to_json([nfc_normalize(regexp_replace(replace(coalesce(path, id || '.md'), '\', '/'), '^\./', '')), content_hash, trust, source, floor(authored * 1000000)::BIGINT::VARCHAR])::VARCHAR AS line FROM live""",
"SELECT 'v1:' || sha256(concat_ws(chr(10), sha256(x), 'all', 'headers-links/2', 'hashed-words:64:trunc=2000:chunk1800o200', '3')) AS generation"))
def generation_hash(spark, d):
    nodes = table(spark, d, "nodes")
    rows = pages.current_pages(nodes).join(_last_rows(nodes).select("id", "content_hash"), "id")
    return spark.range(1).select(F.lit(index.generation(rows, hashed_words().signature())).alias("generation"))


# Ingest and maintenance.


# The headers of the documents hold one-line titles and inline tags; the SQL cuts lines and knows which plain titles
# YAML takes for something else.
_HEADED = r"""
texts AS (SELECT path, replace(regexp_replace(text, '^\x{feff}', ''), chr(13) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL AND path IS NOT NULL),
lined AS (SELECT *, string_split(t, chr(10)) AS l FROM texts),
fenced AS (SELECT *, CASE WHEN l[1] = '---' THEN list_position(l[2:], '---') END AS f FROM lined),
heads AS (SELECT *, list_filter(l[2:f], lambda x: trim(x) <> '') AS h FROM fenced),
plain AS (SELECT *, f IS NOT NULL AND len(list_filter(h, lambda x: NOT regexp_matches(x, '^[a-z_]+: ?') OR regexp_matches(x, '^[a-z_]+: .*(: |:$)') OR regexp_matches(x, '^[a-z_]+: *[@`%&*!|>{}\],?"'']'))) = 0
  AND len(list_distinct(list_transform(h, lambda x: split_part(x, ':', 1)))) = len(h) AS fine FROM heads),
headed AS (SELECT *, CASE WHEN fine THEN array_to_string(l[f + 2:], chr(10)) ELSE t END AS body,
  CASE WHEN fine THEN nullif(trim(regexp_replace(list_filter(h, lambda x: starts_with(x, 'title:'))[1][7:], ' #.*$', '')), '') END AS title,
  CASE WHEN fine THEN string_split(nullif(trim(list_filter(h, lambda x: starts_with(x, 'tags:'))[1][6:], ' []'), ''), ', ') END AS tags,
  regexp_replace(path, '\.md$', '') AS id FROM plain)"""


@query(S.chain(_HEADED) + f"""SELECT path, id, coalesce(title, string_split(id, '/')[-1]) AS title, length(body) AS body_length, md5(body) AS body_digest, coalesce(array_to_string(tags, ';'), '') AS tags,
CASE WHEN {S.ZONE} = 'incoming' THEN 'untrusted' ELSE 'trusted' END AS trust, FALSE AS volatile, FALSE AS tombstoned, NULL::DOUBLE AS freshness FROM headed""")
def markdown_items(spark, d):
    out = markdown.items(table(spark, d, "documents").select("path", "text"))
    return out.select("path", "id", "title", F.length("body").cast("long").alias("body_length"), F.md5("body").alias("body_digest"), F.array_join("tags", ";").alias("tags"), "trust", "volatile", "tombstoned", "freshness")


@query(r"""WITH given AS (SELECT item_seq AS id, 0 AS part, i, e.type AS type, e.target AS target, e.weight AS weight FROM (SELECT item_seq, unnest(edges) AS e, generate_subscripts(edges, 1) AS i FROM memory_items) WHERE e.target <> ''),
linked AS (SELECT item_seq AS id, 1, unnest(range(len(f))) AS i, 'related-to', unnest(f) AS raw, NULL FROM (SELECT item_seq, regexp_extract_all(body, '\[\[([^\]|#\n]+)[^\[\]\n]*\]\]', 1) AS f FROM memory_items)),
every AS (SELECT * FROM given UNION ALL SELECT id, 1, i, 'related-to', CASE WHEN ends_with(trim(raw), '.md') THEN trim(raw)[:-4] ELSE trim(raw) END, NULL FROM linked)
SELECT id, type, target, weight FROM every WHERE target <> '' QUALIFY row_number() OVER (PARTITION BY id, replace(lower(trim(type)), '_', '-'), target ORDER BY part, i) = 1""")
def front_matter_edges(spark, d):
    rows = table(spark, d, "memory_items").select(F.col("item_seq").alias("id"), "body", F.filter(F.transform("edges", lambda e: e), lambda e: e.target != "").alias("edges"))
    return markdown.link_edges(rows).select("id", "type", "target", "weight")


@query(S.chain(S.LAST) + r"""SELECT DISTINCT id, 'related-to' AS type, target FROM (SELECT id, regexp_replace(trim(unnest(regexp_extract_all(body, '\[\[([^\]|#\n]+?)(?:[#|][^\]\n]*)?\]\]', 1))), '\.md$', '') AS target FROM pages) WHERE target <> ''""")
def wikilink_edges(spark, d):
    return markdown.link_edges(_pages(spark, d).select("id", "body")).select("id", "type", "target")


@query(S.chain(S.LAST) + "SELECT string_split(id, '/')[-1] AS name, CASE WHEN count(*) = 1 THEN min(id) END AS page FROM pages GROUP BY 1")
def basename_map(spark, d):
    return markdown.basename_map(_pages(spark, d))


@query(S.chain(S.LAST, S.EDGES) + """, names AS (SELECT string_split(id, '/')[-1] AS name, CASE WHEN count(*) = 1 THEN min(id) END AS page FROM pages GROUP BY 1),
al AS (SELECT alias, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS entity FROM (SELECT id, unnest(aliases) AS alias FROM entities) WHERE alias IS NOT NULL AND NOT contains(alias, '/') GROUP BY 1)
SELECT source, type, target, CASE WHEN contains(target, '/') THEN target WHEN name IS NOT NULL THEN coalesce(page, target) ELSE coalesce(entity, target) END AS resolved
FROM links LEFT JOIN names ON name = target LEFT JOIN al ON alias = target""")
def resolve_edge_targets(spark, d):
    out = markdown.resolve_targets(_edges(spark, d), markdown.basename_map(_pages(spark, d)), markdown.alias_map(table(spark, d, "entities")))
    return out.select("source", "type", "target", "resolved")


def _window(start: str) -> str:
    piece = f"length(regexp_replace(substr(t, {start} + 1, 1800), '[^ \\n\\t]*$', '')) - 1"
    return f"CASE WHEN {start} + 1800 >= length(t) THEN length(t) WHEN {piece} > 900 THEN {start} + {piece} ELSE {start} + 1800 END"


_NEXT = r"""CASE WHEN hi > 200 AND NOT regexp_matches(substr(t, hi - 200, 1), '[\s\p{Z}\x{85}]') AND length(regexp_extract(substr(t, hi - 199, 200), '^[^\s\p{Z}\x{85}]*')) < 200
  THEN hi - 200 + length(regexp_extract(substr(t, hi - 199, 200), '^[^\s\p{Z}\x{85}]*')) + 1 ELSE hi - 200 END"""


@query(S.chain(S.LAST, f"""
texts AS (SELECT id, coalesce(title, '') || chr(10) || coalesce(body, '') AS t FROM pages),
w AS (SELECT id, t, 0 AS ord, 0::BIGINT AS lo, ({_window("0")})::BIGINT AS hi FROM texts
  UNION ALL SELECT id, t, ord + 1, nxt, ({_window("nxt")})::BIGINT FROM (SELECT *, ({_NEXT})::BIGINT AS nxt FROM w WHERE hi < length(t)))""", recursive=True) + "SELECT id, ord::INT AS ord, lo::INT AS lo, hi::INT AS hi FROM w")
def chunk_text(spark, d):
    return chunking.chunk_pages(_pages(spark, d), with_text=False)


_HASH = "substr(sha256(coalesce(title, '') || chr(0) || coalesce(body, '') || chr(0) || {e}), 1, 16)"
_NUM = "CASE WHEN e.weight = floor(e.weight) THEN floor(e.weight)::BIGINT::VARCHAR ELSE e.weight::VARCHAR END"
_JSON = "'[' || array_to_string(list_transform(coalesce(edges, []), lambda e: '{\"type\":' || to_json(coalesce(e.type, ''))::VARCHAR || ',\"target\":' || to_json(coalesce(e.target, ''))::VARCHAR || coalesce(',\"weight\":' || " + _NUM + ", '') || '}'), ',') || ']'"


@query(f"SELECT item_seq, {_HASH.format(e=_JSON)} AS content_hash FROM memory_items")
def hash_item(spark, d):
    h = maintenance.content_hash(F.col("title"), F.col("body"), maintenance.edges_json(F.col("edges")))
    return table(spark, d, "memory_items").select("item_seq", h.alias("content_hash"))


@query("""SELECT item_seq, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'item') AS slug,
'out_memory/' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'item') || '-' || substr(sha256(title || chr(10) || body), 1, 6) AS memory_id
FROM memory_items WHERE title IS NOT NULL""")
def memory_id(spark, d):
    items = table(spark, d, "memory_items").filter("title is not null")
    return items.select("item_seq", T.slug(F.col("title")).alias("slug"), T.memory_id(F.col("title"), F.col("body")).alias("memory_id"))


@query(r"""SELECT doc_id, md5(s) AS digest, length(s) AS n FROM (SELECT doc_id, (regexp_replace(regexp_replace(regexp_replace(text,
'\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07]*(\x07|\x1b\\)|\x1b', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\r\n?', chr(10), 'g')) AS s FROM documents)""")
def sanitize_text(spark, d):
    s = T.sanitize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(s).alias("digest"), F.length(s).cast("long").alias("n"))


@query(f"SELECT type, {S.RELATION.format(c='type')} AS normal, {_FAMILY.replace('type IN', S.RELATION.format(c='type') + ' IN')} AS family, count(*) AS n FROM edges GROUP BY ALL")
def normalize_relation(spark, d):
    kind = T.relation(F.col("type"))
    return table(spark, d, "edges").groupBy("type", kind.alias("normal"), R.family(kind).alias("family")).agg(F.count("*").alias("n"))


@query(S.chain(S.LAST) + r"""SELECT id, coalesce(nullif(title, ''), id)[1:48] AS label, trim(regexp_replace(body, '[\s\x0b]+', ' ', 'g'))[1:240] AS preview FROM pages""")
def page_previews(spark, d):
    return _pages(spark, d).select("id", T.label(F.col("title"), F.col("id")).alias("label"), T.preview(F.col("body")).alias("preview"))


_SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'item')"


@query(f"""WITH n AS (SELECT DISTINCT title, body, sha256(coalesce(title, '') || chr(10) || coalesce(body, '')) AS h FROM memory_items),
w AS (SELECT h, w, 'out_memory/' || {_SLUG.format(c="coalesce(title, '')")} || '-' || substr(h, 1, w) AS id FROM n, (SELECT unnest([6, 10, 14, 18, 22, 26, 30, 34, 38, 42, 46, 50, 54, 58, 62, 64]) AS w)),
taken AS (SELECT id, sha256(coalesce(title, '') || chr(10) || coalesce(body, '')) AS t FROM nodes),
free AS (SELECT h, w, id FROM w WHERE NOT EXISTS (SELECT 1 FROM taken WHERE taken.id = w.id AND t <> h) QUALIFY h = min(h) OVER (PARTITION BY id)),
best AS (SELECT h, arg_min(id, w) AS id FROM free GROUP BY h)
SELECT md5(h) AS content, id FROM best""")
def memory_ids(spark, d):
    """Ids of all items as if they were new, beside those of the pages, longer where two contents share one."""
    out = T.memory_ids(table(spark, d, "memory_items"), table(spark, d, "nodes"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(F.md5(F.sha2(F.concat(text("title"), F.lit("\n"), text("body")), 256)).alias("content"), "id")


@query(S.chain(S.LAST) + f"SELECT {S.ZONE} AS zone, coalesce(trust, 'untrusted') AS trust, count(*) AS n FROM pages GROUP BY ALL")
def zone_counts(spark, d):
    return _pages(spark, d).groupBy(R.zone(F.col("path")).alias("zone"), F.coalesce("trust", F.lit("untrusted")).alias("trust")).agg(F.count("*").alias("n"))


@query(S.chain(S.LAST) + r"""SELECT id FROM pages WHERE NOT (regexp_matches(path, '^in_mail/.*$') OR regexp_matches(path, '^logs/[^/]*\.md$'))
AND len(list_intersect(string_split(path, '/'), ['node_modules', 'dist', 'build', 'vendor', 'target'])) = 0""")
def scope_exclude(spark, d):
    return _pages(spark, d).filter(~markdown.out_of_scope(F.col("path"), ("in_mail/**", "logs/*.md"))).select("id")


_ITEMS = "items AS (SELECT * FROM memory_items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, item_seq DESC) = 1)"
_BARE = _HASH.format(e="'[]'")


def _incoming(spark, d):
    return maintenance.latest_items(table(spark, d, "memory_items"))


def _bare(df):
    return df.withColumn("content_hash", maintenance.content_hash(F.col("title"), F.col("body"), F.lit("[]")))


@query(S.chain(S.LAST, _ITEMS) + f""", a AS (SELECT id, {_BARE} AS h FROM items), b AS (SELECT id, {_BARE} AS h FROM live)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'absent' WHEN b.id IS NULL THEN 'new' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.id = b.id""")
def upsert_diff(spark, d):
    return maintenance.classify(_bare(_incoming(spark, d)), _bare(pages.current_pages(table(spark, d, "nodes"))))


def _hashed(df, edges):
    """With the hash of title, body and the distinct edges in order; ends and types as they are meant, on both sides alike."""
    lists = pages.current_edges(edges).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("type", "target", "weight"))).alias("list"))
    keyed = df.select("id", "title", "body", orphans.composed(orphans.reference_key(F.col("id"))).alias("source"))
    return keyed.join(lists, "source", "left").select("id", maintenance.content_hash(F.col("title"), F.col("body"), maintenance.edges_json(F.col("list"))).alias("content_hash"))


_LISTED = f"""
given AS (SELECT id, {S.KEY.format(c="id")} AS source, unnest(edges) AS e, generate_subscripts(edges, 1) AS i FROM items),
typed AS (SELECT source, {S.RELATION.format(c="coalesce(e.type, 'related_to')")} AS type, {S.KEY.format(c="e.target")} AS target, coalesce(e.weight, 1.0) AS weight, i FROM given),
once AS (SELECT source, type, target, arg_min(weight, i) AS weight FROM typed WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL),
lists AS (SELECT source, list({{'type': type, 'target': target, 'weight': weight}} ORDER BY type, target, weight) AS edges FROM once GROUP BY 1),
kept AS (SELECT source, list({{'type': type, 'target': target, 'weight': weight}} ORDER BY type, target, weight) AS edges FROM links GROUP BY 1),
a AS (SELECT id, {_HASH.format(e=_JSON)} AS h FROM (SELECT id, title, body, lists.edges FROM items LEFT JOIN lists ON lists.source = {S.KEY.format(c="id")})),
b AS (SELECT id, {_HASH.format(e=_JSON)} AS h FROM (SELECT id, title, body, kept.edges FROM live LEFT JOIN kept ON kept.source = {S.KEY.format(c="id")}))"""


@query(S.chain(S.LAST, _ITEMS, S.EDGES, _LISTED) + "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'absent' WHEN b.id IS NULL THEN 'new' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.id = b.id")
def upsert_diff_edges(spark, d):
    items = _incoming(spark, d)
    given = items.select("id", F.posexplode("edges").alias("edge_id", "e")).select("edge_id", F.col("id").alias("source"), "e.type", "e.target", "e.weight")
    return maintenance.classify(_hashed(items, given), _hashed(pages.current_pages(table(spark, d, "nodes")), table(spark, d, "edges")))


def _timed(spark, d):
    """The latest items as they are stored: defaults filled in, written times in seconds."""
    items = _incoming(spark, d)
    t = times.normalise_times(items, table(spark, d, "actors"))
    at = lambda f: (F.max(F.when(F.col("field") == f, F.col("utc_us"))) / 1e6).alias(f)
    found = t.groupBy("item_seq").agg(at("authored"), at("freshness"))
    return items.drop("authored", "freshness").join(found, "item_seq", "left").withColumns({"trust": F.coalesce("trust", F.lit("untrusted")), "volatile": F.coalesce("volatile", F.lit(False))})


_TIMED = """
timed AS (SELECT i.id, i.title, i.body, i.edges, coalesce(i.trust, 'untrusted') AS trust, coalesce(i.volatile, FALSE) AS volatile, f.utc_us / 1e6 AS freshness, i.description, i.resource, i.source, w.utc_us / 1e6 AS authored, i.write_actor
  FROM items i LEFT JOIN instants f ON f.item_seq = i.item_seq AND f.field = 'freshness' LEFT JOIN instants w ON w.item_seq = i.item_seq AND w.field = 'authored')"""


@query(S.chain(S.LAST, _ITEMS, S.WRITTEN, _TIMED) + """, x AS (SELECT a.id, concat_ws(',', CASE WHEN a.trust IS DISTINCT FROM b.trust THEN 'trust' END, CASE WHEN a.volatile IS DISTINCT FROM b.volatile THEN 'volatile' END,
CASE WHEN a.freshness IS DISTINCT FROM b.freshness THEN 'freshness' END, CASE WHEN a.description IS DISTINCT FROM b.description THEN 'description' END, CASE WHEN a.resource IS DISTINCT FROM b.resource THEN 'resource' END,
CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END, CASE WHEN a.authored IS DISTINCT FROM b.authored THEN 'authored' END,
CASE WHEN coalesce(nullif(a.write_actor, 'unknown'), b.write_actor) IS DISTINCT FROM b.write_actor THEN 'write_actor' END) AS fields, coalesce(nullif(a.write_actor, 'unknown'), b.write_actor) AS write_actor FROM timed a JOIN live b ON a.id = b.id) SELECT * FROM x WHERE fields <> ''""")
def metadata_sync(spark, d):
    return maintenance.metadata_changes(_timed(spark, d), pages.current_pages(table(spark, d, "nodes")))


_RAW = "list_filter(coalesce(edges, []), lambda e: coalesce(e.target, '') <> '')"


@query(S.chain(S.LAST, _ITEMS, S.EDGES, S.WRITTEN, _TIMED) + f""",
kept AS (SELECT source, list({{'type': type, 'target': target, 'weight': weight}} ORDER BY type, target, weight) AS edges FROM links GROUP BY 1),
a AS (SELECT *, {_HASH.format(e=_JSON.replace("coalesce(edges, [])", _RAW))} AS h FROM timed),
b AS (SELECT *, {_HASH.format(e=_JSON)} AS h FROM (SELECT live.* EXCLUDE (content_hash), kept.edges FROM live LEFT JOIN kept ON kept.source = live.id)),
s AS (SELECT CASE WHEN a.id IS NULL THEN 'absent' WHEN b.id IS NULL OR a.h <> b.h THEN 'indexed' WHEN (a.trust, a.volatile, a.freshness, a.description, a.resource, a.source, a.authored) IS DISTINCT FROM
  (coalesce(b.trust, 'untrusted'), coalesce(b.volatile, FALSE), b.freshness, b.description, b.resource, b.source, b.authored) OR coalesce(nullif(a.write_actor, 'unknown'), coalesce(b.write_actor, 'unknown')) <> coalesce(b.write_actor, 'unknown') THEN 'synced' ELSE 'same' END AS s FROM a FULL JOIN b ON a.id = b.id),
t AS (SELECT (SELECT count(*) FROM live) AS p, (SELECT count(*) FROM items) AS n)
SELECT 1 AS run, p AS files, p AS indexed, 0 AS skipped, 0 AS pruned, 0 AS synced FROM t
UNION ALL SELECT 2, any_value(n), count_if(s = 'indexed'), count_if(s IN ('synced', 'same')), count_if(s = 'absent'), count_if(s = 'synced') FROM s, t
UNION ALL SELECT 3, n, 0, n, 0, 0 FROM t""")
def reindex_counts(spark, d):
    """Three runs over one index: the pages, then the items, which prune what they lack, then the items again."""
    root, columns = scratch(spark, "reindex"), [*index.NODE[:6], *index.NODE[8:]]
    old = pages.current_pages(table(spark, d, "nodes")).select(*columns)
    lists = pages.current_edges(table(spark, d, "edges")).groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct("type", "target", "weight"))).alias("edges"))
    old, new = stage_table(old.join(lists, "id", "left")), stage_table(_timed(spark, d).select(*columns, "edges"))
    counts = [index.reindex(spark, root, rows, hashed_words()) for rows in (old, new, new)]
    names = ("files", "indexed", "skipped", "pruned", "synced")
    return spark.createDataFrame([(i, *(c[n] for n in names)) for i, c in enumerate(counts, 1)], "run int, " + ", ".join(f"{n} long" for n in names))


@query("""SELECT item_seq, lead(item_seq) OVER (PARTITION BY id ORDER BY received_at NULLS FIRST, item_seq) AS superseded_by,
last_value(item_seq) OVER (PARTITION BY id ORDER BY received_at NULLS FIRST, item_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS successor FROM memory_items WHERE id IS NOT NULL""")
def supersede_chain(spark, d):
    """Each delivery of a page is superseded by the next one; ``successor`` is the end of the chain."""
    rows = table(spark, d, "memory_items").filter("id is not null")
    w = Window.partitionBy("id").orderBy(F.col("received_at").asc_nulls_first(), "item_seq")
    pairs = rows.select(F.col("item_seq").alias("old"), F.lead("item_seq").over(w).alias("new")).filter("new is not null")
    items = rows.select(F.col("item_seq").alias("id"), F.col("id").alias("page"), F.lit(None).cast("long").alias("superseded_by"), F.lit(None).cast("boolean").alias("forgotten"))
    done = lifecycle.supersede(items, pairs)
    ends = done.filter(~lifecycle.tombstoned()).select("page", F.col("id").alias("successor"))
    return done.join(ends, "page").select(F.col("id").alias("item_seq"), "superseded_by", "successor")


@query("SELECT item_seq FROM (SELECT *, lead(item_seq) OVER (PARTITION BY id ORDER BY received_at NULLS FIRST, item_seq) AS n FROM memory_items WHERE id IS NOT NULL) WHERE n IS NULL")
def tombstone_filter(spark, d):
    return supersede_chain(spark, d).withColumn("forgotten", F.lit(False)).filter(~lifecycle.tombstoned()).select("item_seq")


@query(S.chain(S.LAST, _ITEMS) + "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN a.title ELSE b.title END AS title, coalesce(nullif(a.write_actor, 'unknown'), b.write_actor, a.write_actor) AS write_actor FROM items a FULL JOIN live b ON a.id = b.id")
def upsert_result(spark, d):
    cols = ["id", "title", "body", "trust", "write_actor"]
    old = pages.current_pages(table(spark, d, "nodes")).select(*cols)
    return maintenance.upsert(old, _incoming(spark, d).select(*cols)).select("id", "title", "write_actor")


@query(S.chain(S.LAST) + "SELECT c.chunk_id FROM chunks c WHERE page_id IN (SELECT id FROM pages)")
def prune_anti(spark, d):
    return maintenance.prune(table(spark, d, "chunks"), _pages(spark, d), "page_id").select("chunk_id")


@query(S.chain(S.LAST) + "SELECT edge_id FROM edges WHERE source IS NULL OR source NOT IN (SELECT id FROM last WHERE removed_at IS NOT NULL)")
def remove_ids(spark, d):
    gone = _last_rows(table(spark, d, "nodes")).filter("not live").select("id")
    return maintenance.remove_ids(table(spark, d, "edges"), gone, "source").select("edge_id")


@query("SELECT edge_id FROM edges QUALIFY row_number() OVER (PARTITION BY source, type, target ORDER BY edge_id) = 1")
def edge_dedup(spark, d):
    return maintenance.distinct_edges(table(spark, d, "edges")).select("edge_id")


def _stats(spark, d):
    return maintenance.recall_stats(table(spark, d, "events").withColumnRenamed("user_id", "memory"))


@query("SELECT user_id AS memory, count(*) AS hits, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def recall_stats(spark, d):
    return _stats(spark, d).select("memory", "hits", F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


@query(S.chain(S.LAST) + """SELECT id, title, hits FROM (SELECT user_id AS memory, count(*) AS hits, max(ts) AS last FROM events GROUP BY 1) s JOIN live ON row_no = memory
WHERE trust = 'trusted' ORDER BY hits DESC, last DESC NULLS LAST, id LIMIT 20""")
def hotlist(spark, d):
    nodes = table(spark, d, "nodes")
    live = pages.current_pages(nodes).join(_last_rows(nodes).select("id", "row_no"), "id")
    return maintenance.hotlist(_stats(spark, d), live).select("id", "title", "hits")


@query(S.chain(S.LAST, S.EDGES, S.CHUNKS) + "SELECT (SELECT count(*) FROM pages) AS nodes, (SELECT count(*) FROM links) AS edges, (SELECT count(*) FROM parts) AS chunks")
def index_stats(spark, d):
    one = [df.agg(F.count("*").alias(n)) for n, df in (("nodes", _pages(spark, d)), ("edges", _edges(spark, d)), ("chunks", _chunks(spark, d)))]
    rows = one[0].select(F.lit("nodes").alias("k"), F.col("nodes").alias("n"))
    for name, df in (("edges", one[1]), ("chunks", one[2])):
        rows = rows.unionByName(df.select(F.lit(name).alias("k"), F.col(name).alias("n")))
    return rows.groupBy().pivot("k", ["nodes", "edges", "chunks"]).agg(F.max("n"))


@query(S.chain(S.LAST) + r"""SELECT DISTINCT kind, name, path, CASE WHEN kind = 'folder' THEN CASE WHEN name = 'raw' OR starts_with(name, 'in_') THEN 'incoming' WHEN name = 'out' OR starts_with(name, 'out_') THEN 'output' ELSE 'wiki' END END AS zone
FROM (SELECT CASE WHEN contains(path, '/') THEN 'folder' ELSE 'page' END AS kind, split_part(path, '/', 1) AS name, split_part(path, '/', 1) AS path FROM pages WHERE NOT regexp_matches(path, '(^|/)\.')) WHERE kind = 'folder' OR ends_with(name, '.md')""")
def tree_level(spark, d):
    return markdown.tree(_pages(spark, d))


@query(S.chain(S.LAST) + "SELECT m.item_seq, p.id, p.title FROM memory_items m JOIN pages p ON p.id = m.id OR p.path = m.path")
def indexed_page(spark, d):
    asked = table(spark, d, "memory_items").select("item_seq", F.explode(F.array_distinct(F.array_compact(F.array("id", F.regexp_replace("path", r"\.md$", ""))))).alias("id")).distinct()
    return asked.join(_pages(spark, d).select("id", "title"), "id").select("item_seq", "id", "title").distinct()
