"""Named queries of the operators for language-model data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmere.llm import encodings, leaks, near_duplicates, neighbours, packing, splitting
from graphmere.session import scratch, stage, table

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


@query("""
WITH last AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, row_no DESC) = 1)
SELECT id FROM last WHERE length(coalesce(title, '') || chr(10) || coalesce(body, '')) > 1800
""")
def p3_found(spark, d):
    return splitting.split_pages(table(spark, d, "nodes")).filter("ord = 0").select("id")


@query()
def p3_pieces(spark, d):
    return splitting.split_pages(table(spark, d, "nodes"))


# Pre-tokens by arithmetic, as the SQL's patterns have no look-ahead: of a run of blanks before a word the last one, if it is a
# plain blank, belongs to the word and the rest is a token; any other run before a word is a token, and its last blank another.
_TOKENS = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), $$'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}+|[^\s\p{L}\p{N}\x{85}\x{0b}\x{1c}-\x{1f}\p{Z}]+|[\s\x{85}\x{0b}\x{1c}-\x{1f}\p{Z}]+$$) AS x FROM documents),
p AS (SELECT doc_id, len(x) AS n, len(list_filter(list_transform(range(1, len(x)), lambda i: CASE WHEN regexp_matches(x[i], $$^[\s\x{85}\x{0b}\x{1c}-\x{1f}\p{Z}]+$$) THEN CASE WHEN x[i] = ' ' THEN -1 WHEN ends_with(x[i], ' ') THEN 0 WHEN length(x[i]) = 1 THEN 0 ELSE 1 END END), lambda v: v = -1)) AS fewer,
len(list_filter(list_transform(range(1, len(x)), lambda i: CASE WHEN regexp_matches(x[i], $$^[\s\x{85}\x{0b}\x{1c}-\x{1f}\p{Z}]+$$) AND NOT ends_with(x[i], ' ') AND length(x[i]) > 1 THEN 1 END), lambda v: v = 1)) AS more FROM t),
c AS (SELECT doc_id, n - fewer + more AS tokens FROM p)
"""


@query(_TOKENS + "SELECT doc_id FROM c WHERE tokens > 1024")
def p6_found(spark, d):
    return packing.pack_documents(table(spark, d, "documents")).filter("piece = 1").select("doc_id")


@query()
def p6_containers(spark, d):
    out = packing.pack_documents(table(spark, d, "documents"))
    return out.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))


@query(_TOKENS + "SELECT count(*) AS documents, sum(tokens)::BIGINT AS tokens, sum(greatest((tokens + 1023) // 1024, 1))::BIGINT AS pieces, 0 AS overfull, 0 AS overlapping, TRUE AS tight FROM c")
def p6_invariants(spark, d):
    """What must hold of any packing: every token is placed once, no container is overfull, places don't overlap, and
    the containers are few: at most the least number there can be and a hundredth more, or one."""
    placed = stage(packing.pack_documents(table(spark, d, "documents")))
    w = Window.partitionBy("container").orderBy("place")
    rows = placed.filter("tokens > 0").withColumn("end", F.coalesce(F.lag(F.col("place") + F.col("tokens")).over(w), F.lit(0)))
    sums = rows.agg(F.count_if(F.col("place") + F.col("tokens") > 1024).alias("overfull"), F.count_if(F.col("place") < F.col("end")).alias("overlapping"), F.count_distinct("container").alias("used"), F.sum("tokens").alias("t"))
    whole = placed.agg(F.count_distinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    least = F.ceil(F.coalesce(F.col("t"), F.lit(0)) / 1024)
    tight = F.col("used") <= F.greatest(least * 1.01, least + 1)
    return whole.join(F.broadcast(sums)).select("documents", "tokens", "pieces", F.col("overfull").cast("int").alias("overfull"), F.col("overlapping").cast("int").alias("overlapping"), tight.alias("tight"))


@query("""
WITH last AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, row_no DESC) = 1),
t AS (SELECT id, coalesce(title, '') || chr(10) || coalesce(body, '') AS t FROM last)
SELECT id, md5(t) AS digest, length(t) AS covered, TRUE AS whole FROM t WHERE length(t) > 1800
""")
def p3_invariants(spark, d):
    """Each page put together again from its pieces without what they share, and whether the pieces keep to the limits."""
    pieces = splitting.split_pages(table(spark, d, "nodes"))
    own = F.substring("text", F.col("shared") + 1, F.lit(1 << 30))
    parts = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", own.alias("t")))).alias("l"), F.max(F.length("text")).alias("longest"), F.max("shared").alias("shared"), F.max("ord").alias("ord"), F.count("*").alias("n"))
    text = F.concat_ws("", F.transform("l", lambda x: x.t))
    fine = (F.col("longest") <= 1800) & (F.col("shared") <= 200) & (F.col("ord") + 1 == F.col("n"))
    return parts.select("id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("covered"), fine.alias("whole"))


_WORDS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""
WITH i AS (SELECT item_id, {_WORDS.format(c="text")} AS w FROM eval_items),
g AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s, w FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM g),
d AS (SELECT doc_id, {_WORDS.format(c="text")} AS w FROM documents),
h AS (SELECT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (
      SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM h JOIN k USING (n, gram)
""")
def p7_found(spark, d):
    return _phrases(spark, d).select("doc_id", "item_id")


_POSTINGS: dict[tuple[str, str], str] = {}


def stored_postings(spark, d):
    """The index of the documents, written by the first query of a session that needs it and then read."""
    key = (spark.sparkContext.applicationId, d)
    if key in _POSTINGS:
        return spark.read.schema("word string, doc long, pos int").parquet(_POSTINGS[key])
    path = scratch(spark, "postings")
    out = leaks.write_index(table(spark, d, "documents"), path)
    _POSTINGS[key] = path
    return out


def _phrases(spark, d):
    out = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), stored_postings(spark, d))
    return out.filter("kind = 'phrase'")


@query(SQL["p7_found"].replace("SELECT DISTINCT doc_id, item_id FROM h JOIN k USING (n, gram)", """, hit AS (SELECT DISTINCT doc_id, item_id FROM h JOIN k USING (n, gram)),
dp AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d WHERE doc_id IN (SELECT doc_id FROM hit)),
ip AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM i),
same AS (SELECT hit.doc_id, hit.item_id, dp.pos - ip.pos AS o, ip.pos AS p FROM hit JOIN dp USING (doc_id) JOIN ip ON ip.item_id = hit.item_id AND ip.word = dp.word),
runs AS (SELECT doc_id, item_id, o, p - row_number() OVER (PARTITION BY doc_id, item_id, o ORDER BY p) AS g FROM same),
longest AS (SELECT doc_id, item_id, max(n) AS n FROM (SELECT doc_id, item_id, o, g, count(*) AS n FROM runs GROUP BY ALL) GROUP BY ALL)
SELECT item_id, count(*) AS documents, max(n) AS words FROM longest GROUP BY 1"""))
def p7_items(spark, d):
    return _phrases(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").cast("long").alias("words"))


@query()
def p7_proximity(spark, d):
    """Documents with the rarest terms of an item near each other, up to three words more or fewer between, but no phrase."""
    out = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), stored_postings(spark, d), slack=3)
    return out.filter("kind = 'proximity'").select("doc_id", "item_id", "words")


@query()
def p8_found(spark, d):
    return encodings.find_garbled(table(spark, d, "documents")).select("doc_id")


@query()
def p8_restored(spark, d):
    out = encodings.restore_garbled(table(spark, d, "documents"))
    return out.select("doc_id", "restored", (F.col("text") != F.col("restored")).alias("changed"))


_VECTORS = """
WITH first AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY page_id, ord ORDER BY chunk_id) = 1),
v AS (SELECT chunk_id, embedding::DOUBLE[] AS e FROM first WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.chunk_id AS id, b.chunk_id AS other, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
k AS (SELECT id, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS r FROM s WHERE similarity >= 0.92) WHERE r <= 10)
"""


@query(_VECTORS + "SELECT DISTINCT least(id, other) AS chunk_a, greatest(id, other) AS chunk_b FROM k")
def p2_found(spark, d):
    out = neighbours.most_similar(table(spark, d, "chunks"))
    return out.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()


@query(_VECTORS.replace("SELECT id, other FROM (SELECT *,", "SELECT id, other, similarity, r FROM (SELECT *,").replace("ORDER BY similarity DESC, other)", "ORDER BY round(similarity, 12) DESC, other)")
+ "SELECT id AS chunk_id, other AS neighbour, round(similarity, 6) AS similarity, r::INT AS rank FROM k")
def p2_neighbours(spark, d):
    out = neighbours.most_similar(table(spark, d, "chunks"))
    return out.select("chunk_id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


_SHINGLES = f"""
WITH w AS (SELECT item_seq, {_WORDS.format(c="coalesce(title, '') || chr(10) || coalesce(body, '')")} AS w FROM memory_items),
g AS (SELECT DISTINCT item_seq, array_to_string(w[s:s + 2], ' ') AS gram FROM (SELECT item_seq, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) >= 20)),
n AS (SELECT item_seq, count(*) AS n FROM g GROUP BY item_seq),
b AS (SELECT a.item_seq AS item_a, b.item_seq AS item_b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.item_seq < b.item_seq GROUP BY ALL)
SELECT item_a, item_b FROM b JOIN n x ON x.item_seq = item_a JOIN n y ON y.item_seq = item_b WHERE c >= 0.6 * (x.n + y.n - c)
"""


@query(_SHINGLES)
def p5_found(spark, d):
    return near_duplicates.duplicate_pairs(*near_duplicates.near_duplicates(table(spark, d, "memory_items")))


@query(_SHINGLES.replace("SELECT item_a, item_b FROM b JOIN", """, sets AS (SELECT item_seq, list(gram ORDER BY gram) AS grams FROM g GROUP BY 1),
member AS (SELECT item_seq AS item, min(item_seq) OVER (PARTITION BY grams) AS rep FROM sets),
link AS (SELECT item_a, item_b FROM b JOIN""") + """), linked AS (SELECT x.rep, count(*) AS links FROM link JOIN member x ON x.item = item_a JOIN member y ON y.item = item_b WHERE x.rep = item_a AND y.rep = item_b AND x.rep <> y.rep GROUP BY 1
UNION ALL SELECT y.rep, count(*) FROM link JOIN member x ON x.item = item_a JOIN member y ON y.item = item_b WHERE x.rep = item_a AND y.rep = item_b AND x.rep <> y.rep GROUP BY 1),
total AS (SELECT rep, sum(links)::BIGINT AS links FROM linked GROUP BY 1)
SELECT item, member.rep, coalesce(links, 0) AS links FROM member LEFT JOIN total USING (rep)""")
def p5_classes(spark, d):
    links, members = near_duplicates.near_duplicates(table(spark, d, "memory_items"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select("item", "rep", F.coalesce("links", F.lit(0)).alias("links"))
