"""The three ranked arms of retrieval for a batch of queries, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmere.functions import text as T
from graphmere.operators.joins import spread_join
from graphmere.session import sized, stage

# BM25 and its field weights, fusion constants, limits of the graph walk.
K1, B = 1.2, 0.75
FIELDS = {"title": 10.0, "description": 3.0, "body": 1.0}
LEAST_IDF = 1e-6
RRF_K = 5
CAP_OUT, CAP_IN, HUB, IN_WEIGHT = 16, 8, 32, 0.7
SMALL_ROWS = 200_000
#: Query vectors that are multiplied with all chunks at a time.
BLOCK = 20_000
#: Postings of the queries' terms that are scored at a time, about; those of one page are never apart.
SCORED = 1_000_000


def list_length(k: int) -> int:
    return max(4 * k, 20)


def asked_for(k, default: int = 5, most: int = 50) -> int:
    """How many results: a positive number up to ``most``, else the default."""
    try:
        k = float(k)
    except (TypeError, ValueError):
        return default
    return int(min(k, most)) or default if k > 0 else default


def ranked(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows of each query with their zero-based rank ``rnk``."""
    w = Window.partitionBy("qid").orderBy(*order)
    return df.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= limit).withColumn("rnk", F.col("rnk") - 1)


def field_tokens(pages: DataFrame) -> DataFrame:
    """(id, title, description, body, dl): token arrays of each page and their number."""
    t = pages.select("id", *[T.index_tokens(F.col(f)).alias(f) for f in FIELDS])
    return t.withColumn("dl", F.size("title") + F.size("description") + F.size("body"))


def _counted(batches: Iterator) -> Iterator:
    """Postings of batches (id, dl, a token list for each field): a page's words are counted where the page is."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            lists = [batch.column(i) for i in range(2, 2 + len(FIELDS))]
            rows = [np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in lists]
            words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            if not len(words):
                continue
            size = len(words.dictionary)
            key, place = np.unique(np.concatenate(rows) * size + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            ends = np.cumsum([len(x) for x in rows])[:-1]
            counts = [pa.array(np.bincount(x, minlength=len(key)).astype(np.int32)) for x in np.split(place, ends)]
            page = pa.array(key // size)
            columns = [words.dictionary.take(pa.array(key % size)), batch.column(0).take(page), batch.column(1).take(page), *counts]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "dl", *(f"tf_{f}" for f in FIELDS)])


def postings_of(tokens: DataFrame) -> DataFrame:
    """The inverted index (term, id, dl, tf_title, tf_description, tf_body) of :func:`field_tokens`; nothing is shuffled."""
    kinds = ", ".join(f"tf_{f} int" for f in FIELDS)
    return tokens.select("id", "dl", *FIELDS).mapInArrow(_counted, f"term string, id string, dl int, {kinds}")


def postings(pages: DataFrame) -> DataFrame:
    return postings_of(field_tokens(pages))


def weighted(postings: DataFrame) -> DataFrame:
    """(term, id, dl, wtf) with field-weighted frequencies."""
    return postings.select("term", "id", "dl", sum((F.col(f"tf_{f}") * w for f, w in FIELDS.items()), F.lit(0.0)).alias("wtf"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl) of (id, dl)."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, times) of (qid, query): a repeated word counts as often as it stands there."""
    return queries.select("qid", F.explode(T.query_tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))


def _scored(shared, most: int | None):
    """The scores of one block's postings (id, dl, code, wtf) for each query; with ``most`` the best of each only,
    by the score as it is rounded and then by id."""

    def run(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        qids, asked, size, avgdl = shared.value
        rows = pa.Table.from_batches(list(batches))
        ids = rows["id"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(ids.dictionary)
        names, rank = ids.dictionary.take(order), np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        code, wtf, dl = (rows[c].to_numpy() for c in ("code", "wtf", "dl"))
        part = wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * dl / avgdl))
        page, by_code = rank[ids.indices.to_numpy()], np.argsort(code, kind="stable")
        page, part, start = page[by_code], part[by_code], np.searchsorted(code[by_code], np.arange(size + 1))
        found: list[tuple] = []

        def batch():
            q, p, s = (np.concatenate(x) for x in zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays([qids.take(pa.array(q)), names.take(pa.array(p)), pa.array(s)], names=["qid", "id", "score"])

        waiting = 0
        for terms, weights, who in asked:
            cuts = [slice(start[c], start[c + 1]) for c in terms]
            score = np.bincount(np.concatenate([page[c] for c in cuts]), np.concatenate([w * part[c] for w, c in zip(weights, cuts)]), len(names))
            here = np.flatnonzero(score)
            if most is not None and len(here) > most:
                # Whatever rounds to the last score that counts, or more.
                here = here[score[here] >= np.partition(score, len(score) - most)[len(score) - most] - 2e-9]
                here = here[np.argsort(-np.floor(score[here] * 1e9 + 0.5), kind="stable")[:most]]
            if len(here):
                for q in who:
                    found.append((np.full(len(here), q), here, score[here]))
                    waiting += len(here)
            if waiting > 50_000:
                yield batch()
                waiting = 0
        if found:
            yield batch()

    return run


def bm25(index: DataFrame, lengths: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """(qid, id, score): every page that has a term of the query; with ``most`` at least the best of each query.

    ``index`` has the postings and ``lengths`` the lengths of all pages. Of a stored index only the terms of the
    queries are used; no text is read. The queries' terms are a stated set that goes to all tasks; postings are
    shuffled once, in blocks of whole pages, and a block is scored where it is. So with ``most`` the pairs of a query
    and a page, which grow with the product of both, are neither shuffled nor written.
    """
    spark, kind = queries.sparkSession, queries.schema["qid"].dataType.simpleString()
    terms = stage(query_terms(queries))
    used = index.join(sized(terms.select("term").distinct(), SMALL_ROWS), "term", "left_semi")
    stats = corpus_stats(lengths).first()
    n, avgdl = float(stats["n"]), float(stats["avgdl"] or 1.0)
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = terms.join(df, "term").select("qid", "term", "df", (F.col("times") * F.when(raw > 0, raw).otherwise(LEAST_IDF)).alias("idf")).toArrow().sort_by([("qid", "ascending"), ("term", "ascending")])
    if not rows.num_rows:
        return spark.createDataFrame([], f"qid {kind}, id string, score double")
    qid, term = (rows[c].combine_chunks().dictionary_encode() for c in ("qid", "term"))
    # Queries of the same terms are scored once.
    lists: dict[int, list] = {}
    for q, t, w in zip(qid.indices.to_pylist(), term.indices.to_pylist(), rows["idf"].to_pylist()):
        lists.setdefault(q, []).append((t, w))
    alike: dict[tuple, list[int]] = {}
    for q, own in lists.items():
        alike.setdefault(tuple(own), []).append(q)
    asked = [([t for t, _ in own], [w for _, w in own], who) for own, who in alike.items()]
    total = sum(dict(zip(term.indices.to_pylist(), rows["df"].to_pylist())).values())
    shared = spark.sparkContext.broadcast((qid.dictionary, asked, len(term.dictionary), avgdl))
    codes = spark.createDataFrame(list(zip(term.dictionary.to_pylist(), range(len(term.dictionary)))), "term string, code int")
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // SCORED)))).cast("int")
    used = weighted(index).join(sized(codes, SMALL_ROWS), "term").select("id", "dl", "code", "wtf", block.alias("block"))
    return used.groupBy("block").applyInArrow(_scored(shared, most), f"qid {kind}, id string, score double")


def text_arm(index: DataFrame, lengths: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, id, score, rnk)."""
    scored = bm25(index, lengths, queries, n).withColumn("score", F.round("score", 9))
    return ranked(scored, n, F.desc("score"), "id")


def rank_arm(index: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, id, score, rnk) by the other ranking: the sum over a term's places of weight / place^2, averaged over
    the query's terms. A title word weighs 1, others 0.1; title words have the first places; 256 places count."""
    terms = queries.select("qid", F.explode(F.array_distinct(T.ascii_terms(F.col("query")))).alias("term"))
    size = terms.groupBy("qid").agg(F.count("*").alias("size"))
    squares = lambda k: F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + 1 / (j * j))
    head, rest = F.least(F.col("tf_title"), F.lit(256)), F.least(F.col("tf_title") + F.col("tf_description") + F.col("tf_body"), F.lit(256))
    used = index.join(sized(stage(terms.select("term").distinct()), SMALL_ROWS), "term", "left_semi")
    used = used.select("term", "id", ((squares(head) + 0.1 * (squares(rest) - squares(head))) / 1.64493406685).alias("w"))
    scored = used.join(sized(stage(terms), SMALL_ROWS), "term").groupBy("qid", "id").agg(F.sum("w").alias("w")).join(size, "qid")
    return ranked(scored.select("qid", "id", F.round(F.col("w") / F.col("size"), 9).alias("score")), n, F.desc("score"), "id")


def _best_of(matrix, ids: list, most: int):
    """The best of one partition's rows (v, *columns) for each query vector, kept over all its batches."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        q, kept, best = matrix.value, [], None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            edge = np.full(len(ids), -np.inf) if best is None else best[:, 0]
            found_q, found_r, found_s = [], [], []
            for a in range(0, len(ids), 256):
                s = q[a : a + 256] @ v.T
                take = min(most, rows)
                own = np.partition(s, rows - take, axis=1)[:, rows - take]
                # Rows below the partition's best so far, or below the batch's own, can't be among the best.
                i, j = np.nonzero(s >= np.maximum(edge[a : a + 256], own)[:, None] - 1e-9)
                found_q.append(i + a), found_r.append(j), found_s.append(s[i, j])
            i, j, s = (np.concatenate(x) for x in (found_q, found_r, found_s))
            kept.append((i, s, batch.select(range(1, batch.num_columns)).take(pa.array(j))))
            best = np.full((len(ids), most), -np.inf) if best is None else best
            order = np.lexsort((-s, i))
            place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
            few = order[place < most]
            fresh = np.full((len(ids), most), -np.inf)
            fresh[i[few], place[place < most]] = s[few]
            best = np.partition(np.concatenate([best, fresh], 1), most, axis=1)[:, most:]
            best.sort(1)
            if sum(len(x[0]) for x in kept) > 4 * most * len(ids):
                kept = [_above(x, best[:, 0]) for x in kept]
        for i, s, rows in (_above(x, best[:, 0]) for x in kept):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], pa.string()), pa.array(s), *rows.columns], names=["qid", "similarity", *rows.schema.names])

    return run


def _above(found: tuple, edge):
    import pyarrow as pa

    i, s, rows = found
    fine = s >= edge[i] - 1e-9
    return i[fine], s[fine], rows.filter(pa.array(fine))


def vector_scan(chunks: DataFrame, vectors: DataFrame, most: int, carry: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(qid, similarity, *carry): exact; for each query at least its ``most`` best chunks of each partition.

    A stated query set against all chunks, in blocks of at most BLOCK query vectors; each is multiplied with the
    Arrow batches of the chunks where these are, and a partition keeps its best ``most``, and what ties with the last
    one, over all batches. ``carry`` are the columns of ``chunks`` to come along. The result of each block is
    staged, so that one block at a time is held by the executors.
    """
    import numpy as np

    spark = chunks.sparkSession
    vectors = stage(vectors.select("qid", "v"))
    count = -(-vectors.count() // BLOCK)
    block = vectors.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, count))))
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in carry)
    out = None
    for b in range(count):
        rows = block.filter(F.col("block") == b).collect()
        if not rows:
            continue
        matrix = spark.sparkContext.broadcast(np.array([r["v"] for r in rows], dtype=np.float64))
        part = chunks.select("v", *carry).mapInArrow(_best_of(matrix, [r["qid"] for r in rows], most), f"qid string, similarity double, {kinds}")
        if count > 1:
            part = stage(part)
            matrix.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"qid string, similarity double, {kinds}") if out is None else out


def best_chunks(chunks: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(qid, id, ord, similarity, rnk): of the first 3n chunks by (distance, page, ord) the best of each page, the first n pages."""
    best = vector_scan(chunks, vectors, 3 * n, ("page_id", "ord")).withColumn("similarity", F.round("similarity", 9))
    top = ranked(best, 3 * n, F.desc("similarity"), "page_id", "ord")
    page = Window.partitionBy("qid", "page_id").orderBy("rnk")
    first = top.withColumn("i", F.row_number().over(page)).filter("i = 1").withColumnRenamed("rnk", "place")
    return ranked(first, n, "place").select("qid", F.col("page_id").alias("id"), "ord", "similarity", "rnk")


def vector_arm(chunks: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(qid, id, similarity, rnk)."""
    return best_chunks(chunks, vectors, n).drop("ord")


def seeds(text: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """(qid, id, best): the union of the first k of both arms, with the best rank in the whole lists."""
    both = text.select("qid", "id", "rnk").unionByName(vector.select("qid", "id", "rnk"))
    return both.groupBy("qid", "id").agg(F.min("rnk").alias("best")).filter(F.col("best") < k)


def degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, deg) by distinct sources that point to it, and by distinct targets it points to; dangling edges count."""
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("deg"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("deg"))
    return into, out


def _walk(edges: DataFrame, seed: DataFrame, here: str, there: str, ids: DataFrame, cap: int) -> DataFrame:
    """Distinct existing neighbours of each seed, the first ``cap`` by id."""
    wanted = sized(stage(seed.select(F.col("id").alias("seed")).distinct()), SMALL_ROWS)
    pairs = edges.select(F.col(here).alias("seed"), F.col(there).alias("cand")).join(wanted, "seed", "left_semi").distinct()
    pairs = spread_join(pairs, ids.select(F.col("id").alias("cand")), "cand", "left_semi")
    w = Window.partitionBy("seed").orderBy("cand")
    return pairs.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= cap).drop("i")


def graph_arm(edges: DataFrame, ids: DataFrame, seed: DataFrame, k: int, mode: str = "v2") -> DataFrame:
    """(qid, id, score, rnk): pages one step from the seeds, the first 4k.

    'v2' walks outward; 'v2in' also inward from seeds that are no hubs, damped by their in-degree and by the
    contributor's out-degree; a candidate's score is the best of its seeds. 'legacy' takes all targets of the
    seeds in seed order, unscored; these may be seeds themselves or not exist.
    """
    if mode == "legacy":
        order = Window.partitionBy("qid").orderBy("best", "id")
        placed = seed.withColumn("place", F.row_number().over(order))
        hits = edges.select(F.col("source").alias("id"), "target").distinct().join(placed, "id").groupBy("qid", F.col("target").alias("id")).agg(F.min("place").alias("place"))
        return ranked(hits, 4 * k, "place", "id").select("qid", "id", F.lit(1.0).alias("score"), "rnk")
    weight = 1 / (1 + F.col("best"))
    found = _walk(edges, seed, "source", "target", ids, CAP_OUT).join(seed.withColumnRenamed("id", "seed"), "seed").select("qid", F.col("cand").alias("id"), weight.alias("score"))
    if mode == "v2in":
        into, out = degrees(edges)
        fit = seed.join(into.filter(F.col("deg").between(1, HUB)), "id")
        back = _walk(edges, fit, "target", "source", ids, CAP_IN).join(fit.withColumnRenamed("id", "seed"), "seed")
        back = back.join(out.select(F.col("id").alias("cand"), F.col("deg").alias("outdeg")), "cand")
        damp = lambda c: 1 / F.log2(2 + F.col(c))
        found = found.unionByName(back.select("qid", F.col("cand").alias("id"), (IN_WEIGHT * weight * damp("deg") * damp("outdeg")).alias("score")))
    best = found.groupBy("qid", "id").agg(F.round(F.max("score"), 9).alias("score")).join(seed.select("qid", "id"), ["qid", "id"], "left_anti")
    return ranked(best, 4 * k, F.desc("score"), "id")


def fuse(*arms: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, id, score): reciprocal rank fusion of (qid, id, rnk) lists, added in the order of the arms."""
    lists = None
    for i, arm in enumerate(arms):
        one = arm.select("qid", "id", F.struct(F.lit(i).alias("arm"), (1 / (k + F.col("rnk") + 1)).alias("s")).alias("s"))
        lists = one if lists is None else lists.unionByName(one)
    add = lambda a: F.aggregate(F.sort_array(a), F.lit(0.0), lambda t, x: t + x.s)
    return lists.groupBy("qid", "id").agg(add(F.collect_list("s")).alias("score"))
