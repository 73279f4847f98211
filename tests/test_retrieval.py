import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphmere.functions import ranking as R
from graphmere.functions import text as T
from graphmere.operators import chunking, graph, index, recall, retrieval

PAGES = "id string, title string, description string, body string, path string, trust string, volatile boolean, freshness double"
ROWS = [
    ("a", "Harbour rota", "who sails", "the ferry leaves the harbour at nine", "a.md", "trusted", False, None),
    ("b", "Ferry times", None, "times of the ferry and of the bus", "in_mail/b.md", "untrusted", True, 100.0 * 86400),
    ("c", "Ferry times", "old", "ferry ferry ferry", "in_mail/c.md", "untrusted", True, 200.0 * 86400),
    ("d", "Crème", None, None, "out/out_distill/d.md", "derived", False, None),
    ("e", None, None, "", "e.md", None, None, None),
]


def tokens(x):
    return re.findall(r"[a-z0-9]+", (x or "").lower().replace("è", "e"))


def test_bm25_against_formula(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    queries = spark.createDataFrame([("q1", "Ferry ferry HARBOUR x"), ("q2", "creme"), ("q3", None), ("q4", "")], "qid string, query string")
    got = {(r["qid"], r["id"]): r["score"] for r in retrieval.bm25(*index.text_tables(pages), queries).collect()}
    docs = {r[0]: [(10, tokens(r[1])), (3, tokens(r[2])), (1, tokens(r[3]))] for r in ROWS}
    dl = {i: sum(len(t) for _, t in d) for i, d in docs.items()}
    avg = sum(dl.values()) / len(dl)
    want = {}
    for qid, terms in (("q1", ["ferry", "ferry", "harbour"]), ("q2", ["creme"])):
        for term in terms:
            tf = {i: sum(w * Counter(t)[term] for w, t in d) for i, d in docs.items()}
            df = sum(v > 0 for v in tf.values())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
            for i, f in tf.items():
                if f:
                    want[qid, i] = want.get((qid, i), 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl[i] / avg))
    assert got == pytest.approx(want)


def test_text_arm_keeps_the_best_where_pages_are(spark, monkeypatch):
    """Pairs of query and page are neither shuffled nor returned beyond the best of each block; ties go by id."""
    monkeypatch.setattr(retrieval, "SCORED", 100)
    pages = spark.createDataFrame([(f"p{i % 7}/{i:03}", f"ferry{i % 3} port", None, "the ferry " * (i % 5) + "zebra" * (i == 77)) for i in range(200)], "id string, title string, description string, body string")
    queries = spark.createDataFrame([(f"q{i}", f"Ferry port ferry{i % 3}") for i in range(9)] + [("z", "zebra"), ("n", "nothing")], "qid string, query string")
    postings, lengths = index.text_tables(pages)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    every = retrieval.bm25(postings, lengths, queries).withColumn("score", F.round("score", 9)).collect()
    best = retrieval.bm25(postings, lengths, queries, 4).collect()
    blocks = -(-sum(r["n"] for r in postings.filter("term in ('ferry', 'port', 'ferry0', 'ferry1', 'ferry2', 'zebra')").groupBy().agg(F.count("*").alias("n")).collect()) // 100)
    assert len(every) == 9 * 200 + 1 and blocks > 1 and len(best) <= (9 * 4 + 1) * blocks < len(every)
    got = sorted(tuple(r) for r in retrieval.text_arm(postings, lengths, queries, 4).select("qid", "rnk", "id", "score").collect())
    want = []
    for q in {r["qid"] for r in every}:
        want += [(q, i, r["id"], r["score"]) for i, r in enumerate(sorted((r for r in every if r["qid"] == q), key=lambda r: (-r["score"], r["id"]))[:4])]
    assert got == sorted(want) and len(got) == 37


def test_vector_arm_limits_chunks_before_pages(spark):
    chunks = spark.createDataFrame([(i, "p" if i < 7 else f"q{i}", i, [1.0, i / 10.0]) for i in range(12)], "chunk_id long, page_id string, ord int, v array<double>")
    chunks = chunks.withColumn("v", F.transform("v", lambda x: x / F.sqrt(1 + F.pow(F.col("v")[1], 2))))
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, v array<double>")
    out = retrieval.vector_arm(chunks, asked, 3).orderBy("rnk").collect()
    assert [r["id"] for r in out] == ["p", "q7", "q8"]
    assert retrieval.vector_arm(chunks, asked.limit(0), 3).count() == 0


def test_vector_scan_over_many_batches(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v, q = np.round(rng.standard_normal((500, 4)), 1), np.round(rng.standard_normal((7, 4)), 1)
    chunks = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id long, v array<double>").repartition(2)
    asked = spark.createDataFrame([(f"q{i}", [float(x) for x in r]) for i, r in enumerate(q)], "qid string, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        rows = retrieval.vector_scan(chunks, asked, 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) <= 2 * 7 * 12
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append((-round(r["similarity"], 9), r["chunk_id"]))
    for i in range(7):
        want = sorted((-round(float(s), 9), j) for j, s in enumerate(v @ q[i]))[:5]
        assert sorted(got[f"q{i}"])[:5] == want


def test_graph_arm(spark):
    links = [("s", f"t{i:02}") for i in range(20)] + [("s", "ghost"), ("s", "r")] + [(f"x{i}", "r") for i in range(33)] + [("y", "s")]
    edges = spark.createDataFrame([(a, "cites", b, 1.0) for a, b in links], "source string, type string, target string, weight double")
    ids = spark.createDataFrame([(f"t{i:02}",) for i in range(20)] + [("s",), ("r",), ("y",)] + [(f"x{i}",) for i in range(33)], "id string")
    seed = spark.createDataFrame([("q", "s", 0), ("q", "r", 1)], "qid string, id string, best int")
    out = [r["id"] for r in retrieval.graph_arm(edges, ids, seed, 5).orderBy("rnk").collect()]
    assert out == [f"t{i:02}" for i in range(15)]  # r comes before t and takes a place of the cap, but is a seed
    back = {r["id"]: r["score"] for r in retrieval.graph_arm(edges, ids, seed, 10, "v2in").collect()}
    assert "x0" not in back  # r is a hub
    assert back["y"] == pytest.approx(0.7 / math.log2(3) / math.log2(3))


def test_fusion(spark):
    arm = lambda ids: spark.createDataFrame([("q", x, i) for i, x in enumerate(ids)], "qid string, id string, rnk int")
    got = {r["id"]: r["score"] for r in retrieval.fuse(arm(["a", "b"]), arm(["b"]), arm(["c"])).collect()}
    assert got == pytest.approx({"a": 1 / 6, "b": 1 / 7 + 1 / 6, "c": 1 / 6})


def test_collapse_keeps_the_freshest_in_the_first_slot(spark):
    rows = [("q", "b", 1, 0.5, "T", "u", "in_x/b.md", True, 1.0 * 86400), ("q", "x", 2, 0.4, "X", "u", "x.md", False, None), ("q", "c", 3, 0.3, "t ", "u", "in_x/c.md", True, 9.0 * 86400), ("q", "d", 4, 0.2, "T", "u", "in_x/d.md", True, 9.2 * 86400)]
    df = spark.createDataFrame(rows, "qid string, id string, pos int, adj double, title string, trust string, path string, volatile boolean, freshness double")
    out = {r["id"]: (r["slot"], r["duplicates"]) for r in recall.collapse(df).collect()}
    assert out == {"c": (1, 2), "x": (2, None)}
    twins = [("q", "m", 1, 0.5, "M", None, "m.md", False, None), ("q", "n", 2, 0.4, "M", "untrusted", "n.md", False, None)]
    assert [tuple(r)[0] for r in recall.collapse(spark.createDataFrame(twins, df.schema)).select("id").collect()] == ["m"]


def test_tiebreak_measures_from_the_head(spark):
    rows = [("q", "a", 1, 1.0, False, None), ("q", "b", 2, 1.0 - 0.6e-9, True, 5.0), ("q", "c", 3, 1.0 - 1.2e-9, True, 9.0)]
    df = spark.createDataFrame(rows, "qid string, id string, slot int, adj double, volatile boolean, freshness double")
    assert [r["id"] for r in recall.tiebreak(df).orderBy("place").collect()] == ["b", "a", "c"]


def test_weights(spark):
    paths = ["raw/x.md", "a/in_b/x.md", "out/x.md", "out/out_distill/x.md", "raw/out_distill/x.md", "in_x.md", "a/raw/x.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select(R.zone(F.col("path")), R.zone_weight(F.col("path")))
    assert [tuple(r) for r in df.collect()] == [("incoming", 0.8), ("incoming", 0.8), ("output", 0.7), ("output", 0.87), ("incoming", 0.8), ("wiki", 1.0), ("wiki", 1.0)]


def test_text_functions(spark):
    row = spark.createDataFrame([("Crème Brûlée_2 x", "\x1b[31mred\x1b[0m\x00\r\nend\r", "See [[a/b.md#h|c]] [[ d ]] [[]]")], "a string, b string, c string")
    r = row.select(T.index_tokens(F.col("a")).alias("i"), T.query_tokens(F.col("a")).alias("q"), T.sanitize(F.col("b")).alias("s"), T.wikilinks(F.col("c")).alias("w"), T.slug(F.col("a")).alias("slug"), T.match_expression(F.col("a")).alias("m")).first()
    assert (r["i"], r["q"], r["s"], r["w"]) == (["creme", "brulee", "2", "x"], ["creme", "brulee"], "red\nend\n", ["a/b", "d"])
    assert r["slug"] == "cr-me-br-l-e-2-x" and r["m"] == '"Cr" OR "me" OR "Br"'


def windows(text, size, overlap):
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            ws = max(text[start:end].rfind(c) for c in " \n\t")
            if ws > size / 2:
                end = start + ws
        out.append((start, end))
        if end >= len(text):
            return out
        near = end - overlap
        if near > 0 and not text[near - 1].isspace() and (m := re.search(r"\s", text[near:end])):
            near += m.start() + 1
        start = near


@pytest.mark.parametrize("text", ["short", "w" * 500, " ".join(f"word{i}" for i in range(300)), "a b\n" * 90 + "z" * 210 + " end", ("x" * 97 + " y\n") * 5, ""])
def test_chunk_windows(spark, text):
    got = chunking.chunk_pages(spark.createDataFrame([("p", "", text)], "id string, title string, body string"), 100, 20)
    rows = got.orderBy("ord").collect()
    assert [(r["lo"], r["hi"]) for r in rows] == windows("\n" + text, 100, 20)
    assert [r["text"] for r in rows] == [("\n" + text)[r["lo"] : r["hi"]] for r in rows]


def test_graph_operators(spark):
    edges = spark.createDataFrame([("a", "cites", "b", 1.0), ("b", "part-of", "a", 1.0), ("a", "cites", "a", 1.0), ("b", "cites", "ghost", 1.0), ("c", "causes", "d", 0.5)], "source string, type string, target string, weight double")
    pages = spark.createDataFrame([(x, x.upper()) for x in "abcd"], "id string, title string")
    typed = graph.typed_edges(edges, pages)
    assert {(r["source"], r["target"], r["family"]) for r in typed.collect()} == {("a", "b", "epistemic"), ("b", "a", "structural"), ("a", "a", "epistemic"), ("c", "d", "causal")}
    assert {r["id"]: r["degree"] for r in graph.degree(typed).collect()} == dict.fromkeys("abcd", 1)
    com = {r["id"]: r["size"] for r in graph.communities(typed, 4).collect()}
    assert set(com) == set("abcd")
    lines = spark.createDataFrame([(str(i),) for i in range(100)], "line string")
    one = graph.set_hash(lines).first()
    assert one == graph.set_hash(lines.repartition(7)).first() and one["n"] == 100
    assert one["digest"] != graph.set_hash(lines.union(lines.limit(1))).first()["digest"] != graph.set_hash(lines.limit(0)).first()["digest"]


def test_communities_of_the_whole_graph(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", "t", 1.0) for i in range(4) for j in range(i)]
    rows = [("hub", f"leaf{i}", "t", 1.0) for i in range(9)] + clique("a") + clique("b") + [("a0", "b0", "t", 1.0)]
    typed = spark.createDataFrame(rows, "source string, target string, type string, weight double")
    similar = spark.createDataFrame([("sim1", "sim2", 0.9)], "a string, b string, weight double")
    ids = spark.createDataFrame([("alone",), ("a1",)], "id string")
    found = {}
    for r in graph.communities(typed, similar=similar, ids=ids).collect():
        found.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, found.values())) == [["a0", "a1", "a2", "a3"], ["alone"], ["b0", "b1", "b2", "b3"], ["hub", *[f"leaf{i}" for i in range(9)]], ["sim1", "sim2"]]


def test_similarity_edges_of_all_pages(spark, data):
    import numpy as np

    from graphmere.plans import catalogue as C

    live = {r["id"] for r in C._pages(spark, data).select("id").collect()}
    heads = [(r["page_id"], r["v"]) for r in C._chunks(spark, data).filter("ord = 0").collect() if r["page_id"] in live]
    typed = {tuple(r) for r in graph.pairs(C._typed(spark, data)).collect()}
    s, want = np.round(np.array([v for _, v in heads]) @ np.array([v for _, v in heads]).T, 9), set()
    for i, (a, _) in enumerate(heads):
        near = sorted((-s[i, j], b) for j, (b, _) in enumerate(heads) if j != i and s[i, j] >= 0.35)[:6]
        want |= {(min(a, b), max(a, b)) for _, b in near}
    got = {(r["a"], r["b"]) for r in C.QUERIES["graph_similarity_edges_all"](spark, data).collect()}
    assert len(got) > 20 and got == want - typed
