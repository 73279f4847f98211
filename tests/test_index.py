"""The stored index, changes of memories, embedders and the streams that follow them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphmere.functions import text as T
from graphmere.operators import index, lifecycle, maintenance, recall, retrieval
from graphmere.operators.embedding import Embedder, hashed_words
from graphmere.sources import store
from graphmere.streaming import ingest

ITEM = "id string, path string, title string, type string, body string, edges array<struct<type:string,target:string,weight:double>>, trust string, volatile boolean, freshness double, description string, resource string, source string, authored double, write_actor string, tombstoned boolean"


def item(ident, body="some words of a page", **more):
    row = {"id": ident, "path": None, "title": ident.upper(), "type": None, "body": body, "edges": None, "trust": None, "volatile": None, "freshness": None, "description": None, "resource": None, "source": None, "authored": None, "write_actor": "ann", "tombstoned": False}
    return tuple((row | more).values())


def counts(**x):
    return {"files": 0, "indexed": 0, "skipped": 0, "tombstoned": 0, "pruned": 0, "synced": 0} | x


def test_reindex(spark, tmp_path):
    root = str(tmp_path)
    run = lambda rows, **more: index.reindex(spark, root, spark.createDataFrame(rows, ITEM), hashed_words(16), **more)
    rows = [item(x, edges=[("cites", "b", None), ("cites", "b", 2.0), ("cites", "", None)]) for x in "abcdef"] + [item("gone", tombstoned=True)]
    assert run(rows) == counts(files=7, indexed=6, tombstoned=1)
    ix = index.open_index(spark, root)
    assert ix.edges.filter("source = 'a'").collect() == [("a", "cites", "b", 1.0)]
    assert (ix.nodes.count(), ix.chunks.count(), ix.lengths.count()) == (6, 6, 6)
    held = store.read_pointer(spark, root)
    assert run(rows) == counts(files=7, skipped=6, tombstoned=1) and store.read_pointer(spark, root) == held
    # Content, metadata, embedding and absence each have their own effect.
    rows[0] = item("a", "a long new text " * 300, write_actor="unknown")
    rows[1] = item("b", edges=rows[1][5], description="fresh words", write_actor="unknown")
    assert run(rows[:5], full=False) == counts(files=5, indexed=1, skipped=4, synced=1)
    ix = index.open_index(spark, root)
    assert ix.nodes.count() == 6 and {r["write_actor"] for r in ix.nodes.collect()} == {"ann"}
    assert ix.chunks.filter("page_id = 'a'").count() > 1 and ix.edges.filter("source = 'a'").count() == 0
    assert {r["id"] for r in ix.postings.filter("term = 'fresh'").collect()} == {"b"} and {r["id"] for r in ix.postings.filter("term = 'long'").collect()} == {"a"}
    now = store.read_pointer(spark, root)
    touched = {str(r[0]) for r in spark.createDataFrame([("a",), ("b",)], "id string").select(store.bucket(F.col("id"), 8)).collect()}
    assert {b for b, f in now["tables"]["nodes"]["folders"].items() if held["tables"]["nodes"]["folders"].get(b) != f} <= touched
    assert run(rows[:5]) == counts(files=5, skipped=5, pruned=1) and {r["id"] for r in index.open_index(spark, root).nodes.collect()} == set("abcde")
    gone = spark.createDataFrame([("a",), ("a",), ("nobody",), (None,)], "id string")
    assert index.remove(spark, root, gone) == 1 and index.remove(spark, root, gone) == 0
    ix = index.open_index(spark, root)
    assert ix.nodes.count() == 4 and ix.postings.filter("id = 'a'").count() == ix.chunks.filter("page_id = 'a'").count() == 0
    assert run(rows[:5]) == counts(files=5, indexed=1, skipped=4)
    assert run(rows[:5], fresh=True) == counts(files=5, indexed=5)
    assert index.reindex(spark, root, spark.createDataFrame(rows[:5], ITEM), hashed_words(8)) == counts(files=5, indexed=5)
    assert index.reindex(spark, root, spark.createDataFrame([], ITEM), hashed_words(8)) == counts(pruned=5)
    assert index.open_index(spark, root).postings.count() == 0


def test_generation_is_of_content(spark):
    rows = spark.createDataFrame([("a.md", "h", "trusted", None, 1.5), ("b.md", "i", "derived", "chat", None)], "path string, content_hash string, trust string, source string, authored double")
    sig = hashed_words().signature()
    one = index.generation(rows, sig)
    assert one == index.generation(rows.repartition(3).orderBy("path"), sig) and one.startswith("v1:")
    others = [index.generation(rows.withColumn("source", F.lit("x")), sig), index.generation(rows.withColumn("authored", F.lit(2.0)), sig), index.generation(rows, sig, "scope"), index.generation(rows, "e:8")]
    assert len({one, *others}) == 5
    assert index.generation(rows.withColumn("path", F.concat(F.lit("./"), "path")), sig) == one


def test_recall_over_an_index(spark, tmp_path):
    rows = [item("wiki/ferry", "the ferry leaves", trust="trusted", source="manual", authored=1.25, volatile=True, freshness=86400.0), item("wiki/bus", "the bus waits", trust="trusted", edges=[("cites", "wiki/ferry", None)])]
    e = hashed_words(64)
    index.reindex(spark, str(tmp_path), spark.createDataFrame(rows, ITEM), e)
    asked = spark.createDataFrame([("q", "ferry leaves"), ("none", "zz")], "qid string, query string").withColumn("v", e.queries(F.col("query")).cast("array<double>"))
    found = recall.recall(index.open_index(spark, str(tmp_path)), asked, k=3)
    out = {(r["qid"], r["rank"]): r for r in found.collect()}
    top = out["q", 1]
    assert (top["id"], top["volatile"], top["freshness"], top["authored"], top["source"], top["write_actor"]) == ("wiki/ferry", True, "1970-01-02", "1970-01-01T00:00:01.250Z", "manual", "ann")
    assert out["q", 2]["volatile"] is None
    events = maintenance.recall_events(found, F.lit(datetime(2024, 1, 1)))
    assert {r["memory"]: r["hits"] for r in maintenance.recall_stats(events).collect()}["wiki/ferry"] == 2


def test_embedder(spark):
    assert hashed_words(8).signature() == "hashed-words:8:trunc=2000:chunk1800o200"
    same = lambda c: c
    assert Embedder(4, same, same).signature() == "e:4:chunk1800o200"
    assert Embedder(4, same, same, "m", "r1", "q8", "mean", 9).signature() == "m:4:rev=r1:dt=q8:pool=mean:trunc=9:chunk1800o200"
    df = spark.createDataFrame([("a b",), ("b a",), ("",), (None,)], "t string").select(hashed_words(8).passages(F.col("t")).alias("v"))
    v = [r["v"] for r in df.collect()]
    assert v[0] == v[1] and v[2] == v[3] == [1.0] + [0.0] * 7 and sum(x * x for x in v[0]) == pytest.approx(1)


MEMORY = "id string, path string, title string, body string, edges array<struct<type:string,target:string,weight:double>>, trust string, updated string, superseded_by string, forgotten boolean"


def test_lifecycle(spark):
    now = datetime(2024, 5, 1)
    items = spark.createDataFrame([("m/a", "m/a.md", "A", "old", [("Related_To", "m/b", None)], "untrusted", None, None, None), ("m/b", "m/b.md", "B", "b", None, None, "x", None, None)], MEMORY)
    new = spark.createDataFrame([("A", "new\x00 text"), ("A", "new text"), ("C", None)], "title string, body string")
    items = lifecycle.remember(items, new, lambda b: F.replace(b, F.lit("text"), F.lit("TEXT")))
    got = {r["id"]: r for r in items.collect()}
    fresh = {i for i in got if i.startswith("out_memory/")}
    assert len(got) == 4 and {got[i]["body"] for i in fresh} == {"new TEXT", None}
    assert lifecycle.remember(items, new, lambda b: F.replace(b, F.lit("text"), F.lit("TEXT"))).count() == 4
    succ = next(i for i in fresh if got[i]["body"])
    done = {r["id"]: r for r in lifecycle.supersede(items, spark.createDataFrame([("m/a", succ), ("m/b", "nowhere"), (None, succ), ("m/a", "m/a")], "old string, new string"), now).collect()}
    assert (done["m/a"]["superseded_by"], done["m/a"]["updated"], done["m/b"]["superseded_by"], done["m/b"]["updated"]) == (succ, "2024-05-01T00:00:00Z", None, "x")
    links = spark.createDataFrame([("m/a", "related-to", "m/b"), ("m/a", None, "m/c"), ("m/a", "related_to", "m/c"), ("m/b", "cites", "m/a"), (None, "x", "y")], "source string, type string, target string")
    linked = {r["id"]: [tuple(e)[:2] for e in r["edges"] or []] for r in lifecycle.link(items, links, now).collect()}
    assert linked["m/a"] == [("Related_To", "m/b"), ("related_to", "m/c")] and linked["m/b"] == [("cites", "m/a")]
    gone = spark.createDataFrame([("m/a",), ("m/a",), ("zz",), (None,)], "id string")
    soft = lifecycle.forget(items, gone, now=now)
    assert soft.count() == 4 and {r["id"] for r in soft.filter(lifecycle.tombstoned()).collect()} == {"m/a"}
    assert {r["id"] for r in lifecycle.forget(items, gone, hard=True).collect()} == set(got) - {"m/a"}
    assert {r["id"]: r["trust"] for r in lifecycle.elevate(items, gone).collect()}["m/a"] == "trusted"
    assert lifecycle.link(items.limit(0), links.limit(0)).count() == lifecycle.remember(items.limit(0), new.limit(0)).count() == 0


def test_memory_ids_widen_where_they_are_taken(spark):
    new = spark.createDataFrame([("T", f"body {i}") for i in range(40)] + [("T", "body 0"), (None, None)], "title string, body string")
    first = T.memory_ids(new, spark.createDataFrame([], "id string, title string, body string"))
    rows = {(r["title"], r["body"]): r["id"] for r in first.collect()}
    assert len(rows) == len(set(rows.values())) == 41 and rows[None, None].startswith("out_memory/item-")
    taken = spark.createDataFrame([(rows["T", "body 0"], "T", "another"), (rows["T", "body 1"], "T", "body 1")], "id string, title string, body string")
    again = {(r["title"], r["body"]): r["id"] for r in T.memory_ids(new, taken).collect()}
    assert len(again["T", "body 0"]) == len(rows["T", "body 0"]) + 4 and again["T", "body 1"] == rows["T", "body 1"]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a, b,, c ", "7", ""), (None, "-1", None), ("", "900", "x")], "l string, n string, o string")
    got = df.select(T.listed(F.col("l")), T.counted(F.col("n"), 5, 50), T.optional_text(F.col("o")), T.preview(F.lit("  a \n b  "), 3), T.label(F.col("o"), F.lit("id"), 1)).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c"], 7, None, "a b", "i"), ([], 5, None, "a b", "i"), ([], 50, "x", "a b", "x")]
    assert [retrieval.asked_for(k) for k in (None, 0, -3, "x", 3, "7", 99, 0.5)] == [5, 5, 5, 5, 3, 7, 50, 5]


def test_freshest_claim_stream(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "id string, path string, title string, trust string, freshness double"
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
    add(("a", "w/a.md", "T", None, 5 * 86400.0), ("z", "in_x/z.md", "T", None, 1.0))

    def run():
        out = ingest.freshest(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        rows = []
        out.foreachBatch(lambda df, _: rows.extend(tuple(r)[1:4] for r in df.collect())).start().awaitTermination()
        return sorted(rows)

    assert run() == [("incoming", "t", "z"), ("wiki", "t", "a")]
    add(("b", "w/b.md", " t", "untrusted", 5.5 * 86400), ("c", "w/c.md", "T", None, None))
    assert run() == []
    add(("d", "w/d.md", "T", None, 9 * 86400.0), ("e", "w/e.md", "T", None, 6 * 86400.0))
    assert run() == [("wiki", "t", "d")]


def test_recall_counts_stream(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "ts timestamp, memory string"
    spark.createDataFrame([(datetime(2024, 1, 1, 3), "a"), (datetime(2024, 1, 1, 9), "a"), (datetime(2024, 1, 2, 1), "b")], schema).write.parquet(src)
    rows = []
    q = ingest.recall_counts(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    q.foreachBatch(lambda df, _: rows.extend((r["memory"], r["hits"]) for r in df.collect())).start().awaitTermination()
    assert sorted(rows) == [("a", 2), ("b", 1)]


def test_graph_tables_are_kept_by_signature(spark, tmp_path):
    from graphmere.operators import graph

    pages = spark.createDataFrame([(x, x.upper(), None, "trusted", "h" + x) for x in "abc"], "id string, title string, type string, trust string, content_hash string")
    edges = spark.createDataFrame([("a", "cites", "b", 1.0)], "source string, type string, target string, weight double")
    chunks = spark.createDataFrame([(i, x, 0, v) for i, (x, v) in enumerate({"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 0.0]}.items())], "chunk_id long, page_id string, ord int, v array<double>")
    calls = []
    build = lambda: calls.append(1) or graph.graph_tables(edges, pages, chunks)
    for _ in range(2):
        got = store.cached(spark, str(tmp_path), graph.signature(pages), build)
    assert len(calls) == 1
    assert {(r["a"], r["b"], r["type"], r["family"]) for r in got["links"].collect()} == {("a", "b", "cites", "epistemic"), ("a", "c", "similar-to", "similarity")}
    assert {r["id"]: r["degree"] for r in got["nodes"].collect()} == {"a": 1, "b": 1, "c": 0}
    store.cached(spark, str(tmp_path), graph.signature(pages.withColumn("content_hash", F.lit("x"))), build)
    assert len(calls) == 2
