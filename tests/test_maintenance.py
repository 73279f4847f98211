import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphmere.operators import maintenance as M
from graphmere.operators.joins import spread_join
from graphmere.sources import markdown, store
from graphmere.streaming import ingest


def test_classify_and_upsert(spark):
    old = spark.createDataFrame([("a", "h1", "ann"), ("b", "h2", "bob"), ("c", None, "cy")], "id string, content_hash string, write_actor string")
    new = spark.createDataFrame([("a", "h1", "unknown"), ("b", "h9", "eve"), ("c", None, None), ("d", "h4", "unknown")], "id string, content_hash string, write_actor string")
    assert {r["id"]: r["status"] for r in M.classify(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "new"}
    assert {tuple(r) for r in M.upsert(old, new).collect()} == {("a", "h1", "ann"), ("b", "h9", "eve"), ("c", None, "cy"), ("d", "h4", "unknown")}


def test_edges_json_is_compact(spark):
    df = spark.createDataFrame([([("cites", 'a"b', 1.0), ("x", "é", None), ("y", "z", 0.41)],), (None,)], "e array<struct<type:string,target:string,weight:double>>")
    got = [r[0] for r in df.select(M.edges_json(F.col("e"))).collect()]
    assert json.loads(got[0]) == [{"type": "cites", "target": 'a"b', "weight": 1}, {"type": "x", "target": "é"}, {"type": "y", "target": "z", "weight": 0.41}]
    assert '"weight":1}' in got[0] and got[1] == "[]"


def test_remove_leaves_inbound_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    gone = spark.createDataFrame([("b",)], "id string")
    assert [tuple(r) for r in M.remove_ids(edges, gone, "source").collect()] == [("a", "b")]
    assert [tuple(r) for r in M.prune(edges, gone, "source").collect()] == [("b", "a")]


PAGE = "﻿---\r\ntitle: \"A page\"\r\nvolatile: yes\r\ntags: [x, 'y z']\r\naliases:\r\n  - one\r\n  - two\r\nsources:\r\n  - \"[[wiki/s|S]]\"\r\nsuperseded_by: wiki/new\r\n---\r\nBody [[t]]\r\n"


def test_markdown(spark, tmp_path):
    os.makedirs(tmp_path / "wiki/.hidden")
    for name, text in (("wiki/a.md", PAGE), ("wiki/index.md", "x"), ("wiki/.hidden/b.md", "x"), ("wiki/c.txt", "x"), ("wiki/d.md", "---\nno end"), ("raw.md", "plain")):
        (tmp_path / name).write_text(text, newline="")
    rows = markdown.items(markdown.scan_markdown(spark, str(tmp_path)))
    got = {r["path"]: r for r in rows.collect()}
    assert set(got) == {"wiki/a.md", "wiki/d.md", "raw.md"}
    a = got["wiki/a.md"]
    assert (a["title"], a["volatile"], a["tags"], a["aliases"], a["tombstoned"], a["body"]) == ("A page", False, ["x", "y z"], ["one", "two"], True, "Body [[t]]\n")
    assert (got["wiki/d.md"]["title"], got["wiki/d.md"]["body"], got["wiki/d.md"]["tombstoned"]) == ("d", "---\nno end", False)
    links = {(r["type"], r["target"]) for r in markdown.link_edges(rows.filter("path = 'wiki/a.md'")).collect()}
    assert links == {("cites", "wiki/s"), ("related-to", "t")}
    assert markdown.newer_than(spark, str(tmp_path), datetime(2020, 1, 1)) and not markdown.newer_than(spark, str(tmp_path), datetime(2120, 1, 1))


HEADERS = {
    'volatile: "true"': {"volatile": False},
    "volatile: True\nforgotten: true": {"volatile": True, "forgotten": True, "tombstoned": True},
    "volatile: yes\nas_of: 2026-07-01": {"volatile": False, "freshness": 1782864000.0},
    "description: |\n  one\n  two\ntitle: 'it''s'": {"description": "one\ntwo\n", "title": "it's"},
    "description: >-\n  one\n  two": {"description": "one two"},
    'tags: ["a, b", c]': {"tags": ["a, b", "c"]},
    "title: a: b": {"title": "p", "body": "---\ntitle: a: b\n---\nBODY [[t]]"},
    "title: [": {"title": "p", "body": "---\ntitle: [\n---\nBODY [[t]]"},
    "- a\n- b": {"title": "p", "body": "---\n- a\n- b\n---\nBODY [[t]]"},
    "title: 1.0\ntitle: b": {"title": "p"},
    "title: 12\ntype: null\nsource: true\nresource: 0x10": {"title": "12", "type": None, "source": "true", "resource": "16"},
    "title: a\x85b \u2028c # note": {"title": "a\x85b \u2028c"},
    "updated: soon\nauthored: 2024-03-05T10:00:00+02:00": {"freshness": None, "authored": 1709625600.0},
    "": {"title": "p", "body": "BODY [[t]]"},
    "edges:\n  - type: Part_Of\n    target: x\n    weight: 0.5\n  - {target: y}\n  - {type: part-of, target: x}\n  - {type: a}\n  - z\n  - {type: related_to, target: t}\nsources: ['[[s.md|S]]', plain]\npeople: ['[[ann]]']": {
        "edges": [("Part_Of", "x", 0.5), ("related_to", "y", None), ("related_to", "t", None), ("cites", "s", None), ("mentions", "ann", None)]},
}


def test_headers(spark):
    texts = [f"---\n{h}\n---\nBODY [[t]]" if h else "---\n---\nBODY [[t]]" for h in HEADERS]
    df = spark.createDataFrame([(f"d{i}/p.md", t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), ("n.md", None, 1), ("e/.md", "", 1)], "path string, text string, tags int")
    got = {r["path"]: r for r in markdown.items(df.select("path", "text")).collect()}
    assert len(got) == len(HEADERS) + 1 and got["e/.md"]["body"] == ""
    for i, (h, want) in enumerate(HEADERS.items()):
        row = got[f"d{i}/p.md"].asDict()
        row["edges"] = [tuple(e) for e in row["edges"]]
        assert {k: row[k] for k in want} == want, h


def test_resolved_items_and_tree(spark):
    pages = [("a/one.md", "[[two]] [[uno]] [[c/x]]"), ("b/two.md", "---\naliases: [uno, ' dos.md ']\n---\n"), ("in_x/three.md", "[[dos]] [[three]]"), ("dist/four.md", "[[two]]"), (".g/x.md", "y"), ("top.md", ""), ("a/pic.png", "")]
    df = spark.createDataFrame(pages, "path string, text string")
    got = {r["id"]: [(e["type"], e["target"]) for e in r["edges"]] for r in markdown.resolved_items(df).collect()}
    assert got["a/one"] == [("related-to", "b/two"), ("related-to", "b/two"), ("related-to", "c/x")] and got["in_x/three"] == [("related-to", "b/two"), ("related-to", "in_x/three")]
    assert "dist/four" not in got and got["top"] == []
    level = {tuple(r) for r in markdown.tree(df).collect()}
    assert level == {("folder", "a", "a", "wiki"), ("folder", "b", "b", "wiki"), ("folder", "in_x", "in_x", "incoming"), ("folder", "dist", "dist", "wiki"), ("page", "top.md", "top.md", None)}
    assert [tuple(r) for r in markdown.tree(df, "a/").collect()] == [("page", "one.md", "a/one.md", None)]
    assert [r["path"] for r in markdown.scan_first(df, 2).collect()] == [".g/x.md", "a/one.md"]


@pytest.mark.parametrize("rows", [2, 1_000_000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, rows, how):
    a = spark.createDataFrame([("hot", i) for i in range(9)] + [("hot", 1)] * 3 + [(None, i) for i in range(5)] + [("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("hot", "h"), ("x", "x"), (None, "n"), ("z", "z")], "k string, w string")
    assert sorted(map(str, spread_join(a, b, "k", how, rows).collect())) == sorted(map(str, a.join(b, "k", how).collect()))


def test_resolution(spark):
    pages = spark.createDataFrame([("x/one",), ("x/two",), ("y/two",)], "id string")
    aliases = markdown.alias_map(spark.createDataFrame([("e/1", ["uno", "two", "dup"]), ("e/2", ["dup", "a/b"])], "id string, aliases array<string>"))
    edges = spark.createDataFrame([("s", t) for t in ("one", "two", "uno", "dup", "a/b", "none")], "source string, target string")
    got = {r["target"]: r["resolved"] for r in markdown.resolve_targets(edges, markdown.basename_map(pages), aliases).collect()}
    assert got == {"one": "x/one", "two": "two", "uno": "e/1", "dup": "dup", "a/b": "a/b", "none": "none"}


def test_publish_and_stream(spark, tmp_path):
    root, src = str(tmp_path / "store"), str(tmp_path / "in")
    one = spark.createDataFrame([(1, "a", "old", "ann"), (2, "b", "b", "bob")], "item_seq long, id string, title string, write_actor string").withColumn("received_at", F.current_timestamp())
    one.coalesce(1).write.parquet(src)
    run = lambda: ingest.ingest(ingest.read_items(spark, src, one.schema), root, str(tmp_path / "cp")).awaitTermination()
    run()
    one.filter("id = 'a'").withColumn("title", F.lit("new")).withColumn("item_seq", F.lit(9).cast("long")).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {(r["id"], r["title"]) for r in store.open_table(spark, root, "items").collect()} == {("a", "new"), ("b", "b")}
    now = store.read_pointer(spark, root)
    assert not store.publish(spark, root, {"items": one}, now["generation"])


def test_late_deliveries_do_not_replace_newer_ones(spark, tmp_path):
    root, src = str(tmp_path / "store"), str(tmp_path / "in")
    rows = lambda *x: spark.createDataFrame([(n, i, t, "ann", datetime(2024, 1, d)) for n, i, t, d in x], "item_seq long, id string, title string, write_actor string, received_at timestamp").coalesce(1)
    one = rows((1, "a", "first", 5), (2, "b", "b", 5))
    run = lambda: ingest.ingest(ingest.read_items(spark, src, one.schema), root, str(tmp_path / "cp"), 4).awaitTermination()
    one.write.parquet(src)
    run()
    before = store.read_pointer(spark, root)["tables"]["items"]["folders"]
    rows((3, "a", "late", 1), (4, "c", "c", 9)).write.mode("append").parquet(src)
    run()
    assert {(r["id"], r["title"]) for r in store.open_table(spark, root, "items").collect()} == {("a", "first"), ("b", "b"), ("c", "c")}
    after = store.read_pointer(spark, root)["tables"]["items"]["folders"]
    touched = {str(r[0]) for r in spark.createDataFrame([("a",), ("c",)], "id string").select(store.bucket(F.col("id"), 4)).collect()}
    assert all(after[b] == f for b, f in before.items() if b not in touched)


def test_collection_of_old_generations():
    made = {"g1": 0.0, "g2": 100.0, "g3": 140.0}
    keep = lambda readers, now=150.0, **more: store.collectable(made, "g3", "g2", readers, now, **more)
    assert keep({}) == ["g1", "g2"]  # nobody reads
    assert keep({"r": ("g3", 149.0)}) == ["g1"]  # g2 is younger than the grace
    assert keep({"r": ("g3", 149.0)}, grace=10.0) == ["g1", "g2"]
    assert keep({"r": ("g2", 149.0)}, grace=10.0) == ["g1"]  # a living reader lags
    assert keep({"r": ("g2", 149.0)}, now=2000.0) == ["g1", "g2"]  # a dead one doesn't count
    assert keep({}, used=["g1"]) == ["g2"]


def test_pointer_is_replaced_and_checked(spark, tmp_path):
    root, df = str(tmp_path), spark.createDataFrame([("a", 1)], "id string, n int")
    assert store.publish(spark, root, {"t": df}, "one")
    with pytest.raises(RuntimeError):
        store.publish(spark, root, {"t": df}, "two", check=lambda m: False)
    assert store.read_pointer(spark, root)["generation"] == "one"
    assert store.publish(spark, root, {"t": df.union(df)}, "three") and store.open_table(spark, root, "t").count() == 2
    assert not [p for p in os.listdir(root) if p.startswith(".generation") and not p.endswith(".crc")]
    gone = store.collect(spark, root, None, {}, 1e12)
    assert len(gone) == 2 and store.open_table(spark, root, "t").count() == 2
    (tmp_path / store.POINTER).write_text("{")
    os.path.exists(tmp_path / f".{store.POINTER}.crc") and os.remove(tmp_path / f".{store.POINTER}.crc")
    assert store.read_pointer(spark, root) is None


def test_old_tables_get_the_later_columns(spark, tmp_path):
    root = str(tmp_path)
    store.publish(spark, root, {"nodes": spark.createDataFrame([("a",)], "id string"), "edges": spark.createDataFrame([("a", "t", "b", 1.0)] * 2, "source string, type string, target string, weight double")}, "g")
    now = store.read_pointer(spark, root) | {"schema": 1}
    assert store.open_table(spark, root, "nodes", now).first().asDict() == {"id": "a", "description": None, "source": None, "authored": None, "write_actor": "unknown"}
    assert store.open_table(spark, root, "edges", now).count() == 1


def test_changed_links_change_the_hash(spark):
    from graphmere.plans import catalogue as C

    pages = spark.createDataFrame([(x, "t", "b") for x in ("w/a", "w/b", "w/c")], "id string, title string, body string")
    schema = "edge_id long, source string, type string, target string, weight double"
    old = spark.createDataFrame([(1, "w/a", "cites", "w/b", 1.0), (2, "w/a", "cites", "w/c", None), (3, "w/b", "cites", "w/a", 1.0)], schema)
    new = spark.createDataFrame([(0, "w/a", "cites", "w/c", 1.0), (1, "w/a", "cites", "w/b", None), (0, "w/b", "cites", "w/c", 1.0)], schema)
    got = {r["id"]: r["status"] for r in M.classify(C._hashed(pages, new), C._hashed(pages, old)).collect()}
    assert got == {"w/a": "unchanged", "w/b": "changed", "w/c": "unchanged"}
