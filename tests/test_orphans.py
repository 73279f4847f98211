from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphmere.operators import orphans as O
from graphmere.sources import store

EDGES = "edge_id long, source string, type string, target string, weight double, seen_at timestamp, loaded_at timestamp, key string, side string, hi timestamp"
PARENTS = "id string, indexed_at timestamp, removed_at timestamp, key string, lo timestamp"


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def edge(i, source, target, seen, loaded=None):
    return (i, source, "cites", target, None, None if seen is None else day(seen), day(seen + 1 if seen is not None and loaded is None else loaded or 0), "x", "y", None)


def parent(i, a, b=None):
    return (i, day(a), None if b is None else day(b), "x", None)


def brute(edges, parents):
    out = set()
    for e in edges:
        for side, ref in (("source", e[1]), ("target", e[3])):
            key = None if ref is None else ref.split("#")[0].split("|")[0].strip().removesuffix(".md")
            if key and not any(p[0] == key and p[1] <= e[5] and (p[2] is None or e[5] < p[2]) for p in parents if e[5]):
                out.add((e[0], side))
    return out


def test_against_brute_force(spark):
    parents = [parent("a", 0, 10), parent("a", 20), parent("a", 20), parent("b", 5, 5), parent("b", 7), parent("c", 30, 40), parent("c", 35, 60), parent(None, 1)]
    edges = [edge(100 * i + j, s, t, i) for i in range(0, 70, 3) for j, (s, t) in enumerate([("a", "b.md"), (" a#x|y", "c|z"), ("d", None), ("", "  "), ("A", "b\n")])]
    edges += [edge(90001, "a", "c", 36, 0), edge(90002, "c", "c", None, 3)]
    half = len(parents) // 2
    for batches in (1, 4):
        state = O.orphan_state(spark.createDataFrame(edges, EDGES), spark.createDataFrame(parents[:half], PARENTS), spark.createDataFrame(parents[half:], PARENTS), batches=batches)
        assert {(r["edge_id"], r["side"]) for r in state.open.collect()} == brute(edges, parents)
    assert state.snapshots.select("batch").distinct().count() == batches


def test_composed_forms_and_hot_key(spark):
    edges = [edge(i, "café", "hot", i % 50) for i in range(2000)]
    state = O.orphan_state(spark.createDataFrame(edges, EDGES), spark.createDataFrame([parent("café", 0), parent("hot", 25)], PARENTS))
    got = {(r["edge_id"], r["side"]) for r in state.open.collect()}
    assert got == {(i, "target") for i in range(2000) if i % 50 < 25}


def test_late_parent_resolves_and_late_deletion_reopens(spark, tmp_path):
    ref = spark.createDataFrame([(1, "target", "k", day(5))], "edge_id long, side string, key string, seen_at timestamp")
    row = lambda lo, hi: spark.createDataFrame([("k", day(lo), None if hi is None else day(hi))], "key string, lo timestamp, hi timestamp")
    none = row(0, 0).limit(0)
    root = str(tmp_path)
    opened = lambda *x: O.advance(spark, root, *x).open.count()
    assert opened(ref, none, none) == 1
    assert opened(ref.limit(0), row(2, None), none) == 0
    assert opened(ref.limit(0), none, row(2, 4)) == 1
    assert opened(ref.limit(0), row(5, None), none) == 0
    state = O.OrphanState(spark, root)
    assert [r["orphans"] for r in state.snapshots.orderBy("batch").collect()] == [1, 1]
    assert opened(ref, none, row(5, 5)) == 2
    assert state.snapshots.orderBy(F.desc("batch")).first()["orphans"] == 2


def test_a_small_batch_writes_little(spark, tmp_path):
    edges = [edge(i, f"a{i % 90}", f"b{i % 70}", i % 50) for i in range(3000)]
    root, none = str(tmp_path / "s"), spark.createDataFrame([], "key string, lo timestamp, hi timestamp")
    O.orphan_state(spark.createDataFrame(edges, EDGES), spark.createDataFrame([parent(f"a{i}", i % 40) for i in range(90)], PARENTS), root=root)
    files = lambda: {str(p) for p in (tmp_path / "s").rglob("*.parquet")}
    before, held = files(), store.read_pointer(spark, root)
    ref = spark.createDataFrame([(9999, "target", "b3", day(5))], "edge_id long, side string, key string, seen_at timestamp")
    state = O.advance(spark, root, ref, none, none)
    assert before <= files() and state.log("refs").filter("batch = 4").count() == 1
    now = store.read_pointer(spark, root)
    fresh = [f for t in ("refs", "parents") for b, fs in now["tables"][t]["folders"].items() for f in fs if f not in held["tables"][t]["folders"].get(b, [])]
    assert len(fresh) == 1
    # One arriving parent changes its own open references only.
    O.advance(spark, root, ref.limit(0), none.union(spark.createDataFrame([("b3", day(4), None)], none.schema)), none)
    told = state.log("refs").filter("batch = 5").select("key", "orphan", "n").distinct().collect()
    assert [tuple(r) for r in told] == [("b3", False, 0)]


def test_empty(spark):
    e, p = spark.createDataFrame([], EDGES), spark.createDataFrame([], PARENTS)
    assert O.orphan_state(e, p, p).open.count() == 0
    one = spark.createDataFrame([edge(1, "a", "b", 1)] * 2, EDGES)
    assert O.orphan_state(one, p, p).open.count() == 4
