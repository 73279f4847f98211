import random
import re

from graphmere.llm.near_duplicates import duplicate_pairs, near_duplicates

SCHEMA = "item_seq long, title string, body string, item long, rep long, key long"


def runs(title, body):
    w = re.findall(r"[^\W_]+", f"{title or ''}\n{body or ''}".lower())
    return None if len(w) < 20 else frozenset(zip(w, w[1:], w[2:]))


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([19, 20, 40, 120]))]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, rng.choice(["T", None]), " ".join(words), 1, 2, 3))
            n += 1
    rows += [(9000, None, None, None, None, None), (9001, "", "", None, None, None), (9002, "same " * 30, None, None, None, None), (9003, "same " * 40, None, None, None, None), (9004, "t", "long word " * 30_000, None, None, None)]
    sets = {r[0]: s for r in rows if (s := runs(r[1], r[2]))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    links, members = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in duplicate_pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    assert {r["item"] for r in members.collect()} == set(sets)


def test_full_keys_lose_no_pair(spark):
    rng = random.Random(5)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, "T", " ".join(template[: rng.randint(30, 60)] + [f"x{rng.randrange(9999)}" for _ in range(rng.randint(0, 25))]), 1, 2, 3) for i in range(1200)]
    sets = {r[0]: s for r in rows if (s := runs(r[1], r[2]))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, SCHEMA)
    plain, split = ({tuple(r) for r in duplicate_pairs(*near_duplicates(df, full_key=f)).collect()} for f in (10**6, 100))
    assert plain == split and split <= want and len(split) >= 0.99 * len(want)


def test_empty(spark):
    links, members = near_duplicates(spark.createDataFrame([], SCHEMA))
    assert links.count() == members.count() == duplicate_pairs(links, members).count() == 0


def shuffled(spark):
    """(rows, bytes) written to shuffles by each stage so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in map(stages.apply, range(stages.size()))}


def found_and_shuffled(spark, rows, **options):
    """The pairs and what was shuffled for them, where joins are shuffled as those of a large table are."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = shuffled(spark)
    try:
        for name in names:
            spark.conf.set(name, "-1")
        pairs = [tuple(r) for r in duplicate_pairs(*near_duplicates(spark.createDataFrame(rows, SCHEMA), **options)).collect()]
    finally:
        for name in names:
            spark.conf.unset(name)
    assert len(pairs) == len(set(pairs))
    new = [x for s, x in shuffled(spark).items() if s not in before]
    return set(pairs), sum(n for n, _ in new), sum(n for _, n in new)


def test_keys_are_shuffled_once(spark):
    rng = random.Random(6)
    rows = [(i, "T", " ".join(f"x{rng.randrange(9999)}" for _ in range(30)), 1, 2, 3) for i in range(500)]
    rows += [(1000 + i, t, f"{body} one more", a, b, c) for i, t, body, a, b, c in rows[:50]]
    pairs, records, _ = found_and_shuffled(spark, rows)
    assert pairs == {(i, 1000 + i) for i in range(50)}
    # Each record has 40 keys; that the joins need them on both sides must not write them twice.
    assert 40 <= records / len(rows) < 60


def test_sets_are_shuffled_once_and_large_cells_are_cut(spark):
    rng = random.Random(7)
    rows = []
    for k in range(20):
        base = [f"y{rng.randrange(9999)}" for _ in range(600)]
        for _ in range(16):
            words = list(base)
            for _ in range(rng.randint(1, 40)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(9999)}"
            rows.append((len(rows), "T", " ".join(words), 1, 2, 3))
    sets = {r[0]: runs(r[1], r[2]) for r in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    whole, _, written = found_and_shuffled(spark, rows)
    assert whole <= want and len(whole) >= 0.99 * len(want)
    # 320 sets of about 5 kB; the pairs are about 2,400.
    assert written < 1.5 * sum(8 * len(s) for s in sets.values())
    for most in (3000, 10):  # some parts of a cell; each pair in a cell of its own
        assert found_and_shuffled(spark, rows, cell_hashes=most)[0] == whole
