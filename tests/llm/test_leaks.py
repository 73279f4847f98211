import random
import re

from graphmere.llm.leaks import find_leaks, write_index

DOCS = "doc_id long, text string, doc string, item long, word string, pos int"
ITEMS = "item_id long, suite string, text string, w string"


def ws(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["the"] * 10
    items = [(i, "s", " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 12, 13, 20, 30]))), "x") for i in range(25)] + [(90, "s", "", "x"), (91, "s", None, "x"), (92, "s", "?!", "x")]
    docs = []
    for i in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            it = ws(rng.choice(items[:25])[2])
            a = rng.randint(0, max(0, len(it) - 13))
            at = rng.randint(0, len(words))
            words[at:at] = it[a : a + rng.choice([12, 13, 14, 40])]
        docs.append((i, rng.choice([" ", "_", " - "]).join(w.upper() if rng.random() < 0.2 else w for w in words), "d", 1, "w", 1))
    docs += [(200, None, None, None, None, None), (201, "", None, None, None, None), docs[0]]
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect() if r["kind"] == "phrase"}
    want = set()
    for d in docs:
        dw = ws(d[1])
        for it in items:
            iw = ws(it[2])
            n = min(13, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            if any(tuple(dw[i : i + n]) in grams for i in range(len(dw) - n + 1)):
                want.add((d[0], it[0]))
    assert got == want


def test_proximity_and_a_second_set(spark, tmp_path):
    text = "alpha rare1 beta gamma delta epsilon zeta eta theta rare2 iota kappa lambda"
    near = text.replace("gamma delta", "gamma and then delta")
    far = text.replace("gamma delta", "gamma " + "filler " * 9 + "delta")
    docs = [(1, near, "d", 1, "w", 1), (2, far, "d", 1, "w", 1), (3, "x " * 500 + near, "d", 1, "w", 1), (4, text, "d", 1, "w", 1)] + [(10 + i, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "d", 1, "w", 1) for i in range(5)]
    df = spark.createDataFrame(docs, DOCS)
    index = write_index(df, str(tmp_path / "postings"))
    items = spark.createDataFrame([(7, "s", text, "x")], ITEMS)
    got = {tuple(r) for r in find_leaks(df, items, index, slack=3).select("doc_id", "kind").collect()}
    assert got == {(1, "proximity"), (3, "proximity"), (4, "phrase")}
    assert {r["doc_id"] for r in find_leaks(df, items, index).collect()} == {4}
    # Another set over the same index; a plan that reads documents reads the candidates only.
    again = spark.createDataFrame([(8, "s", "filler filler filler", "x")], ITEMS)
    assert {tuple(r)[:3] for r in find_leaks(df, again, index).collect()} == {(2, 8, "phrase")}
    assert index.count() == sum(len(ws(d[1])) for d in docs)


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "s", "a rare phrase", "x")], ITEMS)
    assert find_leaks(d, i).count() == find_leaks(d, one).count() == 0
    long = spark.createDataFrame([(1, "b " * 50_000 + "a rare phrase", None, None, None, None)], DOCS)
    assert find_leaks(long, i).count() == 0 and find_leaks(long, one).count() == 1
