import random
from collections import Counter, defaultdict

import pytest

from graphmere.llm.packing import pack_documents, pack_histogram, token_count

SCHEMA = "doc_id long, text string, piece int, tokens int, rank int"


@pytest.mark.parametrize("seed", range(5))
def test_histogram_is_packed_whole_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    counts = Counter(min(64, int(rng.expovariate(1 / 12)) + 1) for _ in range(3000))
    packs = pack_histogram(counts, 64)
    placed = Counter()
    for n, pattern in packs:
        assert n > 0 and sum(x * k for x, k in pattern.items()) <= 64
        for length, each in pattern.items():
            placed[length] += n * each
    assert placed == counts
    bound = -(-sum(x * n for x, n in counts.items()) // 64)
    assert sum(n for n, _ in packs) <= bound * 1.02 + 1


def test_places_do_not_overlap(spark):
    rng = random.Random(1)
    rows = [(i, " a" * rng.choice([0, 1, 1, 1, 3, 7, 20, 33]), 1, 2, 3) for i in range(400)] + [(1, " b" * 50, 0, 0, 0), (401, None, 0, 0, 0)]
    out = pack_documents(spark.createDataFrame(rows, SCHEMA), 16).collect()
    total = defaultdict(list)
    for r in out:
        if r["tokens"]:
            total[r["container"]].append((r["place"], r["place"] + r["tokens"]))
    for spans in total.values():
        spans.sort()
        assert spans[-1][1] <= 16 and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert sum(r["tokens"] for r in out) == sum((r[1] or "").count(" ") for r in rows)
    assert {r["container"] for r in out if not r["tokens"]} == {0}
    assert pack_documents(spark.createDataFrame([], SCHEMA), 16).count() == 0


def test_tokens_are_those_of_the_published_pattern(spark):
    regex = pytest.importorskip("regex")
    pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    texts = ["It's 12 o'clock,  isn't it?\n\n\tYes -- ½ ² ", "", "   ", "日本語 テスト。 a b　c", "x" * 5000, "l’été\r\n\r\n!", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", token_count(rows["t"]).alias("n")).collect()}
    assert got == {i: len(pattern.findall(t or "")) for i, t in enumerate(texts)}
