import pytest

from graphmere.llm.splitting import split_pages, split_points

SCHEMA = "row_no long, id string, title string, body string, indexed_at timestamp, content string, text string, ord int"


def check(text, spans, limit, overlap):
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap


PARAGRAPHS = "\n\n".join(" ".join(f"Sentence {i} of paragraph {p} says little." for i in range(p % 7 + 1)) for p in range(60))


@pytest.mark.parametrize("text", [PARAGRAPHS, "x" * 10_000, "word " * 3000, "。".join("記憶を確認した" * (i % 5 + 1) for i in range(900)), "\n" * 5000, "a\n\n" + "y" * 4000 + "\n\nb " * 800])
def test_pieces_cover_and_fit(text):
    check(text, split_points(text), 1800, 200)
    check(text, split_points(text, 300, 0), 300, 0)


def test_cuts_at_paragraphs():
    for _, end in split_points(PARAGRAPHS, 900, 100)[:-1]:
        assert PARAGRAPHS[:end].endswith("\n\n")


def test_latest_row_decides(spark):
    from datetime import datetime as D

    rows = [
        (1, "a", "t", "x " * 2000, D(2024, 1, 1), "c", "c", 1), (2, "a", "t", "short", D(2024, 2, 1), "c", "c", 1),
        (3, "b", None, "y " * 1000, None, "c", "c", 1), (4, "b", None, "z " * 1500, D(2024, 1, 1), "c", "c", 1), (5, "b", None, "z " * 1600, D(2024, 1, 1), "c", "c", 1),
        (6, "c", None, None, D(2024, 1, 1), None, None, None), (7, None, "n" * 3000, None, D(2024, 1, 1), None, None, None), (8, "d", "e" * 1799, None, D(2024, 1, 1), None, None, None), (9, "f", "e" * 1800, "", D(2024, 1, 1), None, None, None),
    ]
    out = split_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {}
    for r in sorted(out, key=lambda r: (str(r["id"]), r["ord"])):
        text[r["id"]] = text.get(r["id"], "") + r["text"][r["shared"] :]
    assert text == {"b": "\n" + "z " * 1600, None: "n" * 3000 + "\n", "f": "e" * 1800 + "\n"}
    assert split_pages(spark.createDataFrame([], SCHEMA)).count() == 0
