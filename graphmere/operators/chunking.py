"""Overlapping windows of page text for embedding."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1800, 200


def window_bounds(text: str, size: int, overlap: int, most: int | None = None) -> list[tuple[int, int]]:
    """(lo, hi) of the windows: at most ``size`` characters that overlap with the next.

    A cut goes back to the last blank if this leaves more than half a window; the next start goes on past a
    partial word. ``most`` ends the list after so many windows.
    """
    out, start, length = [], 0, len(text)
    while most is None or len(out) < most:
        cut = start + size
        if cut >= length:
            out.append((start, length))
            break
        blank = max(text.rfind(c, start, cut) for c in " \n\t")
        if blank - start > size / 2:
            cut = blank
        out.append((start, cut))
        near = cut - overlap
        if near > 0 and not text[near - 1].isspace():
            after = next((i for i in range(near, cut) if text[i].isspace()), None)
            near = near if after is None else after + 1
        start = near
    return out


def _windows(size: int, overlap: int, most: int | None, with_text: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, ords, los, his, texts = [], [], [], [], []
            for ident, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (lo, hi) in enumerate(window_bounds(t, size, overlap, most)):
                    ids.append(ident), ords.append(i), los.append(lo), his.append(hi)
                    if with_text:
                        texts.append(t[lo:hi])
            columns = [pa.array(ids, pa.string()), *(pa.array(x, pa.int32()) for x in (ords, los, his))]
            names = ["id", "ord", "lo", "hi"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=names + ["text"] * with_text)

    return run


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, most: int | None = None, with_text: bool = True) -> DataFrame:
    """(id, ord, lo, hi, text) of title, line feed and body; null counts as empty.

    Whole texts, unless ``most`` limits the windows of one. Pages are cut where they are, in Arrow batches.
    """
    t = pages.select(F.col("id").cast("string").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("t"))
    return t.mapInArrow(_windows(size, overlap, most, with_text), "id string, ord int, lo int, hi int" + ", text string" * with_text)
