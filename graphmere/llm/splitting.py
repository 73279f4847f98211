"""Oversized pages cut into overlapping pieces at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1800, 200
_SPACE = re.compile(r"\s+(?=\S)")

#: Boundaries by strength: blank line, line, sentence; finer ones only inside what is still too long.
_COARSE = re.compile(r"(?P<b4>\n[ \t\r]*\n\s*)|(?P<b3>\r?\n)|(?P<b2>(?:(?<!\n\d)(?<!\n\d\d)[.!?…]+[\"'”’»)\]]*[ \t]+(?![ \t\r\n]))|[。！？]+[」』”]*)")
_FINE = (re.compile(r"[,;:、；：，][ \t]*|[ \t][–—-][ \t]"), re.compile(r"\s+"))


def _atoms(text: str, room: int) -> list[tuple[int, int]]:
    """(end, strength of the boundary there) of the atomic segments, none longer than ``room``."""
    out: list[tuple[int, int]] = []

    def add(a: int, b: int, strength: int, level: int) -> None:
        if b - a <= room:
            out.append((b, strength))
        elif level < len(_FINE):
            last = a
            for m in _FINE[level].finditer(text, a, b):
                if last < m.end() < b:
                    add(last, m.end(), 1 - level, level + 1)
                    last = m.end()
            add(last, b, strength, level + 1)
        else:  # no boundary inside: hard cuts
            for x in range(a + room, b, room):
                out.append((x, -1))
            out.append((b, strength))

    last = 0
    for m in _COARSE.finditer(text):
        if m.end() < len(text):
            add(last, m.end(), int(m.lastgroup[1]), 0)
            last = m.end()
    add(last, len(text), 5, 0)
    return out


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``; a piece starts up to ``overlap`` before the last one's end.

    Adjacent segments wait in a heap by the strength of the boundary between them; the weakest is merged first
    while both sides and the overlap fit the limit. A text within the limit is one piece.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    room = limit - overlap
    atoms = _atoms(text, room)
    n = len(atoms)
    start = [0, *(e for e, _ in atoms[:-1])]
    ends = [e for e, _ in atoms]
    end, edge = ends.copy(), [s for _, s in atoms]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(edge[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1) if end[i + 1] - start[i] <= room]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - start[i] != size:
            continue
        end[i], edge[i], alive[j], after[i] = end[j], edge[j], False, after[j]
        if (k := after[j]) < n:
            before[k] = i
            if (s := end[k] - start[i]) <= room:
                heapq.heappush(heap, (edge[i], s, i, k))
        if (k := before[i]) >= 0 and (s := end[i] - start[k]) <= room:
            heapq.heappush(heap, (edge[k], s, k, i))
    out, prior = [], -1
    for i in range(n):
        if alive[i]:
            out.append((start[i] if prior < 0 else _overlap_start(text, ends, start[prior], start[i], overlap), end[i]))
            prior = i
    return out


def _overlap_start(text: str, ends: list[int], first: int, at: int, overlap: int) -> int:
    """Where a piece begins that shares up to ``overlap`` with the one before it, at a boundary if there is one."""
    low = max(first + 1, at - overlap)
    i = bisect_left(ends, low)
    if i < len(ends) and ends[i] < at:
        return ends[i]
    m = _SPACE.search(text, low, at)
    return m.end() if m else at if text[low:at].isspace() else low


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["id"], batch["content"]):
                prior = 0
                for ord_, (a, b) in enumerate(split_points(t, limit, overlap)):
                    rows.append((i, ord_, t[a:b], max(0, prior - a)))
                    prior = b
            yield pd.DataFrame(rows, columns=["id", "ord", "text", "shared"])

    return run


def oversized_pages(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, content) of the pages over ``limit`` characters in their latest row.

    The latest row has the greatest (indexed_at, row_no); a null indexed_at is the oldest. Only keys and
    oversized texts are shuffled.
    """
    latest = nodes.groupBy("id").agg(F.max(F.struct("indexed_at", "row_no")).getField("row_no").alias("row_no"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    long_ = nodes.select("row_no", "id", text.alias("content")).filter(F.length("content") > limit)
    return long_.join(latest.select("row_no"), "row_no", "left_semi").select("id", "content")


def split_pages(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, ord, text, shared): pieces of at most ``limit`` code points of every oversized page.

    Pieces cover the page in order; ``shared`` is how many characters a piece has in common with the one before
    it, at most ``overlap``. Null titles and bodies are empty, pages within the limit and empty ones give no
    piece, a text without any boundary is cut hard, repeated rows of a page give one result, a null id is a page
    of its own, further columns are ignored, an empty table gives an empty result.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    return oversized_pages(nodes, limit).mapInPandas(_pieces(limit, overlap), "id string, ord int, text string, shared int")
