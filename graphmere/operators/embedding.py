"""Embedding models as plain functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmere.functions import text as X

#: How texts are cut before they are embedded; part of the signature.
CHUNKING = "chunk1800o200"


@dataclass(frozen=True)
class Embedder:
    """``passages`` and ``queries`` turn a text column into vectors of length one, of ``dim`` numbers.

    The other fields name the model; an index that was made by a differently named one is not compatible.
    """

    dim: int
    passages: Callable[[Column], Column]
    queries: Callable[[Column], Column]
    name: str | None = None
    revision: str | None = None
    dtype: str | None = None
    pooling: str | None = None
    truncation: int | None = None

    def signature(self) -> str:
        more = (("rev", self.revision), ("dt", self.dtype), ("pool", self.pooling), ("trunc", self.truncation))
        return ":".join([self.name or "e", str(self.dim), *(f"{k}={v}" for k, v in more if v is not None), CHUNKING])


def hashed_words(dim: int = 64, truncation: int = 2000) -> Embedder:
    """A deterministic stand-in for a model: words are hashed to signed places, the sum has length one.

    A text without words has the first unit vector. Texts are cut to ``truncation`` characters, as models do.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        import numpy as np

        for batch in words:
            out = []
            for tokens in batch:
                v = np.zeros(dim, np.float32)
                for t in () if tokens is None else tokens:
                    h = zlib.crc32(t.encode())
                    v[h % dim] += 1.0 if h >> 31 else -1.0
                n = np.linalg.norm(v)
                out.append(v / n if n else np.eye(1, dim, dtype=np.float32)[0])
            yield pd.Series(out)

    embed = lambda text: vectors(X.index_tokens(F.substring(text, 1, truncation)))
    return Embedder(dim, embed, embed, "hashed-words", truncation=truncation)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(page_id, ord, v) of pieces (id, ord, text)."""
    return chunks.select(F.col("id").alias("page_id"), "ord", embedder.passages(F.col("text")).alias("v"))
