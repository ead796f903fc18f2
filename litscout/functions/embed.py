"""Text embedding (S24): any function from texts to vectors; the one here needs no model.

``HashingEmbedder`` is a stand-in for tests and for runs without a model: signed hashed words, scaled to length 1.
It finds shared words, not shared meaning, and is no replacement for a sentence model.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray:
        """A row of float32 for each text, of length 1."""


class HashingEmbedder:
    def __init__(self, dims: int = 64):
        self.dims, self.name = dims, f"hashing-{dims}"

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = xxhash.xxh3_64_intdigest(word)
                out[i, h % self.dims] += 1 if h >> 63 else -1
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)).astype(np.float32)


def embed(df: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """``df`` with an ``embedding`` of its text column, in Arrow batches; the embedder goes to each task once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(embedding=list(embedder.encode(pdf[text].tolist())))

    return df.mapInPandas(run, df.schema.simpleString()[len("struct<") : -1] + ",embedding:array<float>")
