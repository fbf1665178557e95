"""Embedding texts with an injected function, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BATCH = 64


def hashed(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed counts of hashed words."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def embedded(df: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], dim: int, batch: int = BATCH, retries: int = 2) -> DataFrame:
    """(key, v, n_words): unit vectors of ``dim`` numbers; a zero vector stays zero; null texts are empty ones.

    The model gets at most ``batch`` texts at once and is asked again up to
    ``retries`` times when it raises; a result of another shape is an error.
    """

    def asked(texts: list[str]) -> np.ndarray:
        for left in range(retries, -1, -1):
            try:
                return np.asarray(model(texts), float)
            except Exception:
                if not left:
                    raise
        raise AssertionError

    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                texts = [t or "" for t in part["text"]]
                v = asked(texts)
                if v.shape != (len(texts), dim):
                    raise ValueError(f"the model gave {v.shape}, not {(len(texts), dim)}")
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(norm > 0, norm, 1)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "v": list(v), "n_words": [len(t.split()) for t in texts]})

    rows = df.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInPandas(run, f"key {kind}, v array<double>, n_words bigint")
    return rows.withColumnRenamed("key", key)
