"""Vector arithmetic on array columns.

Spark has no built-in vector functions; whole columns of pairs go through an
Arrow-batched function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of two vectors; 0 if either is null, empty or zero. The product runs to the shorter length, the norms are whole."""
    none = np.zeros(0)
    xs, ys = ([none if v is None else v for v in c] for c in (a, b))
    sizes = np.array([(len(x), len(y)) for x, y in zip(xs, ys, strict=True)]).reshape(-1, 2)
    out = np.zeros(len(sizes))
    # pairs of equal lengths are multiplied together
    for m, n in np.unique(sizes, axis=0):
        if not min(m, n):
            continue
        rows = np.flatnonzero((sizes == (m, n)).all(1))
        x, y = (np.array([c[i] for i in rows], np.float64) for c in (xs, ys))
        k = min(m, n)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        out[rows] = np.where(norm > 0, np.einsum("ij,ij->i", x[:, :k], y[:, :k]) / np.where(norm > 0, norm, 1), 0)
    return pd.Series(out)


def unit(c: Column) -> Column:
    """From [-1, 1] to [0, 1], clipped."""
    return (F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)) + 1) / 2
