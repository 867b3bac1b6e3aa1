"""Vector functions: columns over arrays, and numpy blocks for volume."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

EPSILON = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(d, d))


def _with(a: Column, f) -> Column:
    """struct(v, n): a and f(a), each computed once."""
    return let(a, lambda v: F.struct(v.alias("v"), f(v).alias("n")))


def normalised(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    return let(_with(a, norm), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))))


def rms_normalised(a: Column, weight: Column | None = None) -> Column:
    """Each value over the root mean square, times the weight."""
    scaled = let(_with(a, lambda v: F.sqrt(dot(v, v) / F.size(v) + EPSILON)), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))
    return scaled if weight is None else F.zip_with(scaled, weight, lambda x, w: x * w)


def hash_embedding(text: Column, dimension: int, unit: bool = True) -> Column:
    """A deterministic pseudo-random vector of the text: hashes spread over [-1, 1]. Null where the text is empty."""
    axes = F.sequence(F.lit(0), F.lit(dimension - 1))
    raw = let(F.xxhash64(text), lambda h: F.transform(axes, lambda i: F.xxhash64(h, i).cast("double") / float(1 << 63)))
    v = normalised(raw) if unit else raw
    return F.when(F.length(text) > 0, v)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64) if len(vectors) else np.zeros((0, 0))


METRICS = {
    "cosine": lambda q, v: unit_rows(q) @ unit_rows(v).T,
    "dot": lambda q, v: q @ v.T,
    "euclidean": lambda q, v: -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1) - 2 * q @ v.T, 0)),
}


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)
