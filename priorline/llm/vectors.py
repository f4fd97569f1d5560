"""What the operators on embeddings share: usable vectors and bounded samples of them."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, and all components present and finite, not all zero."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(wide, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, id_column: str, vector_column: str, rows: int) -> dict[int, np.ndarray]:
    """At most ``rows`` vectors (those with the smallest hash of their id) as one matrix per dimension."""
    drawn = vectors.select(F.col(vector_column).cast("array<double>").alias("v"), F.xxhash64(id_column).alias("h"))
    found = [r["v"] for r in drawn.orderBy("h").limit(rows).collect()]  # bounded by the parameter
    return {d: np.array([v for v in found if len(v) == d]) for d in Counter(map(len, found))}


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))
