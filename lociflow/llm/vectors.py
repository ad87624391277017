"""What the two vector operators share: which vectors count, samples, k-means, bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that a model is fitted on, at most (those with the smallest hashes of id).
SAMPLE = 20_000


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def sample(rows: DataFrame, id_col: str, vec_col: str, limit: int = SAMPLE) -> np.ndarray:
    """At most `limit` vectors of the commonest length among those drawn, as doubles."""
    got = rows.select(F.xxhash64(F.lit(5), id_col).alias("h"), F.col(vec_col).cast("array<double>").alias("v")).orderBy("h", "v").limit(limit).collect()
    if not got:
        return np.zeros((0, 1))
    sizes = np.bincount([len(r.v) for r in got])
    return np.array([r.v for r in got if len(r.v) == int(sizes.argmax())], np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the closest centre to each row, in blocks of bounded size."""
    own, step = (centres * centres).sum(1), max(1, (1 << 22) // len(centres))
    parts = [(own - 2 * x[lo : lo + step] @ centres.T).argmin(1) for lo in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres after some Lloyd rounds; at most as many as there are points."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c
