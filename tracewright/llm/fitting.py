"""A small logistic regression, and the deterministic bounded samples that models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str) -> Column:
    """Rows that no model may learn from: crc32 of the key's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the least hashes of the key: the same rows on any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25, counts_for: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the intercept), means and scales, by Newton steps on standardised columns.

    ``counts_for``: how many rows each row stands for, where the sampling rates of rows differ.
    """
    share = np.ones(len(x)) if counts_for is None or not len(x) else counts_for / counts_for.mean()
    if len(x):
        mean = np.average(x, axis=0, weights=share)
        scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=share))
    else:
        mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge * max(1, len(x)))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        slope = z.T @ (share * (p - y)) + penalty * w
        curve = (z * (share * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        w = w - np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return w, mean, scale
