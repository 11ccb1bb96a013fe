"""Bounded samples and small linear models for the text classifiers of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of the smallest hashes of the key: the same ones on every run."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def thinned(rows: DataFrame, key: Column, expected: int, total: int) -> DataFrame:
    """About `expected` of `total` rows, by hash, without a shuffle."""
    if total <= expected:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("thin")), F.lit(1 << 30)) < int(expected / total * (1 << 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Adam:
    """Steps of first-order descent with per-parameter rates."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, x: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
