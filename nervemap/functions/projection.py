"""Seeded random projections as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from nervemap.functions.vectors import dot


class Projection:
    """Multiplies vectors of ``src`` components by a matrix of ``dst`` rows."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = np.asarray(matrix, dtype=np.float64)
        self.dst, self.src = self.matrix.shape

    def column(self, v: Column) -> Column:
        rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in self.matrix))
        made = F.transform(rows, lambda row: dot(row, v))
        return F.when(F.size(v) == self.src, made).otherwise(F.raise_error(F.lit(f"a vector doesn't have {self.src} components")).cast("array<double>"))

    def apply(self, v: np.ndarray) -> np.ndarray:
        if v.shape[-1] != self.src:
            raise ValueError(f"a vector doesn't have {self.src} components")
        return v @ self.matrix.T


class GaussianProjection(Projection):
    """Independent standard normal entries."""

    def __init__(self, src: int, dst: int, seed: int = 0):
        super().__init__(np.random.default_rng(seed).standard_normal((dst, src)))

    def mean(self) -> float:
        return float(self.matrix.mean())

    def stddev(self) -> float:
        """The standard deviation proper, the root of the variance."""
        return float(self.matrix.std(ddof=1))


class CauchyProjection(Projection):
    """Independent standard Cauchy entries."""

    def __init__(self, src: int, dst: int, seed: int = 0):
        super().__init__(np.random.default_rng(seed).standard_cauchy((dst, src)))

    def median(self) -> float:
        return float(np.median(self.matrix))

    def estimate(self, a: Column, b: Column) -> Column:
        """The L1 distance of two vectors from their sketches (``column`` of each): the median size of the sketches' differences.

        Each difference is that distance times a standard Cauchy number, whose median size is 1; with m rows about two estimates of three are within
        1.6 / sqrt(m) of the distance.
        """
        sizes = F.array_sort(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
        low, high = (self.dst - 1) // 2, self.dst // 2
        return F.get(sizes, F.lit(low)) if low == high else (F.get(sizes, F.lit(low)) + F.get(sizes, F.lit(high))) / 2
