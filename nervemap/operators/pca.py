"""Principal components by block power iteration over distributed products: nothing larger than components x dimensions stands in one place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nervemap.functions.vectors import as_array, dot
from nervemap.operators.neighbors import matrix_of
from nervemap.runtime import importable, materialize, trimmed

#: Directions that are followed beside those asked for: the more, the fewer rounds.
BESIDE = 10


@dataclass(frozen=True)
class PrincipalComponents:
    """``components``: a row for each, of length 1, its component of largest size positive; ``variance``: of the rows along it; ``total``: of all."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    total: float
    rounds: int

    def column(self, v: Column) -> Column:
        """The coordinates of a vector along the components, from the mean; null for null."""
        lists = lambda x: F.array(*(F.lit(float(y)) for y in x))
        centred = F.zip_with(v, lists(self.mean), lambda a, b: a - b)
        return F.when(v.isNotNull(), F.transform(F.array(*map(lists, self.components)), lambda row: dot(row, centred)))


def _sums(table: DataFrame, run, size: int) -> np.ndarray:
    """The sum over all tasks of ``run`` of each batch's matrix; a row an entry that isn't zero goes through the shuffle, one a task at most."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += run(matrix_of(pa.chunked_array([batch["v"]]))).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "x"])

    out = np.zeros(size)
    for r in table.mapInArrow(trimmed(part), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toLocalIterator():
        out[r["at"]] = r["x"]
    return out


def principal_components(df: DataFrame, vec_col: str, k: int, rounds: int = 100, tolerance: float = 1e-11, seed: int = 0) -> PrincipalComponents:
    """The k directions of greatest variance. Rows with a null vector are left out; vectors that differ in length fail the query.

    A round is a pass over the rows that multiplies them by their products with the directions so far; it ends when no variance changes by more
    than ``tolerance`` of the largest.
    """
    importable(df.sparkSession)
    table = materialize(df.select(as_array(df, vec_col).alias("v")).where("v is not null"), "vectors")
    n, d = table.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not 0 < k <= d:
        raise ValueError("there are fewer rows or dimensions than that")
    mean = _sums(table, lambda x: x.sum(axis=0), d) / n
    total = float(_sums(table, lambda x: ((x - mean) ** 2).sum(axis=0), d).sum()) / max(1, n - 1)
    wide = min(d, k + BESIDE)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0]
    last, made = np.zeros(wide), 0
    for made in range(1, rounds + 1):
        y = _sums(table, lambda x, q=q: (x - mean).T @ ((x - mean) @ q), d * wide).reshape(d, wide) / max(1, n - 1)
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found = q @ turn
        if np.abs(values[:k] - last[:k]).max() <= tolerance * max(values[0], 1e-300) or wide == d:
            break
        last, q = values, np.linalg.qr(y @ turn)[0]
    rows = found[:, :k].T
    sign = np.sign(rows[np.arange(k), np.abs(rows).argmax(axis=1)])
    return PrincipalComponents(mean, rows * sign[:, None], np.maximum(values[:k], 0.0), total, made)
