"""Vectors as arrays of doubles, their supports, and five distances as columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_array(df: DataFrame, name: str) -> Column:
    """A vector column as array<double>: an ML vector, an array of numbers, or a number (an array of one)."""
    kind = df.schema[name].dataType
    if kind.typeName() in ("vector", "udt") or "VectorUDT" in type(kind).__name__:
        from pyspark.ml.functions import vector_to_array

        return vector_to_array(F.col(name))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.col(name).cast("array<double>")
    if isinstance(kind, T.NumericType):
        return F.array(F.col(name).cast("double"))
    raise TypeError(f"column {name} holds {kind.simpleString()}, neither a number nor a vector")


def support(v: Column) -> Column:
    """Indices of the components that aren't zero, ascending."""
    return F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i) != 0)


def binarized(v: Column, threshold: float) -> Column:
    """1 where a component is above the threshold, else 0."""
    return F.transform(v, lambda x: F.when(x > threshold, 1.0).otherwise(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """max(0, 1 - |a.b| / (|a||b|)): opposite vectors are alike. NaN for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(dot(a, b)) / F.when(size != 0, size)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _both(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0)))


def _either(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)))


def hamming(a: Column, b: Column) -> Column:
    """How many indices are in one support only; values don't matter."""
    return _either(a, b) - _both(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """1 - |intersection| / |union| of the supports. NaN if both are empty."""
    union = _either(a, b)
    return F.when(union == 0, F.lit(float("nan"))).otherwise(1.0 - _both(a, b) / F.when(union != 0, union))


MEASURES: dict[str, Callable[[Column, Column], Column]] = {f.__name__: f for f in (cosine, euclidean, manhattan, hamming, jaccard)}


def measure_name(name: str) -> str:
    """The measure's name in lower case; ValueError if there is none."""
    if name.lower() not in MEASURES:
        raise ValueError(f"no distance is called {name}; there are {', '.join(MEASURES)}")
    return name.lower()


def distance(name: str, a: Column, b: Column, strict: bool = True) -> Column:
    """One of the five distances by name, in any case. If ``strict``, a distance that isn't 0 or more fails the query."""
    d = MEASURES[measure_name(name)](a, b)
    if not strict:
        return d
    return F.when((d >= 0) & ~F.isnan(d), d).when(d.isNull(), d).otherwise(F.raise_error(F.lit(f"the {name.lower()} distance is not a number of 0 or more")).cast("double"))


def ertoz(a: Column, b: Column) -> Column:
    """How many neighbours two lists of neighbours share."""
    return F.size(F.array_intersect(a, b))


def pairwise(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of a and of b, added up component by component, as the columns above do, so bit for bit equal."""
    out = np.zeros((len(a), len(b)))
    if name in ("euclidean", "manhattan"):
        for x, y in zip(a.T, b.T, strict=True):
            d = x[:, None] - y[None, :]
            out += d * d if name == "euclidean" else np.abs(d)
        return np.sqrt(out) if name == "euclidean" else out
    if name == "cosine":
        size = []
        for m in (a, b):
            s = np.zeros(len(m))
            for x in m.T:
                s += x * x
            size.append(np.sqrt(s))
        for x, y in zip(a.T, b.T, strict=True):
            out += x[:, None] * y[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1.0 - np.abs(out) / (size[0][:, None] * size[1][None, :])
        return np.where(np.isnan(out), out, np.maximum(out, 0.0))
    p, q = (a != 0).astype(np.float64), (b != 0).astype(np.float64)
    both = p @ q.T
    either = p.sum(axis=1)[:, None] + q.sum(axis=1)[None, :] - both
    if name == "hamming":
        return either - both
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - both / either


def of_pairs(name: str, a: np.ndarray, b: np.ndarray, i: np.ndarray | None = None, j: np.ndarray | None = None, step: int = 1024) -> np.ndarray:
    """The distance of each row of a and the same row of b, or of rows i of a and j of b, added up as in ``pairwise``, few enough at a time to stay in the processor's cache."""
    out = np.zeros(len(a) if i is None else len(i))
    for lo in range(0, len(out), step):
        x, y = (m[lo : lo + step] if at is None else m[at[lo : lo + step]] for m, at in ((a, i), (b, j)))
        here = out[lo : lo + step]
        if name == "euclidean":
            d = x - y
            d *= d
            for s in np.ascontiguousarray(d.T):
                here += s
            np.sqrt(here, out=here)
            continue
        x, y = x.T, y.T
        if name == "manhattan":
            for p, q in zip(x, y, strict=True):
                here += np.abs(p - q)
        elif name == "cosine":
            s, t = np.zeros(len(here)), np.zeros(len(here))
            for p, q in zip(x, y, strict=True):
                here += p * q
                s += p * p
                t += q * q
            here[:] = np.maximum(1.0 - np.abs(here) / (np.sqrt(s) * np.sqrt(t)), 0.0)
        else:
            raise ValueError(f"no bound is used for {name}")
    return out
