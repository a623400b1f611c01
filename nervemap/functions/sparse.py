"""Sparse vectors as struct columns (size, indices, values, norm), and the five distances of two of them, bit for bit those of the dense vectors.

Indices ascend and values aren't zero. A distance merges the indices of both, so it takes time in proportion to what isn't zero; a
dense sum only adds zeros between, in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.functions.vectors import as_array, measure_name, norm

TYPE = "struct<size:int,indices:array<int>,values:array<double>,norm:double>"


def is_sparse(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"size", "indices", "values"} <= set(kind.names)


def _made(size: Column, indices: Column, values: Column) -> Column:
    """Zeros left out; indices ascend already."""
    kept = F.filter(F.arrays_zip(indices.alias("i"), values.alias("x")), lambda p: p["x"] != 0)
    i, x = F.transform(kept, lambda p: p["i"].cast("int")), F.transform(kept, lambda p: p["x"].cast("double"))
    return F.struct(size.cast("int").alias("size"), i.alias("indices"), x.alias("values"), norm(x).alias("norm"))


def as_sparse(df: DataFrame, name: str) -> Column:
    """A vector column as a sparse one: an ML vector (a sparse one isn't filled up), an array of numbers, or a sparse column. Null stays null."""
    kind = df.schema[name].dataType
    if is_sparse(kind):
        return F.col(name)
    if "VectorUDT" in type(kind).__name__:
        v = F.unwrap_udt(F.col(name))
        dense = v["type"] == 1
        n = F.size(v["values"])
        size = F.when(dense, n).otherwise(v["size"])
        indices = F.when(dense, F.slice(F.sequence(F.lit(0), n), 1, n)).otherwise(v["indices"])
        made = _made(size, indices, v["values"])
    else:
        v = as_array(df, name)
        n = F.size(v)
        made = _made(n, F.slice(F.sequence(F.lit(0), n), 1, n), v)
    return F.when(F.col(name).isNotNull(), made)


def from_pairs(size: int, pairs: Column) -> Column:
    """A sparse column of an array of (index, value) structs in any order; one beyond ``size`` doesn't count; an index that comes twice fails the query."""
    kept = F.map_entries(F.map_filter(F.map_from_entries(pairs), lambda i, _: (i >= 0) & (i < size)))
    ordered = F.array_sort(kept)
    return _made(F.lit(size), F.transform(ordered, lambda p: p["key"]), F.transform(ordered, lambda p: p["value"]))


def to_dense(v: Column) -> Column:
    """The same vector as array<double>."""
    m = F.map_from_arrays(v["indices"], v["values"])
    n = v["size"]
    return F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def _merged(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    """The sum of ``term`` of both vectors' values at each index that either has, in order."""
    steps = F.sequence(F.lit(0), F.size(a["indices"]) + F.size(b["indices"]))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("sum"))

    def step(s: Column, _: Column) -> Column:
        p, q = F.get(a["indices"], s["i"]), F.get(b["indices"], s["j"])
        left, right = F.coalesce(p <= q, p.isNotNull()), F.coalesce(q <= p, q.isNotNull())
        x, y = F.when(left, F.get(a["values"], s["i"])).otherwise(0.0), F.when(right, F.get(b["values"], s["j"])).otherwise(0.0)
        more = F.when(left | right, s["sum"] + term(x, y)).otherwise(s["sum"])
        return F.struct((s["i"] + left.cast("int")).alias("i"), (s["j"] + right.cast("int")).alias("j"), more.alias("sum"))

    return F.aggregate(steps, start, step, lambda s: s["sum"])


def cosine(a: Column, b: Column) -> Column:
    size = a["norm"] * b["norm"]
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(_merged(a, b, lambda x, y: x * y)) / F.when(size != 0, size)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_merged(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: F.abs(x - y))


def _both(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["indices"], b["indices"])).cast("double")


def _either(a: Column, b: Column) -> Column:
    return (F.size(a["indices"]) + F.size(b["indices"])).cast("double") - _both(a, b)


def hamming(a: Column, b: Column) -> Column:
    return _either(a, b) - _both(a, b)


def jaccard(a: Column, b: Column) -> Column:
    union = _either(a, b)
    return F.when(union == 0, F.lit(float("nan"))).otherwise(1.0 - _both(a, b) / F.when(union != 0, union))


_MEASURES = {f.__name__: f for f in (cosine, euclidean, manhattan, hamming, jaccard)}


def sparse_distance(name: str, a: Column, b: Column, strict: bool = True) -> Column:
    """One of the five distances of two sparse columns. If ``strict``, one that isn't 0 or more fails the query, as two vectors of unequal size always do."""
    d = _MEASURES[measure_name(name)](a, b)
    fail = lambda text: F.raise_error(F.lit(text)).cast("double")
    if strict:
        d = F.when((d >= 0) & ~F.isnan(d), d).when(d.isNull(), d).otherwise(fail(f"the {name.lower()} distance is not a number of 0 or more"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a["size"] != b["size"], fail("vectors differ in length")).otherwise(d)
