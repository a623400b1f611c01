"""Exact nearest neighbours within groups, and the similarity self-joins built on them.

Rows of a group are dealt into blocks, and each pair of blocks is one unit of work, seen once for both directions, that yields k rows a
point at most; so a group of any size spreads over tasks, a task holds one unit at a time, and no pair of rows is ever shuffled. In a unit tiles of
distances are held one after another against the k least so far. Where the measure allows, a matrix product or sums in single precision bound
them and only those that can be among the k least are added up component by component. Ties go to the smaller id. Large groups of dense vectors are searched by their
euclidean distance in strips (``strips``), from which no more than k rows a point come.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nervemap.functions.sparse import is_sparse
from nervemap.functions.vectors import as_array, measure_name, of_pairs, pairwise
from nervemap.operators.strips import strip_nearest
from nervemap.runtime import MOST_PARTITIONS, dealt, importable, materialize, partitions, trimmed_group

#: Points of a block, and blocks of a group up to which they have that many; bytes of the vectors of a larger one's, and components up to which sparse ones are taken for dense.
BLOCK, FEW, BLOCK_BYTES, NARROW = 2048, 12, 16 << 20, 4096
#: Rows and columns of the distances that a unit of two blocks holds at once; pairs that are summed at once.
TILE, CACHED = (512, 2048), 65_536
#: Points of a group from which strips are passed rather than units made, where that is possible.
LARGE = 8_192
#: Rows of a partition of units; bytes of a row that is found, with what sorts it.
ROWS, FOUND_BYTES = 65_536, 96
#: Which of two blocks a row of a unit belongs to; a block that meets itself is both.
LEFT, RIGHT, BOTH = range(3)
_OUT = "g string, i long, j long, value double"
Predicate = Callable[[np.ndarray, np.ndarray], np.ndarray]


def matrix_of(v: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows. All must be of one length, and none null. Of sparse ones there are columns only for the indices that any of them has."""
    rows = v.combine_chunks()
    if rows.null_count:
        raise ValueError("a vector is null")
    if pa.types.is_struct(rows.type):
        size, indices, values = (pc.struct_field(rows, c) for c in ("size", "indices", "values"))
        if len(rows) and pc.min(size) != pc.max(size):
            raise ValueError("vectors differ in length")
        names, at = np.unique(indices.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        out = np.zeros((len(rows), len(names)))
        out[np.repeat(np.arange(len(rows)), indices.value_lengths().to_numpy(zero_copy_only=False)), at] = values.flatten().to_numpy(zero_copy_only=False)
        return out
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1) if len(sizes) and sizes[0] else np.zeros((len(sizes), 0))


def in_units(points: DataFrame, block: int | None = None) -> DataFrame:
    """The first of ``counted_units``."""
    return counted_units(points, block)[0]


def counted_units(points: DataFrame, block: int | None = None) -> tuple[DataFrame, int]:
    """``points`` (g, id, ...) with l, r and side: a row for each unit that a point belongs to, which are as many as its group has blocks; and the number of rows.

    A group is cut into blocks of ``BLOCK`` points up to ``FEW`` of them, and beyond into blocks of at most ``block`` (``BLOCK``) points. Units are dealt into
    partitions of about ``ROWS`` rows, however few partitions the session has, so that what a task holds doesn't grow with the table.
    """
    count = F.count(F.lit(1))
    n = F.greatest(F.ceil(count / (block or BLOCK)), F.least(F.ceil(count / BLOCK), F.lit(FEW))).cast("int")
    sizes = materialize(points.groupBy("g").agg(count.alias("c"), n.alias("n")), "groups")
    sent = sizes.agg(F.sum(F.col("c") * F.col("n"))).first()[0] or 0
    parts = min(MOST_PARTITIONS, max(partitions(points.sparkSession), sent // ROWS))
    own = points.join(sizes.select("g", "n"), "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("b") == F.col("o"), BOTH).when(F.col("b") < F.col("o"), LEFT).otherwise(RIGHT)
    return met.withColumns({"l": F.least("b", "o"), "r": F.greatest("b", "o"), "side": side}).drop("n", "b", "o").repartition(parts, "g", "l", "r"), sent


def _least(d: np.ndarray, i: np.ndarray, j: np.ndarray, allowed: np.ndarray, k: int, slack: np.ndarray | None, exact: Callable) -> tuple[np.ndarray, ...]:
    """(i, j, value) of the k least of each row of d among those allowed. With ``slack``, d is within it of a number that orders as the distances do."""
    ranked = np.where(allowed, d, np.inf)
    keep = min(k, d.shape[1])
    cut = np.partition(ranked, keep - 1, axis=1)[:, keep - 1]
    if slack is not None:
        cut = cut + 2 * slack
    a, b = np.nonzero(allowed & (d <= cut[:, None]))
    value = d[a, b] if slack is None else exact(a, b)
    order = np.lexsort((j[b], value, a))
    a, b, value = a[order], b[order], value[order]
    top = np.arange(len(a)) - np.searchsorted(a, a) < k
    return i[a[top]], j[b[top]], value[top]


def _bounded(measure: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Numbers that order as the distances do, by a matrix product, and how far they can be off, by row and by column; None if the measure has none."""
    if measure not in ("euclidean", "cosine") or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return None
    p, q = (x * x).sum(axis=1), (y * y).sum(axis=1)
    off = 32 * np.finfo(np.float64).eps * max(4, x.shape[1])
    if measure == "euclidean":
        d = p[:, None] + q[None, :] - 2 * (x @ y.T)
        return d, off * (p + q.max(initial=0)), off * (q + p.max(initial=0))
    if not (p.min(initial=1) > 1e-200 and q.min(initial=1) > 1e-200 and max(p.max(initial=0), q.max(initial=0)) < 1e200):
        return None
    d = -np.abs((x / np.sqrt(p)[:, None]) @ (y / np.sqrt(q)[:, None]).T)
    return d, np.full(len(x), off), np.full(len(y), off)


def _near_manhattan(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """What ``_bounded`` gives, by sums in single precision, a few rows at a time so that they stay in the processor's cache."""
    p, q = np.abs(x).sum(axis=1), np.abs(y).sum(axis=1)
    if not max(p.max(initial=0), q.max(initial=0)) < 1e30:
        return None
    s, t = x.T.astype(np.float32, order="C"), y.T.astype(np.float32, order="C")
    out = np.zeros((len(x), len(y)), np.float32)
    step = max(1, CACHED // max(1, len(y)))
    room = np.empty((step, len(y)), np.float32)
    for lo in range(0, len(x), step):
        total = out[lo : lo + step]
        d = room[: len(total)]
        for a, b in zip(s[:, lo : lo + step], t, strict=True):
            np.subtract(a[:, None], b[None, :], out=d)
            np.abs(d, out=d)
            total += d
    off = np.finfo(np.float32).eps * (x.shape[1] + 4)
    least = 1e-30 * (x.shape[1] + 1)  # numbers too small for single precision
    return out, off * (p + q.max(initial=0)) + least, off * (q + p.max(initial=0)) + least


class _Best:
    """The k least (distance, id) of each row of one side of a unit, which meets the other side a tile at a time, in the order of its ids."""

    def __init__(self, n: int, k: int):
        self.value, self.id = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.high = np.full((n, k), np.inf)  # what the tiles' number of each can be at most

    def meet(self, start: int, d: np.ndarray, slack: np.ndarray | None, j: np.ndarray, exact: Callable, turned: bool = False) -> None:
        """``d``: numbers of the rows (if ``turned``, columns) from ``start`` on and the ids ``j``, infinite for pairs that don't count; they are the distances, or within
        ``slack`` of numbers that order like them."""
        n, met = d.shape[::-1] if turned else d.shape
        at = slice(start, start + n)
        k = self.value.shape[1]
        off = 0.0 if slack is None else slack
        cut = self.high[at].max(axis=1) + off
        new = np.flatnonzero(np.isinf(cut))
        if len(new) and met >= k:
            cut[new] = np.partition(np.ascontiguousarray(d[:, new].T) if turned else d[new], k - 1, axis=1)[:, k - 1] + 2 * (off if slack is None else slack[new])
        # of equal distances the earlier ids stay, and nothing is nearer than 0
        last = self.value[at, -1]
        if slack is None:
            full = np.isfinite(last)
            cut[full] = np.nextafter(last[full], -np.inf)
        else:
            cut[last == 0] = -np.inf
        most = np.finfo(d.dtype).max
        cut = np.minimum(cut, most).astype(d.dtype)
        if d.dtype != np.float64:  # rounded up
            with np.errstate(over="ignore"):
                cut = np.minimum(np.nextafter(cut, np.array(np.inf, d.dtype)), most)
        chosen = np.flatnonzero(d <= (cut[None, :] if turned else cut[:, None]))
        if not len(chosen):
            return
        number = d.reshape(-1)[chosen].astype(np.float64)
        a, b = np.divmod(chosen, d.shape[1])
        if turned:
            a, b = b, a
        value = number if slack is None else exact(a, b)
        rows, place = np.unique(a, return_inverse=True)
        own = rows + start
        which = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        values, ids = np.concatenate([self.value[own].ravel(), value]), np.concatenate([self.id[own].ravel(), j[b]])
        highs = np.concatenate([self.high[own].ravel(), number if slack is None else number + slack[a]])
        order = np.lexsort((ids, values, which))
        which = which[order]
        order = order[np.arange(len(which)) - np.searchsorted(which, which) < k]  # k of each row
        self.value[own], self.id[own], self.high[own] = (c[order].reshape(-1, k) for c in (values, ids, highs))

    def found(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(np.isfinite(self.value))
        return i[row], self.id[row, place], self.value[row, place]


def _exact(measure: str, x: np.ndarray, y: np.ndarray) -> Callable:
    """Distances of chosen pairs of rows, a bounded number at a time."""
    return lambda a, b: of_pairs(measure, x, y, a, b)


def _unit(k: int, measure: str, with_self: bool, positive: bool, pred: Predicate | None):
    near = {"manhattan": _near_manhattan}.get(measure, lambda x, y: _bounded(measure, x, y))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, side, picked = (table[c].to_numpy() for c in ("id", "side", "picked"))
        v = matrix_of(table["v"])
        left, right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
        i, j, x, y, pi, pj = ids[left], ids[right], v[left], v[right], picked[left], picked[right]
        two = bool((side != BOTH).any())  # blocks: the other direction too
        bounded = not positive and np.isfinite(v).all() and near(v[:0], v[:0]) is not None and _all_bounded(measure, v)
        ones, others = _Best(len(left), k), _Best(len(right), k)
        for lo in range(0, len(left), TILE[0]):
            s = slice(lo, lo + TILE[0])
            for at in range(0, len(right), TILE[1]):
                t = slice(at, at + TILE[1])
                d, *slack = near(x[s], y[t]) if bounded else (pairwise(measure, x[s], y[t]), None, None)
                allowed = None if two or with_self else i[s][:, None] != j[t][None, :]
                if pred is not None or not (pi.all() and pj.all()):
                    first = i[s][:, None] < j[t][None, :]
                    own = i[s][:, None] == j[t][None, :]
                    good = np.where(first, pi[s][:, None], pj[t][None, :])
                    good = (good | own) if with_self else (good & ~own)
                    if pred is not None:
                        good &= np.where(first, pred(x[s][:, None, :], y[t][None, :, :]), pred(y[t][None, :, :], x[s][:, None, :]))
                    allowed = good
                if not bounded:
                    if np.isnan(d if allowed is None else d[allowed]).any():
                        raise ValueError("a distance is not a number of 0 or more")
                    if positive:
                        allowed = d > 0 if allowed is None else allowed & (d > 0)
                if allowed is not None:
                    d = np.where(allowed, d, np.inf)
                ones.meet(lo, d, slack[0], j[t], _exact(measure, x[s], y[t]))
                if two:
                    others.meet(at, d, slack[1], i[s], _exact(measure, y[t], x[s]), True)
        found = [ones.found(i)] + ([others.found(j)] if two else [])
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        g = pa.array([table["g"][0].as_py()] * len(cols[0]) if len(cols[0]) else [], pa.string())
        return pa.table([g, *map(pa.array, cols)], ["g", "i", "j", "value"])

    return run


def _all_bounded(measure: str, v: np.ndarray) -> bool:
    """Whether all rows have numbers that order as the distances do."""
    if measure == "manhattan":
        return bool(np.abs(v).sum(axis=1).max(initial=0) < 1e30)
    size = (v * v).sum(axis=1)
    return measure == "euclidean" and bool(np.isfinite(size).all()) or measure == "cosine" and bool(size.min(initial=1) > 1e-200 and size.max(initial=0) < 1e200)


def _block_of(points: DataFrame) -> int:
    """Points of a large group's block, by their size."""
    if is_sparse(points.schema["v"].dataType):
        size = F.when(F.col("v")["size"] <= NARROW, F.col("v")["size"]).otherwise(BLOCK_BYTES)
    else:
        size = F.size("v")
    return max(BLOCK, BLOCK_BYTES // (8 * max(1, points.agg(F.max(size)).first()[0] or 1)))


def nearest(points: DataFrame, k: int, measure: str = "euclidean", with_self: bool = False, positive: bool = False, pred: Predicate | None = None) -> DataFrame:
    """(g, i, j, value): the k nearest points of the same group to each point.

    points: g string, id long (unique in its group), v array<double>, picked boolean. Of a pair of different points the one of smaller id must be
    picked. ``with_self``: a point is its own neighbour; ``positive``: only distances above 0 count; ``pred``: see ``similarity_join``. Points
    without a vector take no part; vectors of a group that differ in length fail the query.
    """
    measure = measure_name(measure)
    if k < 1:
        raise ValueError("k must be positive")
    importable(points.sparkSession)
    points = materialize(points.where("v is not null").select("g", "id", "v", "picked"), "points")
    if measure == "euclidean" and pred is None and not positive and not is_sparse(points.schema["v"].dataType):
        groups = points.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.max(F.size("v")).alias("dims"), F.bool_and("picked").alias("picked"))
        largest, dims, all_picked = groups.agg(F.max("c"), F.max("dims"), F.bool_and("picked")).first()
        if (largest or 0) > LARGE and all_picked:
            found, times = strip_nearest(points, dims, k, with_self, BLOCK, FEW)
            return found if times < 2 else k_least(found, points.count() * times * k, k)
    units, sent = counted_units(points, _block_of(points))
    found = units.groupBy("g", "l", "r").applyInArrow(trimmed_group(_unit(k, measure, with_self, positive, pred)), _OUT)
    return k_least(found, sent * k, k)


def k_least(found: DataFrame, rows: int, k: int) -> DataFrame:
    """The k smallest (value, j) of each (g, i) of ``found`` (g, i, j, value), which has at most ``rows`` rows."""
    order = Window.partitionBy("g", "i").orderBy("value", "j")
    found = dealt(found, rows, FOUND_BYTES, "g", "i")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def spread_id(id_: Column, seed: int) -> Column:
    """0 to 1000002 from any whole number, by arithmetic alone: (id * 2654435761 + seed) mod 1000003."""
    return F.pmod(F.pmod(id_, F.lit(1000003)) * 2654435761 + F.lit(seed).cast("long"), F.lit(1000003))


def picked(id_: Column, fraction: float, seed: int) -> Column:
    """Whether an id belongs to a sample of the given share, by arithmetic on the id alone."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be within 0 and 1")
    return spread_id(id_, seed) < F.lit(fraction) * 1000003


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k smallest (value, j) of each i."""
    order = Window.partitionBy("i").orderBy("value", "j")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("i", "j", "value")


def similarity_join(
    df: DataFrame, k: int, measure: str = "euclidean", id_col: str = "id", vec_col: str = "vec", pred: Predicate | None = None, fraction: float = 1.0, seed: int = 0
) -> DataFrame:
    """(i, j, value): the k nearest other rows of each row.

    A pair is one of two ids, made once. ``pred`` of the two vectors, that of the smaller id first, must hold; it gets two numpy arrays whose
    last axis holds the components and whose others broadcast against each other, and gives booleans, so that it runs on a whole unit at once.
    ``fraction``: share of rows that may be the smaller id of a pair. Rows with a null id or vector take no part;
    vectors that differ in length fail the query. ``vec_col`` may be sparse (``functions.sparse``): a unit then has columns only for what isn't zero in it.
    """
    sparse = is_sparse(df.schema[vec_col].dataType)
    if sparse and pred is not None:
        raise ValueError("a predicate needs dense vectors")
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(vec_col) if sparse else as_array(df, vec_col)).alias("v"))
    rows = rows.withColumn("picked", picked(F.col("id"), fraction, seed))
    return nearest(rows.withColumn("g", F.lit("")), k, measure, pred=pred).select("i", "j", "value")
