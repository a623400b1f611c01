"""Exact nearest neighbours by the euclidean distance in large groups: strips of points that all points of their group pass.

Tasks pack points into rows of some thousand vectors. A strip is a share of a group's points; the packed rows of its group stream past it, so that what its
points have found so far bounds all that follows: few pairs are added up, and k rows a point leave the task. Which pairs can count is said by a matrix product in single
precision, around the strip's mean, and in double precision where that says too little; the distances of those are added up component by component. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nervemap.functions.vectors import of_pairs, pairwise
from nervemap.runtime import MOST_PARTITIONS, TASK_BYTES, dealt_into, materialize, trimmed, trimmed_group

#: Bytes of a strip's vectors; points of a packed row, and bytes of their vectors; bytes of the vectors that pass a strip in one task.
STRIP_BYTES, PIECE, PIECE_BYTES, PASSING_BYTES = 8 << 20, 2048, 1 << 20, 256 << 20
#: Points of a strip that meet a packed row at once; pairs that wait for each of its points, about, before they are ranked.
TILE, WAITING = 512, 4
#: What a packed row is to a strip: some of its points, others that pass, or both.
OWN, PASSES, BOTH = range(3)
_PACKED = "unit long, role int, g string, dims int, single boolean, ids binary, v binary, shown binary"
_FOUND = "g string, i long, j long, value double"


def packed(table: pa.Table, v: np.ndarray, k: int) -> dict:
    """A packed row of points: their ids and vectors, in single precision where that loses nothing, and which of them can be neighbours: of equal vectors those of the k + 1 smallest ids."""
    ids = table["id"].to_numpy()
    with np.errstate(over="ignore", invalid="ignore"):
        short = v.astype(np.float32)
    single = np.array_equal(short, v)
    _, copy = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True) if v.shape[1] else (None, np.zeros(len(v), np.int64))
    order = np.lexsort((ids, copy))
    shown = np.zeros(len(v), bool)
    shown[order] = np.arange(len(v)) - np.searchsorted(copy[order], copy[order]) <= k
    return {"dims": v.shape[1], "single": single, "ids": ids.tobytes(), "v": (short if single else v).tobytes(), "shown": shown.tobytes()}


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, shown) of a packed row."""
    ids = np.frombuffer(row["ids"], np.int64)
    v = np.frombuffer(row["v"], np.float32 if row["single"] else np.float64).reshape(len(ids), row["dims"])
    return ids, v.astype(np.float64), np.frombuffer(row["shown"], bool)


class Strip:
    """The k least (distance, id) of each of some points among those that have passed."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, with_self: bool):
        self.ids, self.v, self.k, self.with_self = ids, v, k, with_self
        self.value, self.id = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.cut = np.full(len(ids), np.inf)  # squares of distances beyond which nothing counts
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        with np.errstate(over="ignore", invalid="ignore"):
            self.mean = v.mean(axis=0)
            self.x = v - self.mean
            self.p = (self.x * self.x).sum(axis=1)
        self.bounded = bool(self.p.max(initial=0) < 1e30)
        if self.bounded:
            self.left = np.concatenate([self.x, self.p[:, None], np.ones((len(v), 1))], axis=1).astype(np.float32)

    def _cut(self, at: slice, d: np.ndarray, off: np.ndarray | float) -> np.ndarray:
        """For each of the rows the number beyond which none of ``d`` counts, which is within ``off`` of the squares of distances."""
        cut = self.cut[at] + off
        new = np.flatnonzero(np.isinf(cut))
        rank = self.k if self.with_self else self.k + 1  # the point itself may be among them
        if len(new) and d.shape[1] >= rank:
            cut[new] = np.partition(d[new], rank - 1, axis=1)[:, rank - 1] + 2 * (off if np.isscalar(off) else off[new])
        return np.minimum(cut, np.finfo(d.dtype).max)

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Points that pass."""
        if v.shape[1] != self.v.shape[1]:
            raise ValueError("vectors differ in length")
        if not len(ids):
            return
        dims = v.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            y = v - self.mean
            q = (y * y).sum(axis=1)
        bounded = self.bounded and bool(q.max() < 1e30)
        if bounded:
            right = np.ascontiguousarray(np.concatenate([-2 * y, np.ones((len(y), 1)), q[:, None]], axis=1).astype(np.float32).T)
            size = self.p + q.max()
            # sums of dims + 2 products of rounded numbers, whose sizes add up to 2 (p + q) at most; and numbers too small for single precision
            off = np.finfo(np.float32).eps * (dims + 8) * size + 1e-35 * (dims + 2)
            room = np.empty((TILE, len(y)), np.float32)
        for lo in range(0, len(self.ids), TILE):
            at = slice(lo, min(lo + TILE, len(self.ids)))
            if not bounded:
                self._all(at, ids, v)
                continue
            d = np.matmul(self.left[at], right, out=room[: at.stop - lo])
            with np.errstate(over="ignore"):
                cut = np.nextafter(self._cut(at, d, off[at]).astype(np.float32), np.float32(np.inf))
            chosen = np.flatnonzero(d <= cut[:, None])
            if len(chosen) > max(d.size // 16, 4 * (self.k + 1) * len(d)):
                d = self.p[at, None] + q[None, :] - 2 * (self.x[at] @ y.T)
                cut = self._cut(at, d, 32 * np.finfo(np.float64).eps * max(4, dims) * size[at])
                chosen = np.flatnonzero(d <= cut[:, None])
            a, b = np.divmod(chosen, len(y))
            self._wait(a + lo, ids[b], of_pairs("euclidean", self.v, v, a + lo, b))
        if self.held > WAITING * len(self.ids) or not np.isfinite(self.cut).all():
            self.rank()

    def _all(self, at: slice, ids: np.ndarray, v: np.ndarray) -> None:
        """By all distances of the rows, where numbers are too large for bounds, or none."""
        d = pairwise("euclidean", self.v[at], v)
        if not self.with_self:
            own = self.ids[at][:, None] == ids[None, :]
            d[own] = np.inf
        if np.isnan(d).any():
            raise ValueError("a distance is not a number of 0 or more")
        last = self.value[at, -1].copy()
        new = np.flatnonzero(np.isinf(last))
        if len(new) and d.shape[1] >= self.k:
            last[new] = np.partition(d[new], self.k - 1, axis=1)[:, self.k - 1]
        a, b = np.nonzero((d <= last[:, None]) & np.isfinite(d))
        self._wait(a + at.start, ids[b], d[a, b])

    def _wait(self, a: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        good = value <= self.value[a, -1]
        if not self.with_self:
            good &= self.ids[a] != j
        self.waiting.append((a[good], j[good], value[good]))
        self.held += int(np.count_nonzero(good))

    def rank(self) -> None:
        """Rank those that wait."""
        if not self.held:
            self.waiting = []
            return
        a, j, value = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.held, k = [], 0, self.k
        rows, place = np.unique(a, return_inverse=True)
        which = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        ids, values = np.concatenate([self.id[rows].ravel(), j]), np.concatenate([self.value[rows].ravel(), value])
        order = np.lexsort((ids, values, which))
        which = which[order]
        order = order[np.arange(len(which)) - np.searchsorted(which, which) < k]  # k of each row
        self.value[rows], self.id[rows] = values[order].reshape(-1, k), ids[order].reshape(-1, k)
        self.cut[rows] = self.value[rows, -1] ** 2 * (1 + 1e-15 * (self.v.shape[1] + 8))

    def found(self, g: str) -> Iterator[pa.RecordBatch]:
        self.rank()
        row, place = np.nonzero(np.isfinite(self.value))
        for lo in range(0, len(row), 1 << 16):
            r, p = row[lo : lo + (1 << 16)], place[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(r), pa.string()), *map(pa.array, (self.ids[r], self.id[r, p], self.value[r, p]))], ["g", "i", "j", "value"])


def _passing(k: int, with_self: bool):
    """Packed rows by unit, a strip's own first, to what its points find."""

    def strip_of(own: list[dict]) -> Strip:
        if len({r["dims"] for r in own}) > 1:
            raise ValueError("vectors differ in length")
        parts = [unpacked(r) for r in own]
        return Strip(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k, with_self)

    def meet(strip: Strip, row: dict) -> None:
        ids, v, shown = unpacked(row)
        strip.meet(ids[shown], v[shown])

    def begun(own: list[dict]) -> Strip:
        strip = strip_of(own)
        for r in own:
            if r["role"] == BOTH:
                meet(strip, r)
        return strip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, g, own, strip = None, None, [], None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(n)[at].as_py() for n, c in enumerate(batch.schema.names)}
                if row["unit"] != unit:
                    if own:
                        yield from (begun(own) if strip is None else strip).found(g)
                    unit, g, own, strip = row["unit"], row["g"], [], None
                if row["role"] != PASSES:
                    own.append(row)
                elif own:  # hashes may have given a strip no points
                    if strip is None:
                        strip = begun(own)
                    meet(strip, row)
        if own:
            yield from (begun(own) if strip is None else strip).found(g)

    return run


def strip_nearest(points: DataFrame, dims: int, k: int, with_self: bool, least: int, few: int) -> tuple[DataFrame, int]:
    """(g, i, j, value) of the k nearest by the euclidean distance to each of ``points`` (g, id, v array<double> of at most ``dims``), and in how many pieces points pass at most: beyond one, a point has k rows of each.

    A group of up to ``few`` times ``least`` points has strips of ``least``, larger ones have larger strips.
    """
    from nervemap.operators.neighbors import matrix_of

    wide = 8 * max(1, dims)
    most, piece, passing = max(least, STRIP_BYTES // wide), min(PIECE, max(64, PIECE_BYTES // wide)), max(least, STRIP_BYTES // wide, PASSING_BYTES // wide)
    count = F.count(F.lit(1))
    strips = F.greatest(F.ceil(count / most), F.least(F.ceil(count / least), F.lit(few))).cast("int")
    sizes = points.groupBy("g").agg(count.alias("c"), strips.alias("n"), F.ceil(count / passing).cast("int").alias("m"))
    sizes = materialize(sizes.withColumn("rows", F.ceil(F.col("c") / F.col("n") / piece).cast("int")), "groups")
    earlier = F.coalesce(F.sum(F.col("n") * F.col("m")).over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a group
    units, times, rows = sizes.agg(F.sum(F.col("n") * F.col("m")), F.max("m"), F.sum("c")).first()
    parts = max(1, min(MOST_PARTITIONS, units or 0))
    keyed = points.select("g", "id", "v").join(sizes.select("g", "n", "m", "rows", earlier.alias("first")), "g")
    keyed = keyed.withColumns({"b": F.pmod(F.xxhash64("id"), F.col("n")).cast("int"), "p": F.pmod(F.xxhash64("id", F.lit(1)), F.col("rows")).cast("int")})

    def pack(table: pa.Table) -> pa.Table:
        kept = {c: table[c][0].as_py() for c in ("g", "b", "n", "m", "first")}
        return pa.Table.from_pylist([kept | packed(table, matrix_of(table["v"]), k)], pa.schema([("g", pa.string()), ("b", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), ("first", pa.int64()), ("dims", pa.int32()), ("single", pa.bool_()), ("ids", pa.binary()), ("v", pa.binary()), ("shown", pa.binary())]))

    made = dealt_into(keyed, (rows or 0) * (wide + 64) // TASK_BYTES, "g", "b", "p").groupBy("g", "b", "p").applyInArrow(trimmed_group(pack), "g string, b int, n int, m int, first long, dims int, single boolean, ids binary, v binary, shown binary")
    # a row passes each strip in the piece of its own strip, and is its own strip's in all pieces
    share = F.pmod("b", "m")
    unit = lambda strip, piece, role: F.struct((F.col("first") + strip * F.col("m") + piece).cast("long").alias("unit"), role.cast("int").alias("role"))
    passes = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: unit(s, share, F.when(s == F.col("b"), BOTH).otherwise(PASSES)))
    belongs = F.transform(F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda t: t != share), lambda t: unit(F.col("b"), t, F.lit(OWN)))
    sent = made.withColumn("to", F.explode(F.concat(passes, belongs))).select("to.unit", "to.role", "g", "dims", "single", "ids", "v", "shown")
    dealt = sent.repartitionById(parts, F.pmod("unit", F.lit(parts)).cast("int")).sortWithinPartitions("unit", F.col("role") == PASSES)
    return dealt.mapInArrow(trimmed(_passing(k, with_self)), _FOUND), times or 0
