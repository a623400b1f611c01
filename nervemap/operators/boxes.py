"""Joins of intervals and boxes that come from tables: which intersect, which hold which.

A box has, for each dimension, a lower and an upper end, open or closed, or none. One dimension is cut into bins of about equally many
ends, and bins of two, four, ... of these make coarser levels, up to one bin of all. A box lives on the level where it covers at most two
bins, and is asked for on all coarser ones, so that it takes two rows a level however wide it is. Two boxes meet on the coarser of their
levels, in the bin of the greater of their lower ends, and nowhere else; so each pair is made once, and is tested in all dimensions there. Boxes that
are asked for never meet one another, only those that live on the level. Bins with many rows are dealt into pieces.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.operators.intervals import Cube, Interval
from nervemap.runtime import importable, materialize, partitions, trimmed_group

#: Bins of the finest level at most (a power of two); boxes of a bin, and rows of a piece, that are aimed at.
BINS, PER_BIN, PIECE = 4096, 64, 4096
#: Rows of a piece that meet the other piece at once; pairs of a partition of units, and partitions at most.
ROWS_AT_ONCE, PAIRS, MOST_PARTITIONS = 256, 1 << 24, 4096
_SCHEMA = "id long, lo array<double>, hi array<double>, lo_closed array<boolean>, hi_closed array<boolean>"
Relation = Literal["intersects", "contains"]


def boxes(df: DataFrame, id_col: str, lows: Sequence[Column], highs: Sequence[Column], closed: bool | tuple[bool, bool] = True) -> DataFrame:
    """(id, lo, hi, lo_closed, hi_closed) of boxes whose ends are columns, null where there is none. ``closed``: of all ends, or of lower and upper ones."""
    below, above = closed if isinstance(closed, tuple) else (closed, closed)
    flags = lambda x: F.array(*[F.lit(x)] * len(lows))
    ends = lambda cols: F.array(*(c.cast("double") for c in cols))
    return df.select(F.col(id_col).alias("id"), ends(lows).alias("lo"), ends(highs).alias("hi"), flags(below).alias("lo_closed"), flags(above).alias("hi_closed"))


def points(df: DataFrame, id_col: str, coordinates: Sequence[Column]) -> DataFrame:
    """Points as boxes: a box contains such a one if it contains the point."""
    return boxes(df, id_col, coordinates, coordinates)


def cube_table(spark: SparkSession, cubes: Sequence[Cube]) -> DataFrame:
    """Cubes as rows."""
    rows = [(c.id, *([get(s) for s in c.sides] for get in (lambda s: s.lower.end.value, lambda s: s.upper.end.value, lambda s: s.lower.end.closed, lambda s: s.upper.end.closed))) for c in cubes]
    return spark.createDataFrame(rows, _SCHEMA)


def interval_table(spark: SparkSession, intervals: Sequence[Interval]) -> DataFrame:
    """Intervals, numbered from 0, as rows of boxes of one dimension."""
    return cube_table(spark, [Cube(i, (x,)) for i, x in enumerate(intervals)])


def _ends(sides: int) -> list[Column]:
    """A box's ends and flags as columns of their own, which tasks compare as arrays; lists would be walked for each pair."""
    return [F.get(c, F.lit(d)).alias(f"{c}{d}") for d in range(sides) for c in ("lo", "lo_closed", "hi", "hi_closed")]


def _within(x: np.ndarray, y: np.ndarray, touching: np.ndarray | bool, always: np.ndarray) -> np.ndarray:
    """x below y, or equal where ``touching``, or ``always``; all broadcast."""
    out = x <= y if touching is True else x < y if touching is False else (x < y) | ((x == y) & touching)
    return out | always if always.any() else out


def _alike(x: np.ndarray, y: np.ndarray, both) -> np.ndarray | bool:
    """``both`` of two columns of flags, by row and column; one flag if either column has one only."""
    if len(x) and len(y) and (x == x[0]).all() and (y == y[0]).all():
        return bool(both(x[0], y[0]))
    return both(x[:, None], y[None, :])


class _Side:
    """One dimension of boxes: its ends, whether they are closed, and where there are none."""

    def __init__(self, table: pa.Table, d: int):
        ends = {c: table[f"{c}{d}"] for c in ("lo", "hi")}
        self.lo, self.hi = (pc.fill_null(ends[c], x).to_numpy() for c, x in (("lo", -np.inf), ("hi", np.inf)))
        self.no_lo, self.no_hi = (pc.is_null(ends[c]).to_numpy() for c in ("lo", "hi"))
        self.lo_closed, self.hi_closed = (table[f"{c}{d}"].to_numpy(zero_copy_only=False).astype(bool) for c in ("lo_closed", "hi_closed"))

    def part(self, at: slice) -> _Side:
        out = object.__new__(_Side)
        out.__dict__ = {k: v[at] for k, v in self.__dict__.items()}
        return out


def _meets(p: _Side, q: _Side) -> np.ndarray:
    below = _within(p.lo[:, None], q.hi[None, :], _alike(p.lo_closed, q.hi_closed, lambda x, y: x & y), p.no_lo[:, None] | q.no_hi[None, :])
    above = _within(q.lo[None, :], p.hi[:, None], _alike(p.hi_closed, q.lo_closed, lambda x, y: x & y), q.no_lo[None, :] | p.no_hi[:, None])
    return below & above


def _holds(p: _Side, q: _Side) -> np.ndarray:
    low = _within(p.lo[:, None], q.lo[None, :], _alike(p.lo_closed, q.lo_closed, lambda x, y: x | ~y), p.no_lo[:, None] & np.ones(len(q.lo), bool))
    high = _within(q.hi[None, :], p.hi[:, None], _alike(p.hi_closed, q.hi_closed, lambda x, y: x | ~y), p.no_hi[:, None] & np.ones(len(q.lo), bool))
    if q.no_lo.any():
        low &= p.no_lo[:, None] | ~q.no_lo[None, :]
    if q.no_hi.any():
        high &= p.no_hi[:, None] | ~q.no_hi[None, :]
    return low & high


_TESTS = {"intersects": _meets, "contains": _holds}


def _usable(df: DataFrame) -> DataFrame:
    """Boxes of numbers, none of which is empty."""
    real = lambda c: F.forall(c, lambda x: x.isNull() | ~F.isnan(x))
    flags = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(False))).alias(c)
    kept = df.select("id", "lo", "hi", flags("lo_closed"), flags("hi_closed")).where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & real("lo") & real("hi"))
    sides = F.arrays_zip("lo", "hi", "lo_closed", "hi_closed")
    full = F.forall(sides, lambda s: s["lo"].isNull() | s["hi"].isNull() | (s["lo"] < s["hi"]) | ((s["lo"] == s["hi"]) & s["lo_closed"] & s["hi_closed"]))
    same = (F.size("hi") == F.size("lo")) & (F.size("lo_closed") == F.size("lo")) & (F.size("hi_closed") == F.size("lo"))
    return kept.where(F.when(same, full).otherwise(F.raise_error(F.lit("a box has sides without ends")).cast("boolean")))


def _bin(x: Column, cuts: list[float]) -> Column:
    """How many of the cuts (a power of two less one, ascending) are at most x, in as many halvings as that takes."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((len(cuts) + 1).bit_length() - 1))))
    at = F.array(*map(F.lit, cuts))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(at, p + s - 1) <= x, p + s).otherwise(p)) if cuts else F.lit(0)


def _cuts(both: DataFrame, dim: int, n: int) -> list[float]:
    """Ends of bins: shares of all finite ends of the dimension."""
    bins = 1
    while bins < BINS and bins * PER_BIN < n:
        bins *= 2
    if bins == 1:
        return []
    ends = both.select(F.explode(F.array(F.get("lo", F.lit(dim)), F.get("hi", F.lit(dim)))).alias("x")).where("x is not null")
    got = ends.agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], 10 * bins).alias("x")).first()["x"]
    return sorted(got) if got else []


def _rows(df: DataFrame, dim: int, cuts: list[float], sides: int) -> DataFrame:
    """A box's rows: level, bin, first (bin of its lower end there), lives; its ends in columns, and a hash that deals it."""
    top = (len(cuts) + 1).bit_length() - 1
    lo, hi = F.get("lo", F.lit(dim)), F.get("hi", F.lit(dim))
    placed = df.withColumns({"_a": F.when(lo.isNull(), 0).otherwise(_bin(lo, cuts)), "_b": F.when(hi.isNull(), len(cuts)).otherwise(_bin(hi, cuts))})
    wide = lambda level: F.expr(f"shiftright(_b, {level}) - shiftright(_a, {level})")
    home = F.coalesce(*(F.when(wide(level) <= 1, F.lit(level)) for level in range(top + 1)))
    levels = placed.withColumn("_home", home).withColumn("level", F.explode(F.sequence("_home", F.lit(top))))
    first, last = F.expr("shiftright(_a, level)"), F.expr("shiftright(_b, level)")
    placed = levels.withColumns({"first": first, "lives": F.col("level") == F.col("_home")}).withColumn("bin", F.explode(F.sequence("first", last)))
    return placed.select("id", "level", "bin", "first", "lives", F.xxhash64("id", "lo").alias("deal"), *_ends(sides))


def _compared(test, sides: int, turned: bool):
    """Ids of the pairs of a unit: of boxes that live in a bin and boxes that ask there, those that meet first in this bin and pass the test."""

    def run(living: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if living.num_rows and asking.num_rows:
            here = living["bin"][0].as_py()
            a, b = ([_Side(t, d) for d in range(sides)] for t in (living, asking))
            first_a, first_b = (t["first"].to_numpy() == here for t in (living, asking))
            for lo in range(0, living.num_rows, ROWS_AT_ONCE):
                at = slice(lo, lo + ROWS_AT_ONCE)
                good = first_a[at][:, None] | first_b[None, :]
                for p, q in zip(a, b, strict=True):
                    p = p.part(at)
                    good &= test(q, p).T if turned else test(p, q)
                x, y = np.nonzero(good)
                found.append((x + lo, y))
        x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        i, j = living["id"].take(pa.array(x)), asking["id"].take(pa.array(y))
        return pa.table([j, i] if turned else [i, j], ["i", "j"])

    return run


def _met(living: DataFrame, asking: DataFrame, relation: Relation, sides: int, turned: bool) -> DataFrame:
    """Pairs of a row that lives in a bin and one that asks there. Both are dealt into pieces, and two pieces are a unit of work, whose pairs are held against each other as arrays."""
    key = ["level", "bin"]
    number = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    # as many rows as there are bins at most
    counts = materialize(number(living, "na").join(number(asking, "nb"), key), "bins")
    pairs = counts.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0
    n = min(MOST_PARTITIONS, max(partitions(living.sparkSession), int(pairs / PAIRS)))
    counts = F.broadcast(counts.select(*key, *(F.ceil(F.col(c) / PIECE).cast("int").alias(c) for c in ("na", "nb"))))
    deal = lambda c: F.pmod("deal", F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = living.join(counts, key).withColumn("p", deal("na")).withColumn("q", every("nb"))
    b = asking.join(counts, key).withColumn("q", deal("nb")).withColumn("p", every("na"))
    unit = [*key, "p", "q"]
    a, b = (x.drop("na", "nb", "deal", "lives").repartition(n, *unit) for x in (a, b))
    ids = [b.schema["id"], a.schema["id"]] if turned else [a.schema["id"], b.schema["id"]]
    kinds = T.StructType([T.StructField(c, f.dataType) for c, f in zip("ij", ids, strict=True)])
    return a.groupBy(*unit).cogroup(b.groupBy(*unit)).applyInArrow(trimmed_group(_compared(_TESTS[relation], sides, turned)), kinds)


def box_join(left: DataFrame, right: DataFrame, relation: Relation = "intersects", dim: int | None = None) -> DataFrame:
    """(i, j): ids of the boxes of ``left`` and ``right`` that intersect, or of which the first contains the second.

    Tables as of ``boxes``, ids of any type, rows of equal ids each for themselves. A box that is null, empty or has an end that is no number, or fewer dimensions
    than the other table's boxes, takes part in nothing; one with an end missing from a list fails the query. ``dim``: the dimension
    that bins are made of, by default that in which boxes are the smallest part of the whole. No pair comes twice, and nothing is compared but boxes that
    share a bin.
    """
    if relation not in _TESTS:
        raise ValueError("boxes intersect or contain one another")
    importable(left.sparkSession)
    left, right = (materialize(_usable(df), "boxes") for df in (left, right))
    both = left.select("lo", "hi").unionByName(right.select("lo", "hi"))
    n, sides = both.agg(F.count(F.lit(1)), F.max(F.size("lo"))).first()
    dim = _narrowest(both, sides or 0) if dim is None else dim
    cuts = _cuts(both, dim, n) if sides else []
    sides = sides or 0
    rows_l, rows_r = (_rows(df.where(F.size("lo") == sides), dim, cuts, sides) for df in (left, right))
    one = _met(rows_l.where("lives"), rows_r, relation, sides, False)
    two = _met(rows_r.where("lives"), rows_l.where("not lives"), relation, sides, True)
    return one.unionByName(two)


def _narrowest(both: DataFrame, sides: int) -> int:
    """The dimension in which the boxes are, on average, the smallest part of what all of them span; those without an end are as long as that."""
    lo, hi = (lambda d, c=c: F.get(c, F.lit(d)) for c in ("lo", "hi"))
    if sides < 2:
        return 0
    wanted = [x for d in range(sides) for x in (F.min(lo(d)), F.max(hi(d)), F.avg(hi(d) - lo(d)), F.count(lo(d) + hi(d)))]
    got = both.agg(F.count(F.lit(1)), *wanted).first()
    shares = []
    for d in range(sides):
        least, most, length, some = got[1 + 4 * d : 5 + 4 * d]
        whole = (most - least) if least is not None and most is not None else 0.0
        shares.append(1.0 if not whole > 0 or length is None else (length / whole * some + (got[0] - some)) / max(1, got[0]))
    return shares.index(min(shares))
