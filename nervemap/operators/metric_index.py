"""A metric index kept as tables, and the exact nearest neighbours found with it.

For each group a vantage-point tree is built by a task from a bounded sample and written, a row a node. Every point descends it to its home
leaf. A search takes two passes over the leaves: the first looks into the leaves that are within a buffer of the point, its home among
them; what it finds bounds the distance of the k-th neighbour, and the second looks into those other leaves that may hold something
nearer, and no more, which proves the result. In a leaf a task builds a sub-tree of the points that stand there and takes all that visit it
through it together. So a point is sent to the leaves that it has to be compared with, rather than to all blocks of its group.

Of points with equal vectors only the k + 1 smallest ids can be neighbours of anything, so a leaf holds no more of them, however
many they are. Leaves and visits are dealt into pieces of a bounded size; no leaf, group or tree is in one task or the driver whole.

All measures keep the triangle inequality but cosine, which is taken between lines (``vptree.metric``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.functions.vectors import measure_name, pairwise
from nervemap.operators.neighbors import k_least, matrix_of, nearest
from nervemap.operators.vptree import VPTree, metric
from nervemap.runtime import dealt_into, hot_join, importable, materialize, own_columns, trimmed_group, unused

#: Points that meet their group's tree at once; candidates of a leaf, and visits, that make a unit of work.
MEET, CANDIDATES, VISITS = 65_536, 8_192, 8_192
#: Rows of a partition of such units.
ROWS = 65_536
#: Points whose visits are counted at once; visits of a point, on average, beyond which comparing blocks sends fewer rows.
COUNTED, VISITS_OF_A_POINT = 4_096, 128
#: Most sampled points of a group's tree.
SAMPLE = 65_536
#: Points of a group, about, from which it is judged whether its index pays, and how many of them are asked.
JUDGED, ASKED = 16_384, 64
#: Counts of leaves up to which they are broadcast (about 40 bytes each).
BROADCAST_LEAVES = 200_000
_NODES = "g string, node int, vantage array<double>, radius double, near int, far int, leaf int"
_FOUND = "g string, i long, j long, value double"


@dataclass(frozen=True)
class IndexParams:
    """``target``: points of a leaf that are aimed at; ``leaf_size``: sampled points of a leaf; ``sample``: sampled points of a group, at most ``SAMPLE``;
    ``sub_leaf_size``: points of a sub-tree's leaf; ``candidates`` and ``samples``: of the choice of a vantage point."""

    target: int = 2048
    leaf_size: int = 10
    sample: int = SAMPLE
    sub_leaf_size: int = 30
    candidates: int = 10
    samples: int = 100
    seed: int = 0


@dataclass(frozen=True)
class Counted:
    """A written table of one row a key, and whether it is small enough to be broadcast."""

    table: DataFrame
    small: bool

    @staticmethod
    def of(table: DataFrame, name: str) -> Counted:
        table = materialize(table, name)
        return Counted(table, table.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES)

    def joined(self, rows: DataFrame, key: str, *columns: Column) -> DataFrame:
        """``rows`` with columns made from those of the table."""
        table = self.table.select(key, *columns)
        return rows.join(F.broadcast(table), key) if self.small else hot_join(rows, table, key)


def counted_groups(points: DataFrame) -> Counted:
    return Counted.of(points.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "groups")


def _home(measure: str, carried: list[str]):
    """Rows of a group with their leaves; those of a group that the trees don't know are one leaf."""

    def run(rows: pa.Table, tree: pa.Table) -> pa.Table:
        leaf = np.zeros(rows.num_rows)
        if rows.num_rows and tree.num_rows:
            leaf = VPTree.of_nodes(tree.to_pylist(), measure).leaves_of(matrix_of(rows["v"]))
        return rows.select(carried).append_column("leaf", pa.array(leaf, pa.int32()))

    return run


def tree_nodes(points: DataFrame, measure: str, params: IndexParams, groups: Counted | None = None) -> DataFrame:
    """The node table of ``points`` (g, id, v), those without a vector left out. A group's sample goes to one task, at most ``SAMPLE`` points; trees go nowhere but to the table."""
    measure, p, points = measure_name(measure), params, points.where("v is not null")
    groups = counted_groups(points) if groups is None else groups
    wanted = F.least(F.lit(min(p.sample, SAMPLE)).cast("long"), F.ceil(F.col("n") / p.target) * p.leaf_size).cast("long")
    # about twice as many by their hashes, so that few are sorted
    drawn = F.pmod(F.xxhash64("id", F.lit(p.seed + 1)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * (2 * F.col("wanted") + 100) / F.col("n")
    order = Window.partitionBy("g").orderBy(F.xxhash64("id", F.lit(p.seed)), "id")
    some = groups.joined(points.select("g", "id", "v"), "g", F.col("n"), wanted.alias("wanted")).where(drawn)
    some = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE).where(F.col("_n") <= F.col("wanted"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        tree = VPTree(table["id"].to_numpy(), matrix_of(table["v"]), measure, p.leaf_size, p.candidates, p.samples, p.seed)
        g = table["g"][0].as_py()
        kinds = pa.schema([("g", pa.string()), ("node", pa.int32()), ("vantage", pa.list_(pa.float64())), ("radius", pa.float64()), ("near", pa.int32()), ("far", pa.int32()), ("leaf", pa.int32())])
        return pa.Table.from_pylist([{"g": g} | r for r in tree.nodes()], kinds)

    return materialize(some.select("g", "id", "v").groupBy("g").applyInArrow(trimmed_group(build), _NODES), "tree-nodes")


def meeting(points: DataFrame, nodes: DataFrame, run, schema, groups: Counted) -> DataFrame:
    """``run`` of at most about ``MEET`` points (g, id, ...) of a group and its tree's nodes, for all points. ``groups``: (g, n)."""
    blocks = F.ceil(F.col("n") / MEET).cast("int").alias("blocks")
    dealt = groups.joined(points, "g", blocks).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    trees = groups.joined(nodes, "g", blocks).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    parts = (groups.table.agg(F.sum("n")).first()[0] or 0) // MEET
    return _together(dealt, trees, parts, "g", "b").applyInArrow(trimmed_group(run), schema)


def _together(left: DataFrame, right: DataFrame, parts: int, *keys: str):
    """Rows of both tables by ``keys``, in ``parts`` partitions at least, so that what a task sorts doesn't grow with the tables."""
    return dealt_into(left, parts, *keys).groupBy(*keys).cogroup(dealt_into(right, parts, *keys).groupBy(*keys))


@dataclass
class MetricIndex:
    """``points``: (g, id, v); ``nodes``: a row for each node of each group's tree; ``there``: (unit, g, leaf, id, v) of the points that can be neighbours."""

    points: DataFrame
    groups: Counted
    nodes: DataFrame
    there: DataFrame
    measure: str
    k: int
    params: IndexParams

    @staticmethod
    def of(points: DataFrame, k: int, measure: str = "euclidean", params: IndexParams | None = None, nodes: DataFrame | None = None) -> MetricIndex:
        """The index of ``points`` (g string, id long, v array<double>), by trees of their own or those given."""
        importable(points.sparkSession)
        measure, params = measure_name(measure), params or IndexParams()
        points = materialize(points.where("v is not null").select("g", "id", "v"), "points")
        groups = counted_groups(points)
        nodes = tree_nodes(points, measure, params, groups) if nodes is None else nodes
        copies = Window.partitionBy("g", "v").orderBy("id")
        some = points.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n")
        there = meeting(some, nodes, _home(measure, ["g", "id", "v"]), "g string, id long, v array<double>, leaf int", groups)
        return MetricIndex(points, groups, nodes, materialize(there.withColumn("unit", F.concat_ws("/", F.col("leaf").cast("string"), "g")), "leaves"), measure, k, params)

    def visits(self, points: DataFrame) -> DataFrame:
        """``points`` (g, id, v, past, reach, metric both) to (unit, id, v, reach): a row for each leaf of the group with a bound above ``past`` and of ``reach`` at most."""
        measure = self.measure

        def run(rows: pa.Table, tree: pa.Table) -> pa.Table:
            names = ["g", "leaf", "id", "v", "reach"]
            if not rows.num_rows:
                return pa.table([rows["g"], pa.array([], pa.int32()), rows["id"], rows["v"], rows["reach"]], names)
            past, reach = (rows[c].to_numpy() for c in ("past", "reach"))
            if tree.num_rows:
                at, leaf, bound = VPTree.of_nodes(tree.to_pylist(), measure).bounds(matrix_of(rows["v"]), reach)
                new = bound > past[at]
                at, leaf = at[new], leaf[new]
            else:
                at = np.flatnonzero(past < 0)
                leaf = np.zeros(len(at))
            own = rows.take(pa.array(at))
            return pa.table([own["g"], pa.array(leaf, pa.int32()), own["id"], own["v"], own["reach"]], names)

        out = meeting(points, self.nodes, run, "g string, leaf int, id long, v array<double>, reach double", self.groups)
        return out.withColumn("unit", F.concat_ws("/", F.col("leaf").cast("string"), "g"))

    def number_of_visits(self, points: DataFrame) -> tuple[float, float]:
        """How many rows ``visits`` would have, and how many pairs they would meet, from counts of each leaf; no row of a visit is made."""
        measure = self.measure

        def run(rows: pa.Table, tree: pa.Table) -> pa.Table:
            sizes = np.zeros(0, np.int64)
            if rows.num_rows and tree.num_rows:
                known, v = VPTree.of_nodes(tree.to_pylist(), measure), matrix_of(rows["v"])
                past, reach = (rows[c].to_numpy() for c in ("past", "reach"))
                sizes = np.zeros(known.leaves, np.int64)
                for lo in range(0, len(v), COUNTED):
                    at, leaf, bound = known.bounds(v[lo : lo + COUNTED], reach[lo : lo + COUNTED])
                    sizes += np.bincount(leaf[bound > past[lo : lo + COUNTED][at]].astype(np.int64), minlength=known.leaves)
            elif rows.num_rows:
                sizes = np.array([np.count_nonzero(rows["past"].to_numpy() < 0)])
            leaf = np.flatnonzero(sizes)
            g = [rows["g"][0].as_py()] * len(leaf) if len(leaf) else []
            return pa.table([pa.array(g, pa.string()), pa.array(leaf, pa.int32()), pa.array(sizes[leaf], pa.int64())], ["g", "leaf", "nv"])

        asked = meeting(points, self.nodes, run, "g string, leaf int, nv long", self.groups).groupBy("g", "leaf").agg(F.sum("nv").alias("nv"))
        held = self.there.groupBy("g", "leaf").agg(F.count(F.lit(1)).alias("nc"))
        found = asked.join(held, ["g", "leaf"], "left").agg(F.sum("nv"), F.sum(F.col("nv").cast("double") * F.col("nc"))).first()
        return float(found[0] or 0), float(found[1] or 0)

    def _too_many(self, points: DataFrame, most: float) -> bool:
        """Whether visits would meet more than ``most`` of all pairs, or be so many rows that blocks, each of which a point is sent to once, are the lighter way."""
        if most == float("inf"):
            return False
        visits, pairs = self.number_of_visits(points)
        n, squares = self.groups.table.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
        return pairs > most * (squares or 0.0) or visits > VISITS_OF_A_POINT * (n or 0)

    def units(self, visits: DataFrame) -> Counted:
        """(unit, nc, nv): how many candidates and visits meet in each leaf."""
        number = lambda df, name: df.groupBy("unit").agg(F.count(F.lit(1)).alias(name))
        return Counted.of(number(self.there, "nc").join(number(visits, "nv"), "unit"), "units")

    def looked(self, visits: DataFrame, units: Counted, with_self: bool) -> DataFrame:
        """(g, i, j, value) of up to k candidates for each visit, and of each unit a row without j: in ``value`` the distances that were computed."""
        measure, k, p = self.measure, self.k, self.params

        def run(asking: pa.Table, there: pa.Table) -> pa.Table:
            names = ["g", "i", "j", "value"]
            if not asking.num_rows or not there.num_rows:
                return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.float64())], names)
            v, q = matrix_of(there["v"]), matrix_of(asking["v"])
            if v.shape[1] != q.shape[1]:
                raise ValueError("vectors differ in length")
            ids = there["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            tree = VPTree(ids[order], v[order], measure, p.sub_leaf_size, p.candidates, p.samples, p.seed)
            own = asking["id"].to_numpy()
            row, j, value, compared = tree.nearest_many(q, k, asking["reach"].to_numpy(), None if with_self else own)
            g = there["g"][0].as_py()
            return pa.table([pa.array([g] * (len(row) + 1)), pa.array([*own[row].tolist(), None], pa.int64()), pa.array([*j.tolist(), None], pa.int64()), pa.array([*value.tolist(), float(compared)])], names)

        there = self.there.select("unit", "g", "id", "v")
        pieces = F.ceil(F.col("nc") / CANDIDATES).cast("int"), F.ceil(F.col("nv") / VISITS).cast("int")
        both = pieces[0].alias("cb"), pieces[1].alias("qb")
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = units.joined(visits, "unit", *both).withColumn("q", deal("qb")).withColumn("c", each("cb")).drop("cb", "qb")
        there = units.joined(there, "unit", *both).withColumn("c", deal("cb")).withColumn("q", each("qb")).drop("cb", "qb")
        sent = units.table.agg(F.sum(F.col("nv") * pieces[0] + F.col("nc") * pieces[1])).first()[0] or 0
        return _together(asking, there, sent // ROWS, "unit", "c", "q").applyInArrow(trimmed_group(run), _FOUND)

    def search(self, buffer: float = 0.0, with_self: bool = False, most: float = float("inf")) -> tuple[DataFrame, DataFrame] | None:
        """(g, i, j, value) of the k nearest points of its group to each point, ties by id, and (g, compared): the distances that were computed.

        ``buffer``: distance (as the measure has it) within which the first pass looks; the result doesn't depend on it. None, if visits meet more
        than ``most`` of all pairs of points of a group, or a point more than ``VISITS_OF_A_POINT`` leaves on average: points of many dimensions without clusters
        are as near to most leaves as to their own. Visits are counted before any is made.
        """
        near = float(metric(self.measure, np.float64(max(buffer, 0.0))))
        # a bound is 0 at least, so that -1 lets none go
        asked = self.points.withColumns({"past": F.lit(-1.0), "reach": F.lit(near)})
        if self._too_many(asked, most):
            return None
        visits = materialize(self.visits(asked).withColumn("reach", F.lit(float("inf"))), "visits")
        first = materialize(self.looked(visits, self.units(visits), with_self), "found")
        told = _least(first, self.k).groupBy("g", F.col("i").alias("id")).agg(F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))
        reach = F.when(F.col("n") >= self.k, F.sqrt(2 * F.col("most")) * (1 + 1e-9) if self.measure == "cosine" else F.col("most")).otherwise(F.lit(float("inf")))
        asked = materialize(self.points.join(told, ["g", "id"], "left").select("g", "id", "v", F.lit(near).alias("past"), reach.alias("reach")), "reaches")
        if self._too_many(asked, most):
            return None
        visits = materialize(self.visits(asked), "visits")
        units = self.units(visits)
        both = first.unionByName(materialize(self.looked(visits, units, with_self), "found"))
        return _least(both, self.k), both.where("j is null").groupBy("g").agg(F.sum("value").cast("long").alias("compared"))


def _least(found: DataFrame, k: int) -> DataFrame:
    """``k_least`` of what was found and written."""
    found = found.where("j is not null")
    return k_least(found, found.count(), k)


#: Share of a group's pairs from which comparing all of them, in blocks, is the cheaper way.
MOST = 0.5


def index_pays(points: DataFrame, k: int, measure: str, nodes: DataFrame, params: IndexParams, most: float = MOST) -> bool:
    """Whether an exact search of ``points`` (g, id, v) by these trees would meet no more than about ``most`` of all pairs, from a bounded sample of each group.

    Some of its points are asked how far their k-th nearest in the sample is, and which leaves are within that. In all points it is nearer, so the share that would be met is rather
    overrated. The search itself learns this only after its first pass, whose work grows with the square of a group where trees have few leaves.
    """
    measure, points = measure_name(measure), points.where("v is not null").select("g", "id", "v")
    groups = counted_groups(points)
    drawn = F.pmod(F.xxhash64("id", F.lit(params.seed + 2)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * JUDGED / F.col("n")
    some = groups.joined(points, "g", F.col("n")).where(drawn).drop("n")

    def run(rows: pa.Table, tree: pa.Table) -> pa.Table:
        share = 1.0
        if rows.num_rows >= k and tree.num_rows:
            v, known = matrix_of(rows.sort_by("id")["v"]), VPTree.of_nodes(tree.to_pylist(), measure)
            asked = v[np.linspace(0, len(v) - 1, min(ASKED, len(v))).astype(np.int64)]
            last = np.partition(np.concatenate([pairwise(measure, asked, v[lo : lo + COUNTED]) for lo in range(0, len(v), COUNTED)], axis=1), k - 1, axis=1)[:, k - 1]
            share = len(known.bounds(asked, metric(measure, last))[0]) / (len(asked) * known.leaves)
        g = (rows if rows.num_rows else tree)["g"][0].as_py()
        return pa.table({"g": [g], "share": [share]})

    parts = (groups.table.agg(F.sum(F.least("n", F.lit(JUDGED)))).first()[0] or 0) // MEET
    shares = _together(some, nodes, parts, "g").applyInArrow(trimmed_group(run), "g string, share double")
    squares = F.col("n").cast("double") * F.col("n")
    met, pairs = groups.table.join(shares, "g", "left").agg(F.sum(squares * F.coalesce("share", F.lit(1.0))), F.sum(squares)).first()
    return (met or 0.0) <= most * (pairs or 0.0)


def leaf_nearest(
    points: DataFrame, k: int, measure: str = "euclidean", with_self: bool = False, buffer: float = 0.0, params: IndexParams | None = None, nodes: DataFrame | None = None, most: float = MOST
) -> DataFrame:
    """(g, i, j, value): what ``neighbors.nearest`` gives without a predicate or a sample, by a metric index.

    Where visits would meet more than ``most`` of all pairs, the blocks of ``nearest`` are compared after all; the result is the same. Points
    without a vector take no part; vectors of a group that differ in length, and distances that are not numbers, fail the query.
    """
    if k < 1:
        raise ValueError("k must be positive")
    index = MetricIndex.of(points, k, measure, params, nodes)
    found = index.search(buffer, with_self, most)
    return found[0] if found is not None else nearest(index.points.withColumn("picked", F.lit(True)), k, measure, with_self)


def with_leaves(df: DataFrame, nodes: DataFrame, measure: str, group: Column, vector: Column, leaf_col: str = "leaf") -> DataFrame:
    """``df`` with the leaf that each row descends to in its group's tree, leaves being numbered over all groups in order; null for a group without a
    tree or a row without a vector. Other columns stay, whatever they are called."""
    firsts = nodes.where("leaf is not null").groupBy("g").agg(F.count(F.lit(1)).alias("leaves"))
    earlier = F.coalesce(F.sum("leaves").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a group
    firsts = firsts.select(F.col("g").alias("_g"), earlier.alias("_first"))
    nested = df.select(F.struct(*own_columns(df)).alias("row"), group.cast("string").alias("g"), vector.alias("v"))
    known = nested.join(firsts, F.col("g") == F.col("_g"), "left").drop("_g").withColumn("id", F.xxhash64("g", "v", F.monotonically_increasing_id()))
    some = materialize(known.where("_first is not null and v is not null"), "rows")
    fields = T.StructType([some.schema["row"], T.StructField("_first", T.LongType()), T.StructField("leaf", T.IntegerType())])
    found = meeting(some, nodes, _home(measure, ["row", "_first"]), fields, counted_groups(some)).select("row", (F.col("_first") + F.col("leaf")).alias("at"))
    rest = known.where("_first is null or v is null").select("row", F.lit(None).cast("long").alias("at"))
    name, = unused(df, leaf_col)
    return found.unionByName(rest).select(*(F.col("row").getField(c).alias(c) for c in df.columns), F.col("at").alias(name))
