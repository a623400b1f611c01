"""Reeb diagrams: shared-nearest-neighbour density clusters inside every cell of a cover."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.functions.vectors import as_array, ertoz, measure_name
from nervemap.operators.graph import connected_components
from nervemap.operators.metric_index import IndexParams, index_pays, leaf_nearest, tree_nodes, with_leaves
from nervemap.operators.neighbors import nearest, spread_id
from nervemap.runtime import dealt, importable, materialize, numbered

#: Points of the largest cell up to which all pairs of blocks are compared, rather than an index built.
FEW_POINTS = 32_768
#: Bytes of a pair of points, with what sorts it.
PAIR_BYTES = 64


@dataclass(frozen=True)
class ReebDiagram:
    """Parameters. A link needs more than k * link_threshold_ratio shared neighbours, a core point more than k * core_threshold_ratio links.

    Neighbours are exact, so results depend on neither trees nor buffer. A fitted model's trees, drawn from samples of ``top_tree_size`` points a
    cell, deal its rows into leaves; ``search`` says how neighbours are found: by those ``leaves`` (or by trees made for the occasion), by
    comparing all ``blocks`` of a cell, or (``auto``) by leaves only where cells are large and a sample says that leaves leave pairs out. A ``buffer_size`` of -1 is estimated from samples of
    ``buffer_size_samples`` points. Rows without features are noise; feature vectors of a cell that differ in length fail the query.
    """

    id_col: str = "id"
    cover_col: str = "cover_id"
    features_col: str = "features"
    output_col: str = "cluster_id"
    k: int = 5
    link_threshold_ratio: float = 0.4
    core_threshold_ratio: float = 0.7
    measure: str = "euclidean"
    seed: int = 0
    top_tree_size: int = 1000
    top_tree_leaf_size: int = 10
    sub_tree_leaf_size: int = 30
    num_vp_candidates: int = 10
    num_vp_samples: int = 100
    buffer_size: float = -1.0
    buffer_size_samples: tuple[int, ...] = tuple(range(100, 1001, 100))
    search: str = "auto"

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be positive")
        if min(self.top_tree_size, self.top_tree_leaf_size, self.sub_tree_leaf_size, self.num_vp_candidates, self.num_vp_samples) < 1:
            raise ValueError("sizes and numbers of the trees must be positive")
        if not self.buffer_size >= -1:
            raise ValueError("buffer_size must be -1 or more")
        if len(self.buffer_size_samples) < 2 or min(self.buffer_size_samples) <= 0:
            raise ValueError("at least two positive sample sizes are needed")
        for r in (self.link_threshold_ratio, self.core_threshold_ratio):
            if not 0 < r <= 1:
                raise ValueError("ratios must be above 0 and at most 1")
        measure_name(self.measure)
        if self.search not in ("auto", "leaves", "blocks"):
            raise ValueError("search is auto, leaves or blocks")

    @property
    def index(self) -> IndexParams:
        return IndexParams(leaf_size=self.top_tree_leaf_size, sub_leaf_size=self.sub_tree_leaf_size, candidates=self.num_vp_candidates, samples=self.num_vp_samples, seed=self.seed)

    def _points(self, df: DataFrame, id_col: str) -> DataFrame:
        return df.select(F.col(self.cover_col).cast("string").alias("g"), F.col(id_col).alias("id"), as_array(df, self.features_col).alias("v")).where("v is not null")

    def neighbours(self, df: DataFrame, nodes: DataFrame | None = None, buffer: float = 0.0) -> DataFrame:
        """(i, j, value): the k nearest points of each point in its cell, itself included. A point is its id and cell, numbered ``vid``.

        ``nodes``: the trees of a fitted model; ``buffer``: within which leaves are looked into at once.
        """
        points = self._points(df, "vid")
        by_leaves = self.search == "leaves"
        if self.search == "auto":
            largest = points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
            if largest > FEW_POINTS:
                nodes = tree_nodes(points, self.measure, self.index) if nodes is None else nodes
                by_leaves = index_pays(points, self.k, self.measure, nodes, self.index)
        if by_leaves:
            found = leaf_nearest(points, self.k, self.measure, True, buffer, self.index, nodes)
        else:
            found = nearest(points.withColumn("picked", F.lit(True)), self.k, self.measure, with_self=True)
        return found.select("i", "j", "value")

    def numbered(self, df: DataFrame, num_cubes: int | None = None) -> DataFrame:
        """``df`` with ``vid`` = id * cells + cell; ids that are no whole numbers, or too large for that, count by their place in order."""
        whole = isinstance(df.schema[self.id_col].dataType, T.IntegralType)
        id_ = F.col(self.id_col)
        largest, cells = df.agg(F.max(F.greatest(id_.cast("decimal(20,0)"), -id_.cast("decimal(20,0)"))) if whole else F.lit(None), F.max(self.cover_col)).first()
        if num_cubes is None:
            num_cubes = int(cells or 0) + 1
        if whole and int(largest or 0) < (2**63 - 1) // num_cubes - 1:
            return df.withColumn("vid", id_.cast("long") * num_cubes + F.col(self.cover_col))
        places, _ = numbered(df.select(id_.alias("_id")).where(id_.isNotNull()).distinct(), "_id", name="ids")
        found = df.join(places, id_.eqNullSafe(F.col("_id")), "left")
        return found.withColumn("vid", F.col("_row") * num_cubes + F.col(self.cover_col)).drop("_id", "_row")

    def graph(self, neighbours: DataFrame) -> DataFrame:
        """(i, j, sim): mutual neighbours, each with itself included, and how many neighbours they share."""
        pairs = materialize(neighbours.select("i", "j"), "neighbours")
        n, size = pairs.count(), PAIR_BYTES + 8 * self.k
        by = lambda df, *keys: dealt(df, n, size, *keys)  # noqa: E731  equally many partitions for both sides of a join
        # a point that many have for a neighbour has k mutual ones at most
        mutual = by(pairs, "i", "j").join(by(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")), "i", "j"), ["i", "j"])
        lists = materialize(by(pairs, "i").groupBy("i").agg(F.collect_list("j").alias("own")), "lists")  # k entries
        half = by(mutual, "i").join(by(lists, "i"), "i")
        both = by(half, "j").join(by(lists.withColumnsRenamed({"i": "j", "own": "other"}), "j"), "j")
        return both.select("i", "j", ertoz(F.col("own"), F.col("other")).alias("sim"))

    def density(self, graph: DataFrame) -> DataFrame:
        """(i, density): links of each point that has a mutual neighbour, one to itself included."""
        return graph.groupBy("i").agg(F.count_if(F.col("sim") > self.k * self.link_threshold_ratio).alias("density"))

    def edges(self, graph: DataFrame) -> DataFrame:
        """(i, j): links from core points. Links to core points are the same, seen from the other end."""
        dense = self.density(graph).where(F.col("density") > self.k * self.core_threshold_ratio).select("i")
        return graph.where(F.col("sim") > self.k * self.link_threshold_ratio).join(dense, "i").select("i", "j")

    def labels(self, edges: DataFrame) -> DataFrame:
        """(vid, label): every point with an edge, and the smallest of its component."""
        edges = materialize(edges, "links")
        ends = edges.select(F.col("i").alias("vid")).unionByName(edges.select(F.col("j").alias("vid"))).distinct()
        found = connected_components(edges, "i", "j").withColumnsRenamed({"vertex": "vid", "component": "label"})
        return ends.join(found, "vid", "left").select("vid", F.coalesce("label", "vid").alias("label"))

    def transform(self, df: DataFrame, num_cubes: int | None = None, nodes: DataFrame | None = None, buffer: float = 0.0) -> DataFrame:
        """``df`` with the cluster of each row: the smallest vid in it, or -(cell + 1) for noise."""
        rows = self.numbered(df, num_cubes)
        graph = materialize(self.graph(self.neighbours(rows, nodes, buffer)), "snn")
        labels = self.labels(self.edges(graph)).withColumnsRenamed({"vid": "_vid", "label": "_label"})
        out = rows.withColumnRenamed("vid", "_vid").join(labels, "_vid", "left")
        return out.withColumn(self.output_col, F.coalesce("_label", -(F.col(self.cover_col).cast("long") + 1))).drop("_label", "_vid")


    def fit(self, df: DataFrame) -> ReebDiagramModel:
        """The number of cells, a top tree for each of them, and the buffer size. Trees are built by tasks and written; the driver gets numbers only."""
        importable(df.sparkSession)
        cells = int(df.agg(F.max(self.cover_col)).first()[0] or 0) + 1
        points = self._points(df.withColumn("_vid", F.xxhash64(self.id_col)), "_vid") if not isinstance(df.schema[self.id_col].dataType, T.IntegralType) else self._points(df, self.id_col)
        nodes = tree_nodes(points.withColumn("id", F.col("id").cast("long")), self.measure, replace(self.index, target=1, sample=self.top_tree_size))
        buffer = self.buffer_size
        if buffer < 0:
            points = df.select(F.col(self.id_col), as_array(df, self.features_col).alias("_v")).where("_v is not null")
            buffer = estimate_buffer_size(points, self.k, self.measure, self.buffer_size_samples, self.seed, self.id_col, "_v") if not nodes.isEmpty() else 0.0
        return ReebDiagramModel(self, cells, buffer, nodes)


@dataclass(frozen=True)
class ReebDiagramModel:
    """What ``ReebDiagram.fit`` gives: applies to any rows of the cells that were there. ``nodes``: its trees, a row a node."""

    params: ReebDiagram
    num_cubes: int
    buffer_size: float
    nodes: DataFrame

    def copy(self, **changes) -> ReebDiagramModel:
        """The model with some parameters changed."""
        return replace(self, params=replace(self.params, **changes))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.params.transform(df, self.num_cubes, self.nodes, self.buffer_size)

    @property
    def num_leaves(self) -> int:
        return self.nodes.where("leaf is not null").count()

    def leaves(self, df: DataFrame) -> DataFrame:
        """``df`` with ``leaf``: that of the top tree of the row's cell, null for a cell without one. Rows near each other mostly share it."""
        importable(df.sparkSession)
        return with_leaves(df, self.nodes, self.params.measure, F.col(self.params.cover_col), as_array(df, self.params.features_col))

    def by_leaf(self, df: DataFrame) -> DataFrame:
        """``leaves`` of ``df``, leaf n in partition n; rows without a leaf in one more."""
        return repartition_by_leaf(self.leaves(df), "leaf", self.num_leaves)


def repartition_by_leaf(df: DataFrame, leaf_col: str, leaves: int) -> DataFrame:
    """A partition for each leaf, which two tables dealt so share, and one more for rows without; a number that is no leaf's fails the query."""
    leaf = F.col(leaf_col)
    bad = F.raise_error(F.concat(leaf.cast("string"), F.lit(" is no leaf"))).cast("int")
    return df.repartitionById(leaves + 1, F.when(leaf.isNull(), leaves).when((leaf >= 0) & (leaf < leaves), leaf.cast("int")).otherwise(bad))


def mean_radius(df: DataFrame, k: int, measure: str, id_col: str = "id", vec_col: str = "vec", group_col: str | None = None) -> DataFrame:
    """(g, radius): the mean distance to the k-th nearest point that isn't at distance 0, or to the farthest if there are fewer."""
    g = F.col(group_col).cast("string") if group_col else F.lit("")
    points = df.select(g.alias("g"), F.col(id_col).cast("long").alias("id"), as_array(df, vec_col).alias("v"), F.lit(True).alias("picked"))
    found = nearest(points, k, measure, positive=True)
    return found.groupBy("g", "i").agg(F.max("value").alias("r")).groupBy("g").agg(F.avg("r").alias("radius"))


def buffer_size(sizes: list[float], radii: list[float], n: int) -> float:
    """A line through log radius over log sample size, carried on to n points; the largest radius if it doesn't fall."""
    x, y = np.log(sizes), np.log(radii)
    spread = ((x - x.mean()) ** 2).sum()
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread > 0 else float("nan")
    if not slope <= 0:
        return float(np.exp(y.max()))
    radius = float(np.exp(y.mean() - slope * x.mean() + slope * np.log(n)))
    return radius / float(np.sqrt(-1 / slope)) if slope < 0 else float(np.exp(y.max()))


def estimate_buffer_size(df: DataFrame, k: int, measure: str = "euclidean", sample_sizes: tuple[int, ...] = tuple(range(100, 1001, 100)), seed: int = 0, id_col: str = "id", vec_col: str = "vec") -> float:
    """The buffer of a spill tree over all rows, from samples of about the given sizes, drawn by arithmetic on the id."""
    if len(sample_sizes) < 2 or min(sample_sizes) <= 0:
        raise ValueError("at least two positive sample sizes are needed")
    n = df.count()
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    place = spread_id((F.col(id_col).cast("long") if whole else F.xxhash64(id_col)), seed) + F.col("_s") * 7919
    samples = df.select(id_col, vec_col, F.explode(F.array(*map(F.lit, sample_sizes))).alias("_s")).where(F.pmod(place, F.lit(1000003)) < F.col("_s") / F.lit(float(max(1, n))) * 1000003)
    sized = {r["_s"]: r["n"] for r in samples.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).collect()}
    radii = {int(r["g"]): r["radius"] for r in mean_radius(samples, k, measure, id_col, vec_col, "_s").collect()}
    at = sorted(s for s in radii if sized.get(s))
    return buffer_size([sized[s] for s in at], [radii[s] for s in at], n)
