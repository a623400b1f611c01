"""The registered queries of the reference's operators over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nervemap.functions.projection import CauchyProjection, GaussianProjection
from nervemap.functions.sparse import as_sparse, from_pairs, sparse_distance
from nervemap.functions.vectors import MEASURES, binarized, distance
from nervemap.ml import CoverStage, ReebStage
from nervemap.operators import mapper as M
from nervemap.operators.boxes import box_join, boxes
from nervemap.operators.cover import Cover, CoverModel
from nervemap.operators.intervals import Interval
from nervemap.operators.lsh import FAMILIES, Lsh, approx_similarity_join, avg_selectivity
from nervemap.operators.matrix import hadamard, to_entries, transpose
from nervemap.operators.metric_index import IndexParams, leaf_nearest, tree_nodes, with_leaves
from nervemap.operators.neighbors import similarity_join
from nervemap.operators.pca import principal_components
from nervemap.operators.reeb import ReebDiagram, estimate_buffer_size, mean_radius, repartition_by_leaf
from nervemap.operators.setjoin import set_join
from nervemap.runtime import importable, materialize, remove, shared_dir

#: Parameters of the Mapper queries.
SPLITS, OVERLAP, K, LINK, CORE = 4, 0.5, 15, 0.3, 0.4
#: Components above it count as present where a measure looks at supports.
PRESENT = 0.1
#: Numbers of a sketch.
SKETCH = 31
#: Leaves of the index queries: small ones, so that there are some in small tables; points of a leaf of the trees over labels.
LEAVES, LEAF_SIZE = IndexParams(target=64, leaf_size=4, sub_leaf_size=16), 12


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str, measure: str = "euclidean") -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (binarized(v, PRESENT) if measure in ("hamming", "jaccard") else v).alias("vec"), "label")


def _list(name: str = "cover_ids"):
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


def cover_fit_minmax(spark, sf_dir):
    m = Cover(["o_totalprice"]).fit(_table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(m.min[0], m.max[0])], "low double, high double")


def cover_cubes_1d(spark, sf_dir):
    return Cover(["o_totalprice"]).fit(_table(spark, sf_dir, "orders")).cubes(spark)


def cover_cubes_2d(spark, sf_dir):
    return Cover(["l_quantity", "l_discount"], num_splits=5, overlap_ratio=0.2).fit(_table(spark, sf_dir, "lineitem")).cubes(spark)


def cover_assign_array(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return Cover(["o_totalprice"]).fit(t).transform(t).select("o_orderkey", _list())


def cover_assign_2d(spark, sf_dir):
    t = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return Cover(["p_size", "p_retailprice"], num_splits=3, overlap_ratio=0.5).fit(t).transform(t).select("p_partkey", _list())


def cover_assign_vector(spark, sf_dir):
    t = _vectors(spark, sf_dir).select("id", F.slice("vec", 1, 2).alias("head"))
    return Cover(["head"], num_splits=4, overlap_ratio=0.3).fit(t).transform(t).select("id", _list())


def _population(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("cover_id").cast("int").alias("cover_id")).agg(F.count(F.lit(1)).alias("n"))


def cover_explode_count(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return _population(Cover(["c_acctbal"], "cover_id", exploding=True, id_col="c_custkey").fit(t).transform(t))


def cover_population_2d(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return _population(Cover(["l_quantity", "l_discount"], "cover_id", 5, 0.2, exploding=True, id_col="l_orderkey").fit(t).transform(t))


def cover_closed(spark, sf_dir):
    t = _table(spark, sf_dir, "events").select("event_id", "value")
    return _population(Cover(["value"], "cover_id", 8, 0.25, exploding=True, id_col="event_id", closed=True).fit(t).transform(t))


_INTERVALS = {
    "open": Interval.open(0, 5000),
    "closed": Interval.closed(0, 5000),
    "open_closed": Interval.open_closed(-500, 2500),
    "closed_open": Interval.closed_open(-500, 2500),
    "greater_than": Interval.greater_than(7000),
    "greater_equal": Interval.greater_equal(7000),
    "less_than": Interval.less_than(-100),
    "less_equal": Interval.less_equal(-100),
}


def interval_contains(spark, sf_dir):
    t = _table(spark, sf_dir, "supplier")
    return t.select("s_suppkey", *(i.column(F.col("s_acctbal")).alias(n) for n, i in _INTERVALS.items()))


def interval_intersects(spark, sf_dir):
    """Each two nations whose ranges of balances meet, and whether the first holds the second."""
    t = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    ranges = materialize(boxes(t, "c_nationkey", [F.col("lo")], [F.col("hi")]), "ranges")
    held = box_join(ranges, ranges, "contains").withColumn("within", F.lit(True))
    return box_join(ranges, ranges).join(held, ["i", "j"], "left").where("i < j").select("i", "j", F.coalesce("within", F.lit(False)).alias("within"))


def _around(spark, sf_dir, radius: float, closed) -> DataFrame:
    """Boxes around the first three components of the vectors."""
    x = [F.get("vec", F.lit(d)) for d in range(3)]
    return boxes(_vectors(spark, sf_dir), "id", [c - radius for c in x], [c + radius for c in x], closed)


def cube_intersects(spark, sf_dir):
    """Each two vectors whose half-open boxes meet."""
    t = _around(spark, sf_dir, 0.03, (True, False))
    return box_join(t, t).where("i < j")


def cube_contains(spark, sf_dir):
    """Of each box around a vector the other vectors' smaller ones that it holds."""
    return box_join(_around(spark, sf_dir, 0.1, False), _around(spark, sf_dir, 0.04, True), "contains").where("i <> j")


def _distances(measure: str):
    def query(spark, sf_dir):
        t = _vectors(spark, sf_dir, measure).select("id", "vec")
        b = t.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
        return t.join(b, "id").select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), distance(measure, F.col("vec"), F.col("other")).alias("value"))

    return query


def _knn(measure: str):
    return lambda spark, sf_dir: similarity_join(_vectors(spark, sf_dir, measure), 5, measure)


def _head(df: DataFrame) -> DataFrame:
    """The vectors' first three components: in all 64 every leaf is about as near as any other."""
    return df.withColumn("vec", F.slice("vec", 1, 3))


def _leaf_knn(measure: str):
    """By the metric index, on three components, or, where only supports count, on all of them."""

    def query(spark, sf_dir):
        t = _vectors(spark, sf_dir, measure)
        t = (t if measure in ("hamming", "jaccard") else _head(t)).select(F.lit("").alias("g"), "id", F.col("vec").alias("v"))
        return leaf_nearest(t, 5, measure, params=LEAVES).select("i", "j", "value")

    return query


def index_leaf_sizes(spark, sf_dir):
    """Vectors in each leaf of each label's tree, which is built of all of them in the order of their ids."""
    t = _vectors(spark, sf_dir).select(F.col("label").cast("string").alias("g"), "id", F.col("vec").alias("v"))
    nodes = tree_nodes(t, "euclidean", IndexParams(target=1, leaf_size=LEAF_SIZE, candidates=0))
    found = with_leaves(t, nodes, "euclidean", F.col("g"), F.col("v"))
    return found.groupBy(F.col("g").cast("int").alias("label"), "leaf").agg(F.count(F.lit(1)).alias("n"))


def _sparse(spark, sf_dir) -> DataFrame:
    """Vectors without their components of a tenth or less."""
    t = _vectors(spark, sf_dir)
    t = t.withColumn("vec", F.transform("vec", lambda x: F.when(F.abs(x) > PRESENT, x).otherwise(0.0)))
    return t.select("id", as_sparse(t, "vec").alias("vec"))


def _sparse_distances(measure: str):
    def query(spark, sf_dir):
        t = _sparse(spark, sf_dir)
        b = t.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
        return t.join(b, "id").select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), sparse_distance(measure, F.col("vec"), F.col("other")).alias("value"))

    return query


def knn_sparse_euclidean(spark, sf_dir):
    return similarity_join(_sparse(spark, sf_dir), 5, "euclidean")


def _set_knn(measure: str):
    return lambda spark, sf_dir: set_join(_vectors(spark, sf_dir, measure), 5, measure)[0]


def basket_knn(spark, sf_dir):
    """The orders whose sets of parts are nearest to each order's, by the jaccard distance."""
    parts = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_partkey").cast("int").alias("i"), F.lit(1.0).alias("x")).alias("p")).distinct()
    baskets = parts.groupBy("id").agg(F.collect_list("p").alias("p"))
    return set_join(baskets.select("id", from_pairs((1 << 31) - 1, F.col("p")).alias("vec")), 5)[0]


def l1_estimates(spark, sf_dir):
    """L1 distances of each vector to the next by Cauchy sketches of 31 numbers, which are written, beside the distances themselves."""
    made = CauchyProjection(64, SKETCH, seed=7)
    t = materialize(_vectors(spark, sf_dir).select("id", "vec", made.column(F.col("vec")).alias("sketch")), "sketches")
    b = t.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"), F.col("sketch").alias("other"))
    return t.join(b, "id").select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), made.estimate(F.col("sketch"), F.col("other")).alias("estimate"), distance("manhattan", F.col("vec"), F.col("w")).alias("value"))


def pca_variance(spark, sf_dir):
    """The variance of the vectors along their first principal component, found and as it is of the lens, and of all."""
    t = _vectors(spark, sf_dir)
    found = principal_components(t, "vec", 1)
    lens = t.select(found.column(F.col("vec"))[0].alias("lens"))
    shares = lens.agg(F.round(F.var_samp("lens"), 6).alias("lens_variance"))
    return shares.select("lens_variance", F.lit(round(float(found.variance[0]), 6)).alias("variance"), F.lit(round(found.total, 6)).alias("total"))


def kmeans_invariants(spark, sf_dir):
    """Rows, those that aren't at their nearest centre, and those in no cluster of ten."""
    t = M.kmeans(_vectors(spark, sf_dir), "vec", 10, 20, distances_col="d")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get("d", F.col("cluster_id").cast("int") - 1) > F.array_min("d") + 1e-9).alias("misplaced"), F.count_if(~F.col("cluster_id").between(1, 10)).alias("outside"))


def gmm_invariants(spark, sf_dir):
    """Rows, those whose probabilities don't add up to 1, and those that aren't in their likeliest component."""
    t = M.gaussian_mixture(_vectors(spark, sf_dir), "vec", 3, 20, probabilities_col="q")
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) > 1e-6).alias("unbalanced"), F.count_if(F.get("q", F.col("cluster_id").cast("int") - 1) < F.array_max("q")).alias("misplaced"))


def leaf_partitions(spark, sf_dir):
    """Rows of each partition of the vectors dealt by those leaves."""
    t = _vectors(spark, sf_dir).select(F.col("label").cast("string").alias("g"), "id", F.col("vec").alias("v"))
    nodes = tree_nodes(t, "euclidean", IndexParams(target=1, leaf_size=LEAF_SIZE, candidates=0))
    dealt = repartition_by_leaf(with_leaves(t, nodes, "euclidean", F.col("g"), F.col("v")), "leaf", nodes.where("leaf is not null").count())
    return dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"))


def _folder(spark, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/nervemap-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def cover_saved(spark, sf_dir):
    """The cover of ``cover_assign_array``, its parameters and its ranges written and read again."""
    t = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    plain, fitted = _folder(spark, "cover"), _folder(spark, "cover-model")
    Cover(["o_totalprice"]).save(plain)
    Cover.load(plain).fit(t).save(fitted)
    return CoverModel.load(fitted).transform(t).select("o_orderkey", _list())


def pipeline_clusters(spark, sf_dir):
    """``reeb_clusters`` by a pipeline of a cover and a Reeb diagram that was fitted, saved and loaded."""
    t = _vectors(spark, sf_dir).withColumn("lens", F.get("vec", F.lit(0)))
    stages = [
        CoverStage(inputCols=["lens"], outputCol="cover_id", numSplits=SPLITS, overlapRatio=OVERLAP, exploding=True, idCol="id"),
        ReebStage(featuresCol="vec", k=K, linkThresholdRatio=LINK, coreThresholdRatio=CORE, topTreeSize=100, bufferSize=0.0),
    ]
    path = _folder(spark, "pipeline")
    Pipeline(stages=stages).fit(t).write().save(path)
    return PipelineModel.load(path).transform(t).select("id", "cover_id", "cluster_id")


def knn_pred(spark, sf_dir):
    return similarity_join(_vectors(spark, sf_dir), 5, pred=lambda a, b: a[..., 0] * b[..., 0] > 0)


def knn_sampled(spark, sf_dir):
    return similarity_join(_vectors(spark, sf_dir), 5, fraction=0.5, seed=1)


def _lsh(family: str) -> Lsh:
    more = {"minhash": {"num_bands": 2, "signature_length": 4}, "bitsampling": {"signature_length": 12}, "pstable_l1": {"bucket_width": 40.0}, "pstable_l2": {"bucket_width": 2.0}}
    return Lsh(**({"family": family, "num_features": 64, "signature_length": 4, "num_tables": 2, "seed": 3} | more.get(family, {})))


def _lsh_knn(family: str):
    return lambda spark, sf_dir: approx_similarity_join(_vectors(spark, sf_dir, FAMILIES[family]), 5, _lsh(family))


def _lsh_selectivity(family: str):
    return lambda spark, sf_dir: avg_selectivity(_vectors(spark, sf_dir, FAMILIES[family]), _lsh(family))


def _projected(kind):
    def query(spark, sf_dir):
        made = kind(64, 3, seed=5).column(F.col("vec"))
        return _vectors(spark, sf_dir).select("id", F.posexplode(made).alias("k", "value"))

    return query


def hadamard_transpose(spark, sf_dir):
    e = to_entries(_vectors(spark, sf_dir), "id", "vec")
    return hadamard(e.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value"), transpose(e).select(F.col("i").cast("long").alias("i"), "j", "value"))


def _reeb() -> ReebDiagram:
    return ReebDiagram("id", "cover_id", "vec", "cluster_id", K, LINK, CORE)


def _points(spark, sf_dir) -> tuple[DataFrame, int]:
    t = _vectors(spark, sf_dir).withColumn("lens", F.get("vec", F.lit(0)))
    model = Cover(["lens"], "cover_id", SPLITS, OVERLAP, exploding=True, id_col="id").fit(t)
    return model.transform(t), model.num_cubes


def _graph(spark, sf_dir) -> DataFrame:
    r = _reeb()
    return r.graph(r.neighbours(r.numbered(*_points(spark, sf_dir))))


def mutual_knn(spark, sf_dir):
    return _graph(spark, sf_dir).select("i", "j")


def snn_similarity(spark, sf_dir):
    return _graph(spark, sf_dir)


def snn_density(spark, sf_dir):
    return _reeb().density(_graph(spark, sf_dir))


def core_edges(spark, sf_dir):
    return _reeb().edges(_graph(spark, sf_dir))


def snn_components(spark, sf_dir):
    return _reeb().labels(core_edges(spark, sf_dir))


def reeb_clusters(spark, sf_dir):
    points, n = _points(spark, sf_dir)
    return _reeb().transform(points, n).select("id", "cover_id", "cluster_id")


def reeb_leaf_clusters(spark, sf_dir):
    """Clusters of the vectors' first three components by a fitted model, whose trees and buffer find the neighbours."""
    points = materialize(_head(_points(spark, sf_dir)[0]), "cells")
    return replace(_reeb(), search="leaves").fit(points).transform(points).select("id", "cover_id", "cluster_id")


def _mapper(spark, sf_dir, label_col=None) -> M.MapperGraph:
    t = _vectors(spark, sf_dir).withColumn("first", F.get("vec", F.lit(0)))
    return M.mapper(t, "id", "vec", ["first"], num_splits=SPLITS, overlap_ratio=OVERLAP, k=K, link_threshold_ratio=LINK, core_threshold_ratio=CORE, label_col=label_col)


def mapper_nodes(spark, sf_dir):
    n = _mapper(spark, sf_dir).nodes
    return n.withColumn("lens_mean", F.round("lens_mean", 9))


def mapper_edges(spark, sf_dir):
    return _mapper(spark, sf_dir).edges


def mapper_labels(spark, sf_dir):
    return M.dominant_labels(_mapper(spark, sf_dir).members, "label")


def remove_noise(spark, sf_dir):
    return M.remove_small_clusters(reeb_clusters(spark, sf_dir), "cluster_id", 0.02)


def relabelled(spark, sf_dir):
    return M.relabel(reeb_clusters(spark, sf_dir), "cluster_id")


def radius_by_label(spark, sf_dir):
    r = mean_radius(_vectors(spark, sf_dir), 5, "euclidean", "id", "vec", "label")
    return r.select(F.col("g").cast("int").alias("label"), F.round("radius", 9).alias("radius"))


def buffer_size(spark, sf_dir):
    return spark.createDataFrame([(round(estimate_buffer_size(_vectors(spark, sf_dir), 5), 6),)], "buffer double")


def snn_join_clusters(spark, sf_dir):
    return M.shared_neighbor_clusters(_vectors(spark, sf_dir), 5, 0.4)


def baseline_kmeans(spark, sf_dir):
    return M.kmeans(_vectors(spark, sf_dir), "vec", 10, 20).select("id", "cluster_id")


def baseline_gmm(spark, sf_dir):
    return M.gaussian_mixture(_vectors(spark, sf_dir), "vec", 3, 20).select("id", "cluster_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        mapper_nodes, mapper_edges, mapper_labels, reeb_clusters, reeb_leaf_clusters, snn_components, core_edges, snn_density, snn_similarity, mutual_knn,
        cover_fit_minmax, cover_cubes_1d, cover_cubes_2d, cover_assign_array, cover_assign_2d, cover_assign_vector, cover_explode_count, cover_population_2d, cover_closed,
        interval_contains, interval_intersects, cube_intersects, cube_contains, index_leaf_sizes, leaf_partitions, cover_saved, pipeline_clusters, knn_sparse_euclidean, basket_knn, l1_estimates, pca_variance, kmeans_invariants, gmm_invariants, knn_pred, knn_sampled, hadamard_transpose, remove_noise, relabelled, radius_by_label, buffer_size, snn_join_clusters, baseline_kmeans, baseline_gmm,
    ]
    out = {f.__name__: f for f in plain}
    out |= {f"dist_{m}": _distances(m) for m in MEASURES} | {f"knn_{m}": _knn(m) for m in MEASURES}
    out |= {f"dist_sparse_{m}": _sparse_distances(m) for m in MEASURES} | {f"set_knn_{m}": _set_knn(m) for m in ("jaccard", "hamming")}
    out |= {f"leaf_knn_{m}": _leaf_knn(m) for m in MEASURES}
    out |= {f"lsh_{f}_knn": _lsh_knn(f) for f in FAMILIES} | {f"lsh_{f}_selectivity": _lsh_selectivity(f) for f in FAMILIES}
    return out | {"projection_gaussian": _projected(GaussianProjection), "projection_cauchy": _projected(CauchyProjection)}
