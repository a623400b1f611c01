"""Mapper: a lens, a cover of it, clusters in every cell, and the graph of clusters that share rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nervemap.functions.vectors import as_array, ertoz, euclidean
from nervemap.operators.cover import Cover
from nervemap.operators.graph import connected_components
from nervemap.operators.lsh import Lsh, approx_similarity_join
from nervemap.operators.neighbors import similarity_join
from nervemap.operators.pca import principal_components
from nervemap.operators.reeb import ReebDiagram
from nervemap.runtime import materialize, numbered


@dataclass
class MapperGraph:
    members: DataFrame
    nodes: DataFrame
    edges: DataFrame


def remove_noise_clusters(members: DataFrame) -> DataFrame:
    """Rows in a cluster; noise has negative numbers."""
    return members.where("cluster_id >= 0")


def nerve_nodes(members: DataFrame, lens_col: str = "lens") -> DataFrame:
    """(cluster_id, lens_mean, cardinality): the mean of the lens, scaled to 0..1 over all rows (a half if it is constant), and the rows."""
    ends = members.agg(F.min(lens_col).alias("_low"), F.max(lens_col).alias("_high"))
    kept = remove_noise_clusters(members).groupBy("cluster_id").agg(F.avg(lens_col).alias("_mean"), F.count(F.lit(1)).alias("cardinality"))
    width = F.col("_high") - F.col("_low")
    scaled = F.when(width > 0, (F.col("_mean") - F.col("_low")) / F.when(width > 0, width)).otherwise(F.lit(0.5))
    return kept.withColumn("_", F.lit(0)).join(F.broadcast(ends.withColumn("_", F.lit(0))), "_").select("cluster_id", scaled.alias("lens_mean"), "cardinality")


def nerve_edges(members: DataFrame, id_col: str = "id") -> DataFrame:
    """(src, dst, cardinality): pairs of clusters, smaller first, and the rows that both have. A row is in few cells."""
    own = remove_noise_clusters(members).select(id_col, "cluster_id").distinct()
    sets = own.groupBy(id_col).agg(F.sort_array(F.collect_list("cluster_id")).alias("c"))
    firsts = sets.where(F.size("c") > 1).select("c", F.posexplode("c").alias("n", "src"))
    return firsts.select("src", F.explode(F.slice("c", F.col("n") + 2, F.size("c"))).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cardinality"))


def dominant_labels(members: DataFrame, label_col: str) -> DataFrame:
    """(cluster_id, node_label): labels that at least an even share of a cluster's rows bear, sorted, joined by commas."""
    counts = remove_noise_clusters(members).where(F.col(label_col).isNotNull()).groupBy("cluster_id", F.col(label_col).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.groupBy("cluster_id").agg(F.floor(F.sum("_n") / F.count(F.lit(1))).alias("_least"))
    kept = counts.join(sums, "cluster_id").where(F.col("_n") >= F.col("_least"))
    return kept.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list("_label")).cast("array<string>"), ",").alias("node_label"))


def with_pca(df: DataFrame, vec_col: str, n_components: int, output_col: str = "pca") -> DataFrame:
    """``df`` with its first principal components, as an array."""
    found = principal_components(df, vec_col, n_components)
    return df.withColumn(output_col, found.column(as_array(df, vec_col)))


def mapper(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "features",
    lens_cols: Sequence[str] | None = None,
    n_components: int = 1,
    num_splits: int = 10,
    overlap_ratio: float = 0.1,
    k: int = 5,
    link_threshold_ratio: float = 0.4,
    core_threshold_ratio: float = 0.7,
    measure: str = "euclidean",
    label_col: str | None = None,
) -> MapperGraph:
    """Members (input, cell, lens, cluster), nodes and edges. Without ``lens_cols`` the lens is the first principal components."""
    if lens_cols is None:
        df, lens_cols = with_pca(df, vec_col, n_components), ["pca"]
    model = Cover(lens_cols, "cover_id", num_splits, overlap_ratio, exploding=True, id_col=id_col).fit(df)
    rows = model.transform(df).withColumn("lens", F.get(as_array(df, lens_cols[0]), F.lit(0)))
    reeb = ReebDiagram(id_col, "cover_id", vec_col, "cluster_id", k, link_threshold_ratio, core_threshold_ratio, measure)
    members = reeb.transform(rows, model.num_cubes)
    nodes = nerve_nodes(members)
    if label_col:
        nodes = nodes.join(dominant_labels(members, label_col), "cluster_id", "left")
    return MapperGraph(members, nodes, nerve_edges(members, id_col))


def shared_neighbor_clusters(df: DataFrame, k: int, ratio: float = 0.5, measure: str = "euclidean", lsh: Lsh | None = None, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(vertex, cluster_id): clusters of the k nearest neighbours' graph, by one similarity join, exact or hashed.

    Neighbours i and j are linked if at least k * ratio of the k nearest of each are shared; cluster_id is the smallest id that links reach.
    Rows without a link are no cluster and aren't there.
    """
    pairs = similarity_join(df, k, measure, id_col, vec_col) if lsh is None else approx_similarity_join(df, k, lsh, id_col, vec_col)
    pairs = materialize(pairs.select("i", "j"), "neighbours")
    lists = pairs.groupBy("i").agg(F.collect_list("j").alias("own"))  # k entries
    both = pairs.join(lists, "i").join(lists.withColumnsRenamed({"i": "j", "own": "other"}), "j")
    links = both.where(ertoz(F.col("own"), F.col("other")) >= k * ratio).select("i", "j")
    return connected_components(links, "i", "j").withColumnRenamed("component", "cluster_id")


def remove_small_clusters(df: DataFrame, cluster_col: str = "cluster_id", ratio: float = 0.001) -> DataFrame:
    """Rows of clusters of more than ``ratio`` of all rows, with clusters renumbered from 1 in order."""
    sizes = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    # a row a cluster that holds more than ``ratio`` of the rows: fewer than 1 / ratio
    kept = sizes.where(F.col("_n") > total * ratio).select(cluster_col, F.dense_rank().over(Window.orderBy(cluster_col)).cast("long").alias("_new"))
    return df.join(kept, cluster_col).withColumn(cluster_col, F.col("_new")).drop("_new")


def relabel(df: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Clusters renumbered from 1 in order, noise of any kind being one of them."""
    one = F.when(F.col(cluster_col) < 0, F.lit(-1)).otherwise(F.col(cluster_col)).cast("long")
    names, _ = numbered(df.select(one.alias("_old")).distinct(), "_old", name="clusters")
    names = names.select("_old", (F.col("_row") + 1).alias("_new"))
    return df.withColumn("_old", one).join(names, "_old").withColumn(cluster_col, F.col("_new")).drop("_old", "_new")


def sample_down(df: DataFrame, fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """A sample with replacement."""
    return df.sample(True, fraction, seed)


def _clustered(df: DataFrame, vec_col: str, make) -> DataFrame:
    """``df`` with what the fitted model predicts, as ``cluster_id`` from 1, and the model's probabilities or distances as an array ``_q``."""
    from pyspark.ml.functions import array_to_vector

    held = df.withColumn("_v", array_to_vector(as_array(df, vec_col)))
    return make(held).withColumn("cluster_id", F.col("_p").cast("long") + 1)


def kmeans(df: DataFrame, vec_col: str, k: int, iterations: int = 100, seed: int = 0, distances_col: str | None = None) -> DataFrame:
    """``df`` with ``cluster_id`` from 1, by K-Means, and, if it has a name, the distances to all centres."""
    from pyspark.ml.clustering import KMeans

    model = None

    def fitted(held: DataFrame) -> DataFrame:
        nonlocal model
        model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_v", predictionCol="_p").fit(held)
        return model.transform(held)

    out = _clustered(df, vec_col, fitted)
    if distances_col:
        centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
        out = out.withColumn(distances_col, F.transform(centres, lambda c: euclidean(c, as_array(df, vec_col))))
    return out.drop("_v", "_p")


def gaussian_mixture(df: DataFrame, vec_col: str, k: int, iterations: int = 100, seed: int = 0, probabilities_col: str | None = None) -> DataFrame:
    """``df`` with ``cluster_id`` from 1, by a Gaussian mixture, and, if it has a name, the probabilities of all components."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array

    out = _clustered(df, vec_col, lambda held: GaussianMixture(k=k, maxIter=iterations, seed=seed, featuresCol="_v", predictionCol="_p", probabilityCol="_q").fit(held).transform(held))
    if probabilities_col:
        out = out.withColumn(probabilities_col, vector_to_array("_q"))
    return out.drop("_v", "_p", "_q")
