import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from nervemap.functions.projection import CauchyProjection
from nervemap.functions.vectors import pairwise
from nervemap.ml import CoverStage, CoverStageModel, ReebStage
from nervemap.operators import mapper as M
from nervemap.operators.cover import Cover
from nervemap.operators.pca import principal_components
from nervemap.operators.reeb import ReebDiagram
from nervemap.sources.points import to_gexf, write_gexf


def rings(n=90):
    draw = np.random.default_rng(2)
    a = draw.uniform(0, 2 * math.pi, n)
    return np.stack([4 * np.cos(a), np.sin(a), draw.normal(0, 0.05, n)], axis=1)


def test_a_saved_pipeline_gives_the_same_graph(spark, tmp_path):
    v = rings()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").select("id", array_to_vector("vec").alias("vec"))
    stages = [PCA(k=1, inputCol="vec", outputCol="pc"), CoverStage(inputCols=["pc"], outputCol="cover_id", numSplits=3, overlapRatio=0.4, exploding=True), ReebStage(featuresCol="vec", k=6, linkThresholdRatio=0.3, coreThresholdRatio=0.4, topTreeSize=50, bufferSize=0.2)]
    Pipeline(stages=stages).write().save(str(tmp_path / "plain"))
    made = Pipeline.load(str(tmp_path / "plain")).fit(df)
    made.write().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    members = lambda m: m.transform(df).withColumn("lens", F.col("pc").cast("string"))
    rows = lambda m: Counter((r["id"], r["cover_id"], r["cluster_id"]) for r in members(m).collect())
    want = rows(made)
    assert rows(again) == want and len(want) > 90 and again.stages[1].value("low") == made.stages[1].value("low")
    assert {r["node"] for r in again.stages[2].nodes.collect()} == {r["node"] for r in made.stages[2].nodes.collect()}
    plain = made.stages[0].transform(df)
    cover = Cover(["pc"], "cover_id", 3, 0.4, exploding=True).fit(plain)
    direct = ReebDiagram(features_col="vec", k=6, link_threshold_ratio=0.3, core_threshold_ratio=0.4).transform(cover.transform(plain), cover.num_cubes)
    assert Counter((r["id"], r["cover_id"], r["cluster_id"]) for r in direct.collect()) == want
    assert again.stages[2].copy({again.stages[2].getParam("k"): 4}).model().params.k == 4
    assert CoverStageModel(low=[0.0], high=[1.0]).set_params(inputCols=["x"]).model().num_cubes == 10


def test_principal_components(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 12)) @ np.diag([5, 3, 2, *[0.5] * 9]) @ np.linalg.qr(draw.normal(size=(12, 12)))[0] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, vec array<double>").repartition(3)
    found = principal_components(df, "vec", 3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(found.variance, values[::-1][:3]) and math.isclose(found.total, values.sum()) and found.rounds < 40
    assert np.allclose(np.abs(found.components @ vectors[:, ::-1][:, :3]), np.eye(3), atol=1e-5)
    assert all(row[np.abs(row).argmax()] > 0 for row in found.components)
    got = {r["id"]: r["p"] for r in M.with_pca(df, "vec", 3, "p").collect()}
    assert np.allclose([got[i] for i in range(400)], (x - x.mean(axis=0)) @ found.components.T, atol=1e-6) and got[900] is None
    for bad in (0, 13):
        with pytest.raises(ValueError):
            principal_components(df, "vec", bad)


def test_sketches_estimate_distances(spark):
    x = np.random.default_rng(6).normal(size=(60, 20))
    sketch = CauchyProjection(20, 401, seed=3)
    df = spark.createDataFrame([(i, (s := sketch.apply(v)).tolist()) for i, v in enumerate(x)], "id long, s array<double>")
    pairs = df.alias("a").join(df.alias("b"), F.col("a.id") + 1 == F.col("b.id"))
    got = pairs.select(F.col("a.id"), sketch.estimate(F.col("a.s"), F.col("b.s")).alias("d")).collect()
    d = pairwise("manhattan", x, x)
    off = np.array([abs(r["d"] / d[r["id"], r["id"] + 1] - 1) for r in got])
    assert len(off) == 59 and np.mean(off < 1.6 / 401**0.5) > 0.6 and off.max() < 0.5
    even = CauchyProjection(20, 4)
    one = df.limit(1).select(even.estimate(F.array(*map(F.lit, (0.0, 1.0, 5.0, 9.0))), F.array(*[F.lit(0.0)] * 4)).alias("d")).first()
    assert one["d"] == 3.0


def test_graph_files(spark, tmp_path):
    names = ["1,2", None, "a<b&\"c\"", "it's", "both \" and '", "tab\there"]
    nodes = spark.createDataFrame([(i * 7 % 60, i / 60, 10 + i, names[i % 6]) for i in range(60)], "cluster_id long, lens_mean double, cardinality long, node_label string").repartition(4)
    edges = spark.createDataFrame([(i, j, i + j) for i in range(20) for j in range(i + 1, 20)], "src long, dst long, cardinality long").repartition(3)
    write_gexf(nodes, edges, f"file://{tmp_path}/g.gexf")
    assert (tmp_path / "g.gexf").read_text() == to_gexf(nodes, edges)
    write_gexf(nodes.drop("node_label").limit(0), edges.limit(0), f"file://{tmp_path}/none.gexf")
    assert (tmp_path / "none.gexf").read_text() == to_gexf(nodes.drop("node_label").limit(0), edges.limit(0))


def test_baselines_keep_what_they_say(spark):
    df = spark.createDataFrame([(i, [float(i % 2 * 10) + 0.01 * i, float(i % 3)]) for i in range(30)], "id long, vec array<double>")
    rows = M.kmeans(df, "vec", 2, distances_col="d").collect()
    assert all(r["d"][r["cluster_id"] - 1] == min(r["d"]) and len(r["d"]) == 2 for r in rows)
    rows = M.gaussian_mixture(df, "vec", 2, probabilities_col="q").collect()
    assert all(math.isclose(sum(r["q"]), 1) and r["q"][r["cluster_id"] - 1] == max(r["q"]) for r in rows)
