import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import nervemap.runtime as R
from nervemap.functions.vectors import pairwise
from nervemap.operators import mapper as M
from nervemap.operators.graph import connected_components
from nervemap.operators.reeb import PAIR_BYTES, ReebDiagram, buffer_size, estimate_buffer_size, mean_radius, repartition_by_leaf
from nervemap.operators.vptree import VPTree
from nervemap.runtime import numbered
from nervemap.sources.points import read_labelled, read_points, to_gexf, write_tsv


def spiral(n=60):
    """Three arms, the same shape turned by a third of a circle."""
    out = []
    for arm in range(3):
        for t in np.linspace(0.6, 3.4, n):
            a = t * 1.6 + arm * 2 * math.pi / 3
            out.append((len(out), [float(t * math.cos(a)), float(t * math.sin(a))], arm))
    return out


def components(pairs):
    label = {v: v for p in pairs for v in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def clusters(points, k, link, core):
    ids, v = [p[0] for p in points], np.array([p[1] for p in points])
    d = pairwise("euclidean", v, v)
    near = {i: {j for _, j in sorted((d[a, b], j) for b, j in enumerate(ids))[:k]} for a, i in enumerate(ids)}
    graph = {(i, j): len(near[i] & near[j]) for i in ids for j in near[i] if i in near[j]}
    dense = Counter(i for (i, _), s in graph.items() if s > k * link)
    kept = [(i, j) for (i, j), s in graph.items() if s > k * link and dense[i] > k * core]
    label = components(kept)
    return {i: label.get(i, -1) for i in ids}


@pytest.mark.parametrize("k,link,core", [(8, 0.4, 0.7), (5, 0.5, 0.9), (3, 0.3, 0.3)])
def test_spiral(spark, k, link, core):
    points = spiral()
    df = spark.createDataFrame(points, "id long, features array<double>, arm int").withColumn("cover_id", F.lit(0))
    got = ReebDiagram(k=k, link_threshold_ratio=link, core_threshold_ratio=core).transform(df)
    assert got.columns == [*df.columns, "cluster_id"]
    assert {r["id"]: r["cluster_id"] for r in got.collect()} == clusters(points, k, link, core)
    if (k, link, core) == (8, 0.4, 0.7):
        assert len({(r["arm"], r["cluster_id"]) for r in got.collect()}) == 3


def test_noise_is_named_by_its_cell(spark):
    df = spark.createDataFrame([(1, [0.0], 4), (2, [9.0], 4)], "id long, features array<double>, cover_id int")
    got = ReebDiagram(k=5, link_threshold_ratio=1.0, core_threshold_ratio=1.0).transform(df)
    assert {r["cluster_id"] for r in got.collect()} == {-5}
    for bad in ({"k": 0}, {"link_threshold_ratio": 0.0}, {"core_threshold_ratio": 1.1}, {"measure": "x"}):
        with pytest.raises(ValueError):
            ReebDiagram(**bad)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")
    want = components([p for p in pairs if p[0] != p[1]])
    assert {r["vertex"]: r["component"] for r in connected_components(df).collect()} == want
    assert connected_components(df.where("false")).count() == 0


def test_radius_and_buffer(spark):
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 0, 1, 3])], "id long, vec array<double>")
    # second nearest of those that are not at distance 0; the farthest where there are fewer
    assert mean_radius(df, 2, "euclidean").first()["radius"] == pytest.approx((3 + 3 + 1 + 3) / 4)
    assert buffer_size([10, 100], [1.0, 0.1], 1000) == pytest.approx(0.01)
    assert buffer_size([10, 100], [0.1, 1.0], 1000) == pytest.approx(1.0)
    assert buffer_size([10, 10], [0.1, 0.3], 1000) == pytest.approx(0.3)
    many = spark.range(600).select("id", F.array(F.rand(1), F.rand(2)).alias("vec"))
    assert 0 < estimate_buffer_size(many, 3, sample_sizes=(100, 200, 300)) < 1
    with pytest.raises(ValueError):
        estimate_buffer_size(many, 3, sample_sizes=(100,))


def test_mapper(spark):
    df = spark.createDataFrame(spiral(), "id long, features array<double>, arm int").withColumn("x", F.get("features", F.lit(0)))
    g = M.mapper(df, lens_cols=["x"], num_splits=3, overlap_ratio=0.5, k=6, core_threshold_ratio=0.5, label_col="arm")
    rows = g.members.collect()
    kept = [r for r in rows if r["cluster_id"] >= 0]
    sizes = Counter(r["cluster_id"] for r in kept)
    low, high = min(r["lens"] for r in rows), max(r["lens"] for r in rows)
    nodes = {r["cluster_id"]: r for r in g.nodes.collect()}
    assert {c: r["cardinality"] for c, r in nodes.items()} == sizes and len(sizes) > 2
    for c, r in nodes.items():
        own = [m for m in kept if m["cluster_id"] == c]
        assert r["lens_mean"] == pytest.approx((sum(m["lens"] for m in own) / len(own) - low) / (high - low))
        arms = Counter(m["arm"] for m in own)
        assert r["node_label"] == ",".join(str(a) for a in sorted(arms) if arms[a] >= len(own) // len(arms))
    by_id = {}
    for r in kept:
        by_id.setdefault(r["id"], set()).add(r["cluster_id"])
    want = Counter((a, b) for s in by_id.values() for a in s for b in s if a < b)
    assert {(r["src"], r["dst"]): r["cardinality"] for r in g.edges.collect()} == want
    text = to_gexf(g.nodes, g.edges)
    assert text.count("<node ") == len(sizes) and text.count("<edge ") == len(want)
    pca = M.mapper(df, num_splits=2, k=4, n_components=1)
    assert pca.members.count() >= 180


def test_colours():
    from nervemap.sources.points import ramp

    assert [ramp(x) for x in (-1, 0, 0.25, 0.5, 0.75, 1, 2)] == [(0, 0, 255), (0, 0, 255), (0, 128, 127), (0, 255, 0), (127, 128, 0), (255, 0, 0), (255, 0, 0)]


def test_fit_gives_a_model(spark):
    points = spiral()
    df = spark.createDataFrame([(i, v, a, i % 2) for i, v, a in points], "id long, features array<double>, arm int, cover_id int").withColumn("_v", F.lit("mine"))
    reeb = ReebDiagram(k=6, top_tree_size=40, top_tree_leaf_size=7, buffer_size_samples=(40, 80, 120))
    model = reeb.fit(df)
    assert model.num_cubes == 2 and model.buffer_size > 0
    nodes = model.nodes.collect()
    assert {r["g"] for r in nodes} == {"0", "1"} and all(sum(r["leaf"] is not None for r in nodes if r["g"] == g) >= 40 / 7 for g in "01")
    assert ReebDiagram(buffer_size=0.5).fit(df).buffer_size == 0.5
    same = lambda a, b: Counter(map(tuple, a.drop("_v", "features").collect())) == Counter(map(tuple, b.drop("_v", "features").collect()))
    assert same(model.transform(df), reeb.transform(df))
    assert same(model.copy(k=4).transform(df), ReebDiagram(k=4).transform(df))
    more = df.unionByName(df.limit(1).withColumn("cover_id", F.lit(9)))
    got = model.by_leaf(more).withColumn("p", F.spark_partition_id()).collect()
    assert len(got) == len(points) + 1 and all(r["_v"] == "mine" for r in got)
    assert {r["leaf"] is None for r in got if r["cover_id"] == 9} == {True}
    trees = {g: VPTree.of_nodes([r.asDict() for r in nodes if r["g"] == g], "euclidean") for g in "01"}
    before = {"0": 0, "1": trees["0"].leaves}
    assert all(r["leaf"] == before[str(r["cover_id"])] + trees[str(r["cover_id"])].leaf_of(r["features"]) for r in got if r["cover_id"] != 9)
    assert all(r["p"] == (model.num_leaves if r["leaf"] is None else r["leaf"]) for r in got)
    with pytest.raises(Exception, match="is no leaf"):
        repartition_by_leaf(model.leaves(df).withColumn("leaf", F.lit(1000)), "leaf", 3).count()
    by_leaves = ReebDiagram(k=6, top_tree_size=40, top_tree_leaf_size=7, buffer_size=0.3, search="leaves").fit(df)
    assert same(by_leaves.transform(df), reeb.transform(df))
    assert same(by_leaves.copy(measure="cosine").transform(df), ReebDiagram(k=6, measure="cosine").transform(df))
    assert reeb.fit(df.where("false")).num_cubes == 1
    for bad in ({"top_tree_size": 0}, {"buffer_size": -2.0}, {"buffer_size_samples": (100,)}, {"num_vp_samples": 0}):
        with pytest.raises(ValueError):
            ReebDiagram(**bad)


@pytest.mark.parametrize("search", ["blocks", "leaves"])
def test_rows_without_features_are_noise(spark, search):
    points = spiral(20)
    rows = [(i, v, 0) for i, v, _ in points]
    df = lambda r: spark.createDataFrame(r, "id long, features array<double>, cover_id int")
    want = {r["id"]: r["cluster_id"] for r in ReebDiagram(k=5).transform(df(rows)).collect()}
    got = {r["id"]: r["cluster_id"] for r in ReebDiagram(k=5, search=search).transform(df([*rows, (100, None, 0)])).collect()}
    assert got == want | {100: -1}
    with pytest.raises(Exception, match="differ in length"):
        ReebDiagram(k=5, search=search).transform(df([*rows, (100, [1.0], 0)])).collect()


def test_ids_of_any_kind(spark):
    points = spiral(20)
    plain = ReebDiagram(k=5).transform(spark.createDataFrame([(i, v, 0) for i, v, _ in points], "id long, features array<double>, cover_id int"))
    want = Counter(r["cluster_id"] for r in plain.collect())
    high = spark.createDataFrame([((1 << 62) + i, v, 0) for i, v, _ in points], "id long, features array<double>, cover_id int").withColumn("cover_id", F.lit(0))
    names = spark.createDataFrame([(f"p{i:03d}", v, 0) for i, v, _ in points], "id string, features array<double>, cover_id int")
    for df in (high, names):
        got = ReebDiagram(k=5).transform(df, num_cubes=7)
        assert sorted(Counter(r["cluster_id"] for r in got.collect()).values()) == sorted(want.values())


def test_clusters_over_a_join(spark):
    points = spiral()
    df = spark.createDataFrame([(i, v) for i, v, _ in points], "id long, vec array<double>")
    d = pairwise("euclidean", *(np.array([p[1] for p in points]),) * 2)
    near = {i: {j for _, j in sorted((d[i, j], j) for j in range(len(points)) if j != i)[:6]} for i in range(len(points))}
    want = components([(i, j) for i in near for j in near[i] if len(near[i] & near[j]) >= 3])
    got = {r["vertex"]: r["cluster_id"] for r in M.shared_neighbor_clusters(df, 6, 0.5).collect()}
    assert got == want and len(set(got.values())) >= 3


def test_constant_lens_is_a_half(spark):
    m = spark.createDataFrame([(1, 1.0, 3), (2, 1.0, 3)], "id long, lens double, cluster_id long")
    assert M.nerve_nodes(m).first()["lens_mean"] == 0.5


def test_cluster_utilities(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([5] * 6 + [9] * 3 + [-1, -2])], "id long, cluster_id long")
    assert Counter(r["cluster_id"] for r in M.remove_small_clusters(df, ratio=0.2).collect()) == {1: 6, 2: 3}
    assert Counter(r["cluster_id"] for r in M.relabel(df).collect()) == {1: 2, 2: 6, 3: 3}
    assert M.sample_down(df, 0.5, 1).count() <= 22
    pts = spark.createDataFrame([(i, [float(i % 2 * 10) + 0.01 * i, float(i % 3)]) for i in range(30)], "id long, vec array<double>")
    for f in (M.kmeans, M.gaussian_mixture):
        got = f(pts, "vec", 2)
        assert {r["cluster_id"] for r in got.collect()} == {1, 2} and got.columns == ["id", "vec", "cluster_id"]


def test_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1.5 2 x\n\n  -1\t0 y\n")
    got = read_points(spark, str(tmp_path / "p.txt")).orderBy("id").collect()
    assert [(r["id"], r["features"]) for r in got] == [(0, [-1.0, 0.0]), (1, [1.5, 2.0])]
    (tmp_path / "l.txt").write_text("7 0:1.5 2:3\n5 1:2\n")
    got = read_labelled(spark, str(tmp_path / "l.txt"), 3).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, 5, [0.0, 2.0, 0.0]), (1, 7, [1.5, 0.0, 3.0])]
    write_tsv(spark.createDataFrame([(1, "a")], "i int, s string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1\ta"


def test_numbering(spark):
    df = spark.createDataFrame([(i % 3, "x") for i in range(31)], "k int, s string").repartition(5)
    out, n = numbered(df, "k")
    rows = sorted((r["_row"], r["k"]) for r in out.collect())
    assert n == 31 and [r for r, _ in rows] == list(range(31)) and [k for _, k in rows] == sorted(k for _, k in rows)
    out, n = numbered(df.where("false"), "k")
    assert n == 0 and out.count() == 0


def _numberings(n):
    draw = np.random.default_rng(2)
    return {"ascending": np.arange(n), "descending": np.arange(n)[::-1], "random": draw.permutation(n)}


@pytest.mark.parametrize("order", ["ascending", "descending", "random"])
def test_long_paths_take_few_rounds(spark, order, monkeypatch):
    import nervemap.operators.graph as G

    name = _numberings(10_000)[order]
    path = spark.createDataFrame([(int(a), int(b)) for a, b in zip(name, name[1:])], "src long, dst long")
    assert {r["component"] for r in connected_components(path).collect()} == {0}  # by one task
    rounds, contracted = [], G._contracted
    monkeypatch.setattr(G, "FINISH", 0)
    monkeypatch.setattr(G, "_contracted", lambda rest: rounds.append(1) or contracted(rest))
    found = connected_components(path)
    assert found.count() == 10_000 and {r["component"] for r in found.select("component").distinct().collect()} == {0}
    assert len(rounds) <= 20


@pytest.mark.parametrize("finish", [0, 40, 1_000_000])
def test_components_of_any_shape(spark, finish, monkeypatch):
    import nervemap.operators.graph as G

    monkeypatch.setattr(G, "FINISH", finish)
    draw = np.random.default_rng(8)
    star = [(1000, 1001 + i) for i in range(60)] + [(2000 + i, 2090) for i in range(60)]
    cycle = [(3000 + i, 3000 + (i + 1) % 45) for i in range(45)]
    some = [tuple(map(int, x)) for x in draw.integers(0, 150, (110, 2))]
    pairs = [*star, *cycle, *some]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3), (4, None)], "src long, dst long")
    want = {v: c for v, c in components([p for p in pairs if p[0] != p[1]]).items()}
    assert {r["vertex"]: r["component"] for r in connected_components(df).collect()} == want
    names = df.where("src < 150").selectExpr("concat('v', lpad(src, 4, '0')) AS src", "concat('v', lpad(dst, 4, '0')) AS dst")
    got = {r["vertex"]: r["component"] for r in connected_components(names).collect()}
    assert got == {f"v{v:04d}": f"v{c:04d}" for v, c in want.items() if v < 150}


def test_graph_is_dealt_by_its_pairs(spark, monkeypatch):
    """Joins of neighbours get partitions by the number of pairs, beyond those of the session; the graph is the one by definition, with a point that all have for a neighbour."""
    monkeypatch.setattr(R, "TASK_BYTES", 1024)
    draw, k = np.random.default_rng(8), 4
    own = {i: {i, 0} | set(draw.choice(50, k - 2, replace=False).tolist()) for i in range(50)}
    pairs = spark.createDataFrame([(i, j) for i, js in own.items() for j in js], "i long, j long")
    got = ReebDiagram(k=k).graph(pairs)
    assert got.rdd.getNumPartitions() == pairs.count() * (PAIR_BYTES + 8 * k) // 1024 > R.partitions(spark)
    want = {(i, j, len(own[i] & own[j])) for i in own for j in own[i] if i in own[j]}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_of_a_graph_stay_apart(spark, monkeypatch):
    """Pairs for more than one task aren't merged into one because they are small when compressed, where the session has partitions enough."""
    k = 4
    pairs = spark.createDataFrame([(i, j) for i in range(50) for j in range(i // k * k, i // k * k + k)], "i long, j long")
    monkeypatch.setattr(R, "TASK_BYTES", pairs.count() * (PAIR_BYTES + 8 * k) // 2)
    had = R.partitions(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # unlike the number of tasks that read a table
    try:
        got = ReebDiagram(k=k).graph(pairs)
        assert got.rdd.getNumPartitions() == 7
        assert {r["sim"] for r in got.where("i < 48").collect()} == {k}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(had))
