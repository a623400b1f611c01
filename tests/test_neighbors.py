from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import nervemap.operators.metric_index as X
import nervemap.operators.neighbors as N
import nervemap.runtime as R
from nervemap.functions.vectors import MEASURES, pairwise
from nervemap.operators.lsh import FAMILIES, Lsh, approx_similarity_join, avg_selectivity
from nervemap.operators.matrix import hadamard, to_entries, to_rows, transpose
from nervemap.operators.metric_index import leaf_nearest
from nervemap.operators.vptree import LeafPartitioner, TopTrees, VPTree

RNG = np.random.default_rng(4)
VECTORS = np.round(RNG.normal(0, 2, (40, 6))) + 0.0
VECTORS[:, 0] = 1.0  # no empty support, no zero vector
VECTORS[7] = VECTORS[8]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(VECTORS)] + [(None, VECTORS[0].tolist()), (99, None)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def brute(d, k, allowed=lambda i, j: True):
    out = set()
    for i in range(len(d)):
        near = sorted((d[i, j], j) for j in range(len(d)) if j != i and allowed(min(i, j), max(i, j)))
        out |= {(i, j, x) for x, j in near[:k]}
    return out


def rows(df):
    return {(r["i"], r["j"], r["value"]) for r in df.collect()}


@pytest.mark.parametrize("measure", list(MEASURES))
def test_exact_join(table, measure, monkeypatch):
    want = brute(pairwise(measure, VECTORS, VECTORS), 3)
    assert rows(N.similarity_join(table, 3, measure)) == want
    monkeypatch.setattr(N, "BLOCK", 7)  # many blocks
    assert rows(N.similarity_join(table, 3, measure)) == want


@pytest.mark.parametrize("measure", ["euclidean", "cosine"])
def test_bounds_leave_nothing_out(measure):
    """Real numbers, ties and near ties: what the bounds choose is what all distances give, bit for bit."""
    draw = np.random.default_rng(9)
    x = draw.normal(0, 1, (300, 17))
    x[50:90] = x[40] * (1 + 1e-16 * np.arange(40))[:, None]
    x[90:120] = x[41]
    x[120:130] *= 1e-9
    d = pairwise(measure, x, x)
    bound, off, _ = N._bounded(measure, x, x)
    ids = draw.permutation(300)
    allowed = ids[:, None] != ids[None, :]
    got = N._least(bound, ids, ids, allowed, 7, off, lambda a, b: N.of_pairs(measure, x[a], x[b]))
    want = N._least(d, ids, ids, allowed, 7, None, None)
    assert all(np.array_equal(g, w) for g, w in zip(got, want, strict=True))


def test_vectors_of_unequal_length(spark):
    """2, 1, 3 and 2 components: 8 in all, first and last alike."""
    df = spark.createDataFrame([(i, [float(i)] * n) for i, n in enumerate((2, 1, 3, 2))], "id long, vec array<double>")
    for search in (lambda: N.similarity_join(df, 1), lambda: leaf_nearest(df.selectExpr("'' AS g", "id", "vec AS v"), 1)):
        with pytest.raises(Exception, match="differ in length"):
            search().collect()


def _groups(measure):
    draw = np.random.default_rng(6)
    if measure in ("hamming", "jaccard"):
        v = (draw.random((240, 9)) < 0.4) * draw.integers(1, 5, (240, 9)) + 0.0
        v[:, 0] = 1
    else:
        v = np.concatenate([draw.normal(c, 0.4, (60, 3)) for c in ((0, 1, 2), (5, 5, 5), (-4, 3, 0), (9, 0, 1))])
        v[200:208] = np.round(v[200:208])
    v[20:45] = v[19]  # copies
    return v, np.array(["a", "b", "a", "c"])[draw.integers(0, 4, 240)]


@pytest.mark.parametrize("measure", list(MEASURES))
@pytest.mark.parametrize("with_self,buffer", [(True, 0.0), (False, 0.4)])
def test_leaf_search(spark, measure, with_self, buffer, monkeypatch):
    """The same rows as all pairs give, whatever the pieces, on trees of the points or of others."""
    for name, size in (("MEET", 50), ("CANDIDATES", 16), ("VISITS", 20)):
        monkeypatch.setattr(X, name, size)
    v, g = _groups(measure)
    df = spark.createDataFrame([(str(a), i, x.tolist()) for i, (a, x) in enumerate(zip(g, v))] + [("a", 900, None), ("lone", 901, v[0].tolist())], "g string, id long, v array<double>").repartition(3)
    params = X.IndexParams(target=12, leaf_size=4, sub_leaf_size=3)
    want = Counter(map(tuple, N.nearest(df.withColumn("picked", F.lit(True)), 4, measure, with_self=with_self).collect()))
    index = X.MetricIndex.of(df, 4, measure, params)
    found, compared = index.search(buffer, with_self)
    assert Counter(map(tuple, found.collect())) == want
    if measure in ("euclidean", "manhattan"):
        assert sum(r["compared"] for r in compared.collect()) < 0.8 * sum(n * n for n in Counter(g.tolist()).values())
    if with_self:
        foreign = X.tree_nodes(df.where("g = 'a' and id % 3 = 0"), measure, params)
        assert Counter(map(tuple, leaf_nearest(df, 4, measure, with_self, buffer, params, foreign, most=9.0).collect())) == want
        assert Counter(map(tuple, leaf_nearest(df, 4, measure, with_self, buffer, params, most=0.0).collect())) == want


def test_nodes_are_the_tree():
    tree = VPTree(range(40), VECTORS, "euclidean", leaf_size=3)
    again = VPTree.of_nodes([dict(r) for r in tree.nodes()][::-1], "euclidean")
    assert again.leaves == tree.leaves and np.array_equal(again.leaves_of(VECTORS), tree.leaves_of(VECTORS))
    row, leaf, bound = again.bounds(VECTORS, np.full(40, 2.5))
    d = pairwise("euclidean", VECTORS, VECTORS)
    homes = tree.leaves_of(VECTORS)
    least = {(i, x): d[i][homes == x].min() for i in range(40) for x in range(tree.leaves)}
    assert {(i, x) for (i, x), m in least.items() if m <= 2.5} <= set(zip(row.tolist(), leaf.tolist()))
    assert all(b <= least[i, x] for i, x, b in zip(row.tolist(), leaf.tolist(), bound.tolist()))
    assert VPTree([], np.zeros((0, 2))).nodes() == [] and VPTree.of_nodes([], "cosine").root is None


def test_predicate_and_sample(table):
    d = pairwise("euclidean", VECTORS, VECTORS)
    got = rows(N.similarity_join(table, 3, pred=lambda a, b: a[..., 1] <= b[..., 1]))
    assert got == brute(d, 3, lambda i, j: VECTORS[i][1] <= VECTORS[j][1])
    picked = {i for i in range(40) if (i * 2654435761 + 5) % 1000003 < 0.4 * 1000003}
    assert rows(N.similarity_join(table, 3, fraction=0.4, seed=5)) == brute(d, 3, lambda i, j: i in picked)
    assert rows(N.similarity_join(table, 3, fraction=0.0)) == set()
    assert len(rows(N.similarity_join(table, 100))) == 40 * 39
    with pytest.raises(ValueError):
        N.similarity_join(table, 3, fraction=1.5)
    with pytest.raises(ValueError):
        N.similarity_join(table, 0)
    assert rows(N.similarity_join(table.where("false"), 3)) == set()


@pytest.mark.parametrize("family", list(FAMILIES))
def test_hashed_join(spark, table, family):
    v = VECTORS if family not in ("minhash", "bitsampling") else (VECTORS > 0).astype(float)
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    kw = {"minhash": {"num_bands": 2}, "pstable_l1": {"bucket_width": 20.0}, "pstable_l2": {"bucket_width": 6.0}}.get(family, {})
    few, many = Lsh(family, 6, 4, 1, seed=2, **kw), Lsh(family, 6, 4, 4, seed=2, **kw)
    exact = {(i, j): x for i, j, x in brute(pairwise(FAMILIES[family], v, v), 40)}
    buckets = {}
    for r in many.buckets(t).collect():
        buckets.setdefault((r["tbl"], r["band"], tuple(r["key"])), set()).add(r["id"])
    pairs = {(i, j) for b in buckets.values() for i in b for j in b}
    want = set()
    for i in range(40):
        want |= {(i, j, x) for x, j in sorted((exact[i, j], j) for j in range(40) if j != i and (i, j) in pairs)[:3]}
    assert rows(approx_similarity_join(t, 3, many)) == want
    assert avg_selectivity(t, many).first()[0] == pytest.approx(len(pairs) / 1600)
    assert avg_selectivity(t, few).first()[0] <= avg_selectivity(t, many).first()[0]
    assert all(len(r["key"]) <= 4 for r in few.buckets(t).collect())


def test_hash_parameters(spark):
    for bad in ({"family": "minhash", "prime": 10}, {"family": "minhash", "num_bands": 3}, {"family": "simhash", "num_bands": 2}, {"family": "pstable_l2", "bucket_width": 0.0}, {"family": "x"}, {"family": "simhash", "num_tables": 0}):
        with pytest.raises(ValueError):
            Lsh(**({"num_features": 4, "signature_length": 4, "num_tables": 1} | bad))
    zero = spark.createDataFrame([(1, [0.0] * 4)], "id long, vec array<double>")
    with pytest.raises(Exception, match="minimum hash"):
        Lsh("minhash", 4, 2, 1).buckets(zero).collect()


def test_matrices(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0)], "i long, j long, value double")
    b = spark.createDataFrame([(0, 1, 5.0), (1, 1, 0.5), (2, 2, 9.0)], "i long, j long, value double")
    assert rows(hadamard(a, b)) == {(0, 1, 15.0), (1, 1, 2.0)}
    assert rows(hadamard(a, b, lambda x: x * 0 + 1)) == {(0, 1, 1.0), (1, 1, 1.0)}
    assert rows(transpose(a)) == {(0, 0, 2.0), (1, 0, 3.0), (1, 1, 4.0)}
    assert {r["i"]: [tuple(e) for e in r["entries"]] for r in to_rows(a).collect()} == {0: [(0, 2.0), (1, 3.0)], 1: [(1, 4.0)]}
    t = spark.createDataFrame([(3, [0.0, 7.0])], "id long, vec array<double>")
    assert rows(to_entries(t, "id", "vec")) == {(3, 1, 7.0)}


def test_tree_on_a_grid():
    grid = [(x, y) for x in range(-5, 6) for y in range(-5, 6)]
    tree = VPTree(range(len(grid)), grid, leaf_size=5)
    at = lambda k: {grid[i] for i, _ in tree.query((0, 0), k)}
    assert at(1) == {(0, 0)} and at(5) == {(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)}
    assert at(9) == {(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)}
    assert VPTree([], np.zeros((0, 2))).query((0, 0), 3) == []
    same = VPTree(range(6), [(2, 0)] + [(0, 1)] * 5, leaf_size=1)
    assert {i for i, _ in same.query((0, 0), 5)} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("measure", list(MEASURES))
def test_tree_against_brute_force(measure):
    tree = VPTree(range(40), VECTORS, measure, leaf_size=3)
    d = pairwise(measure, VECTORS, VECTORS)
    for i in range(0, 40, 5):
        assert tree.query(VECTORS[i], 4) == [(j, x) for x, j in sorted((d[i, j], j) for j in range(40))[:4]]


def test_forest_and_partitions():
    forest = TopTrees({c: VPTree(range(20), RNG.normal(size=(20, 2)) + c, leaf_size=4, seed=c) for c in (1, 3)})
    seen = {forest(c, v) for c in (1, 3) for v in forest.trees[c].vectors}
    assert seen == set(range(forest.num_indices))
    assert forest.get(2, (0, 0)) is None and forest.get_or_else(2, (0, 0), 7) == 7 and not forest.is_defined_at(2)
    with pytest.raises(KeyError):
        forest(2, (0, 0))
    p = LeafPartitioner(forest.num_indices)
    assert [p.partition(i) for i in range(p.num_partitions)] == list(range(p.num_partitions))
    for bad in (-1, p.num_partitions, "x"):
        with pytest.raises(ValueError):
            p.partition(bad)


def test_units_are_few_and_dealt(spark):
    """A point goes to as many units as its group has blocks, which large ones have few of; units go to more partitions as they grow, whatever the session has."""
    points = spark.range(60_000).select(F.lit("").alias("g"), "id")
    met = N.in_units(points, 20_000)
    assert met.count() == 60_000 * N.FEW and met.rdd.getNumPartitions() == 60_000 * N.FEW // N.ROWS > 4
    assert N.in_units(points).select("l", "r").distinct().count() == 30 * 31 // 2


@pytest.mark.parametrize("measure", list(MEASURES))
def test_tiles_of_a_unit(measure, monkeypatch):
    """Tile after tile, both directions: what all distances of the unit give, with copies and near copies."""
    import pyarrow as pa

    monkeypatch.setattr(N, "TILE", (17, 23))
    draw = np.random.default_rng(2)
    v = draw.normal(0, 1, (120, 9))
    v[20:50], v[60:80] = v[5], v[6] * (1 + 1e-16 * np.arange(20))[:, None]
    if measure in ("hamming", "jaccard"):
        v = (v > 0.3) + 0.0
        v[:, 0] = 1
    ids, side, chosen = draw.permutation(120), draw.integers(0, 2, 120), draw.random(120) < 0.7
    got = N._unit(4, measure, False, False, None)(pa.table({"g": ["a"] * 120, "id": ids, "side": side, "picked": chosen, "v": v.tolist()}))
    d, want = pairwise(measure, v, v), []
    for a in range(120):
        near = sorted((d[a, b], ids[b]) for b in np.flatnonzero(side != side[a]) if (chosen[a] if ids[a] < ids[b] else chosen[b]))
        want += [(ids[a], j, x) for x, j in near[:4]]
    assert Counter(zip(*(got[c].to_pylist() for c in ("i", "j", "value")))) == Counter(want)


def test_visits_are_counted_before_they_are_made(spark, monkeypatch):
    """Where blocks are compared after all, no row of a visit was made, with a vector for each leaf; the count is that of the rows."""
    v, g = _groups("hamming")
    df = spark.createDataFrame([(str(a), i, x.tolist()) for i, (a, x) in enumerate(zip(g, v))], "g string, id long, v array<double>")
    params = X.IndexParams(target=12, leaf_size=4, sub_leaf_size=3)
    index = X.MetricIndex.of(df, 4, "hamming", params)
    asked = index.points.withColumns({"past": F.lit(-1.0), "reach": F.lit(3.0)})
    assert index.number_of_visits(asked)[0] == index.visits(asked).count()
    monkeypatch.setattr(X.MetricIndex, "visits", lambda *_: pytest.fail("visits were made"))
    want = Counter(map(tuple, N.nearest(df.withColumn("picked", F.lit(True)), 4, "hamming").collect()))
    assert Counter(map(tuple, leaf_nearest(df, 4, "hamming", params=params, most=0.0).collect())) == want


def test_found_rows_are_dealt_by_their_number(spark, table, monkeypatch):
    """What a task ranks doesn't grow with the table: partitions do, beyond those of the session."""
    monkeypatch.setattr(R, "TASK_BYTES", 1024)
    monkeypatch.setattr(N, "BLOCK", 7)
    got = N.similarity_join(table, 3)
    blocks = -(-40 // 7)
    assert got.rdd.getNumPartitions() == 40 * blocks * 3 * N.FOUND_BYTES // 1024 > R.partitions(spark)
    assert rows(got) == brute(pairwise("euclidean", VECTORS, VECTORS), 3)


def test_found_rows_stay_apart(spark, table, monkeypatch):
    """What would fill more than one task isn't merged into one because it is small when compressed, where the session has partitions enough."""
    monkeypatch.setattr(R, "TASK_BYTES", 40 * 3 * N.FOUND_BYTES // 2)
    got = N.similarity_join(table, 3)
    assert 1 < 40 * 3 * N.FOUND_BYTES // R.TASK_BYTES < R.partitions(spark)
    assert got.rdd.getNumPartitions() == R.partitions(spark)
    assert rows(got) == brute(pairwise("euclidean", VECTORS, VECTORS), 3)


def test_points_that_meet_a_tree_stay_apart(spark, monkeypatch):
    """The same of points that meet their group's tree, and of visits."""
    v, g = _groups("euclidean")
    df = spark.createDataFrame([(str(a), i, x.tolist()) for i, (a, x) in enumerate(zip(g, v))], "g string, id long, v array<double>")
    monkeypatch.setattr(X, "MEET", len(v) // 2)
    index = X.MetricIndex.of(df, 4, "euclidean", X.IndexParams(target=12, leaf_size=4, sub_leaf_size=3))
    visits = index.visits(index.points.withColumns({"past": F.lit(-1.0), "reach": F.lit(0.5)}))
    assert visits.rdd.getNumPartitions() == R.partitions(spark) > 2


def test_leaf_search_is_dealt_by_its_number(spark, monkeypatch):
    """Points that meet a tree, and visits that meet a leaf, go to partitions by their number, beyond those of the session; the result is the same."""
    monkeypatch.setattr(X, "MEET", 9)
    monkeypatch.setattr(X, "ROWS", 16)
    v, g = _groups("euclidean")
    df = spark.createDataFrame([(str(a), i, x.tolist()) for i, (a, x) in enumerate(zip(g, v))], "g string, id long, v array<double>")
    params = X.IndexParams(target=12, leaf_size=4, sub_leaf_size=3)
    index = X.MetricIndex.of(df, 4, "euclidean", params)
    visits = index.visits(index.points.withColumns({"past": F.lit(-1.0), "reach": F.lit(0.5)}))
    assert visits.rdd.getNumPartitions() == len(v) // 9 > R.partitions(spark)
    units = index.units(visits)
    sent = sum(r["nc"] + r["nv"] for r in units.table.collect())
    assert index.looked(visits, units, False).rdd.getNumPartitions() == sent // 16 > R.partitions(spark)
    want = Counter(map(tuple, N.nearest(df.withColumn("picked", F.lit(True)), 4).collect()))
    assert Counter(map(tuple, leaf_nearest(df, 4, params=params, most=float("inf")).collect())) == want
