from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import nervemap.operators.metric_index as X
import nervemap.operators.neighbors as N
import nervemap.operators.reeb as B
import nervemap.operators.strips as S
from nervemap.functions.vectors import pairwise
from nervemap.operators.reeb import ReebDiagram


def _vectors(kind, n=150):
    draw = np.random.default_rng(3)
    v = draw.normal(0, 1, (n, 7))
    if kind == "ties":
        v = np.round(v) + 0.0
        v[20:70] = v[3]
    elif kind == "far":  # near each other, far from 0 and, half of them, from the mean
        v = v * 1e-6 + 1e4 * (np.arange(n) % 2)[:, None] + 1e3
        v[30:60:2] = v[4] * (1 + 1e-16 * np.arange(15))[:, None]
    elif kind == "small":
        v *= 1e-30
    elif kind == "large":
        v *= 1e60
    elif kind == "mixed":
        v[::3] *= 1e25
    elif kind == "single":
        v = v.astype(np.float32).astype(np.float64)
    return v


def _least(v, ids, k, with_self):
    d = pairwise("euclidean", v, v)
    return Counter((ids[a], j, x) for a in range(len(v)) for x, j in sorted((d[a, b], ids[b]) for b in range(len(v)) if with_self or a != b)[:k])


def _row(ids, v, k):
    import pyarrow as pa

    return S.packed(pa.table({"id": ids}), v, k)


@pytest.mark.parametrize("with_self", [True, False])
@pytest.mark.parametrize("kind", ["plain", "ties", "far", "small", "large", "mixed", "single"])
def test_what_passes_a_strip(kind, with_self, monkeypatch):
    """Packed rows one after another, in any order of ids: what all distances give, bit for bit."""
    monkeypatch.setattr(S, "TILE", 13)
    v, k = _vectors(kind), 6
    ids = np.random.default_rng(5).permutation(len(v)).astype(np.int64)
    strip = S.Strip(ids, v, k, with_self)
    for lo in range(0, len(v), 37):
        row = _row(ids[lo : lo + 37], v[lo : lo + 37], k)
        assert row["single"] == (kind in ("ties", "single"))
        i, x, shown = S.unpacked(row)
        assert np.array_equal(i, ids[lo : lo + 37]) and np.array_equal(x, v[lo : lo + 37])
        strip.meet(i[shown], x[shown])
    got = Counter(t for b in strip.found("g") for t in zip(*(b.column(n).to_pylist() for n in (1, 2, 3))))
    assert got == _least(v, ids.tolist(), k, with_self)


def test_copies_pass_once():
    """Of equal vectors only those that can be neighbours pass, however many there are."""
    ids, v = np.arange(90)[::-1].copy(), np.ones((90, 4))
    _, _, shown = S.unpacked(_row(ids, v, 5))
    assert sorted(ids[shown].tolist()) == list(range(6))


def test_few_pairs_are_added_up(monkeypatch):
    """What has passed bounds what follows: of 4,000 points that pass in rows, each of 500 adds up a small share."""
    draw, added = np.random.default_rng(1), []
    v, exact = draw.normal(size=(4_000, 16)), S.of_pairs
    monkeypatch.setattr(S, "of_pairs", lambda *a: added.append(len(a[3])) or exact(*a))
    strip = S.Strip(np.arange(500), v[:500], 10, True)
    for lo in range(0, 4_000, 250):
        strip.meet(np.arange(lo, lo + 250), v[lo : lo + 250])
    assert 10 * 500 <= sum(added) < 60 * 500
    with pytest.raises(ValueError, match="differ in length"):
        strip.meet(np.arange(2), v[:2, :5])
    strip = S.Strip(np.arange(500), v[:500], 10, True)
    with pytest.raises(ValueError, match="not a number"):
        strip.meet(np.arange(2), np.full((2, 16), np.nan))


@pytest.mark.parametrize("with_self,passing", [(True, 1 << 28), (False, 8 * 7 * 40)])
def test_strips_of_groups(spark, with_self, passing, monkeypatch):
    """Groups of all sizes, also where a task sees a part of the points only; a strip is a partition."""
    for name, size in (("LARGE", 100), ("BLOCK", 16)):
        monkeypatch.setattr(N, name, size)
    for name, size in (("STRIP_BYTES", 8 * 7 * 20), ("PIECE", 9), ("PASSING_BYTES", passing)):
        monkeypatch.setattr(S, name, size)
    v = np.concatenate([_vectors("ties"), _vectors("plain", 40)])
    g = np.array(["a"] * 130 + ["b"] * 59 + ["c"])
    df = spark.createDataFrame([(str(a), i, x.tolist()) for i, (a, x) in enumerate(zip(g, v))] + [("a", 900, None)], "g string, id long, v array<double>").repartition(3).withColumn("picked", F.lit(True))
    got = N.nearest(df, 4, with_self=with_self)
    want = Counter()
    for name in "abc":
        own = np.flatnonzero(g == name)
        want += Counter((name, *t) for t in _least(v[own], own.tolist(), 4, with_self).elements())
    assert Counter(map(tuple, got.collect())) == want
    if with_self:  # strips of 16 points, at most 12 of a group
        assert got.rdd.getNumPartitions() == 9 + 4 + 1
    with pytest.raises(Exception, match="differ in length"):
        N.nearest(df.unionByName(df.limit(1).select("g", F.lit(901).cast("long").alias("id"), F.array(F.lit(1.0)).alias("v"), "picked")), 4).collect()
    some = df.withColumn("picked", F.col("id") % 2 == 0)
    d = pairwise("euclidean", v[:130], v[:130])
    half = Counter(("a", a, j, x) for a in range(130) for x, j in sorted((d[a, b], b) for b in range(130) if a != b and min(a, b) % 2 == 0)[:4])
    assert Counter(map(tuple, N.nearest(some.where("g = 'a'"), 4).collect())) == half


def test_no_leaf_is_looked_into_where_that_cannot_pay(spark, monkeypatch):
    """Points of many dimensions go to blocks at once; a first pass over a fitted model's few leaves, whose work grows with the square of a cell, isn't made. Points on a line go to leaves."""
    monkeypatch.setattr(B, "FEW_POINTS", 100)
    draw = np.random.default_rng(7)
    params = ReebDiagram(k=5, link_threshold_ratio=0.3, core_threshold_ratio=0.4, top_tree_size=60, top_tree_leaf_size=6, buffer_size=0.0)
    searched, search = [], X.MetricIndex.search
    monkeypatch.setattr(X.MetricIndex, "search", lambda *a, **b: searched.append(1) or search(*a, **b))
    for v, leaves in ((draw.normal(size=(400, 40)), 0), (np.stack([np.arange(400.0), np.zeros(400)], axis=1), 1)):
        df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "id long, features array<double>, cover_id int")
        searched.clear()
        got = params.fit(df).transform(df)
        rows = Counter((r["id"], r["cluster_id"]) for r in got.collect())
        assert len(searched) == leaves
        want = B.replace(params, search="blocks").transform(df)
        assert rows == Counter((r["id"], r["cluster_id"]) for r in want.collect())
