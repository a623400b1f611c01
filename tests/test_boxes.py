from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import nervemap.operators.boxes as B
from nervemap.operators.intervals import UNBOUNDED, Cube, Endpoint, Interval, open_cover


def random_interval(draw, wide):
    while True:
        a = float(np.round(draw.normal(0, 20)))
        ends = []
        for x in (a, a + float(np.round(draw.exponential(40 if draw.random() < wide else 2)))):
            ends.append(UNBOUNDED if draw.random() < 0.06 else Endpoint(x, bool(draw.random() < 0.5)))
        try:
            return Interval.of(*ends)
        except ValueError:
            pass


def cubes(n, dims, seed, wide=0.1):
    draw = np.random.default_rng(seed)
    return [Cube(i, tuple(random_interval(draw, wide) for _ in range(dims))) for i in range(n)]


def found(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("dims,bins,piece", [(2, 8, 3), (3, 1, 8192), (1, 4096, 5)])
def test_joins(spark, dims, bins, piece, monkeypatch):
    """Each pair once, and all pairs that the intervals of the driver say."""
    monkeypatch.setattr(B, "BINS", bins)
    monkeypatch.setattr(B, "PER_BIN", 2)
    monkeypatch.setattr(B, "PIECE", piece)
    a, b = cubes(150, dims, 1), cubes(120, dims, 2)
    left, right = B.cube_table(spark, a).repartition(3), B.cube_table(spark, b).repartition(2)
    assert found(B.box_join(left, right)) == Counter((x.id, y.id) for x in a for y in b if x.intersects(y))
    assert found(B.box_join(left, right, "contains")) == Counter((x.id, y.id) for x in a for y in b if x.contains_cube(y))
    assert found(B.box_join(left, left, "contains", dim=dims - 1)) == Counter((x.id, y.id) for x in a for y in a if x.contains_cube(y))


def test_points_in_cubes(spark):
    draw = np.random.default_rng(3)
    p = np.round(draw.uniform(0, 10, (200, 2)), 1)
    cover = open_cover([0, 0], [10, 10], 5, 0.3)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(900, None, float("nan")), (901, float("nan"), 1.0)], "id long, x double, y double").where("id <> 900")
    got = B.box_join(B.cube_table(spark, cover), B.points(df, "id", [F.col("x"), F.col("y")]), "contains")
    assert found(got) == Counter((c.id, i) for c in cover for i, x in enumerate(p) if c.contains(x))


def test_odd_rows(spark):
    rows = [
        ("a", [0.0], [1.0], [True], [True]), ("a", [0.0], [1.0], [True], [True]), (None, [1.0], [None], [True], [None]), ("empty", [2.0], [1.0], [True], [True]), ("open", [1.0], [1.0], [True], [False]),
        ("nan", [float("nan")], [1.0], [True], [True]), ("null", None, [1.0], [True], [True]), ("all", [None], [None], [None], [None]), ("flat", [], [], [], []),
    ]
    df = spark.createDataFrame(rows, "id string, lo array<double>, hi array<double>, lo_closed array<boolean>, hi_closed array<boolean>").withColumns({c: F.lit(1) for c in ("bin", "level", "_a", "first", "piece", "x")})
    ids = ["a", "a", None, "all"]
    assert found(B.box_join(df, df)) == Counter((x, y) for x in ids for y in ids)
    assert found(B.box_join(df, df, "contains")) == Counter([("a", "a")] * 4 + [(None, None), ("all", "all"), ("all", None), ("all", "a"), ("all", "a")])
    assert B.box_join(df.limit(0), df).collect() == [] and B.box_join(df, df.limit(0)).collect() == []
    with pytest.raises(Exception, match="sides without ends"):
        B.box_join(df.limit(0).unionByName(df.limit(1).withColumn("hi", F.array().cast("array<double>"))), df).collect()
    with pytest.raises(ValueError):
        B.box_join(df, df, "touches")


def test_intervals_and_one_hot_place(spark, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 10)
    monkeypatch.setattr(B, "PER_BIN", 4)
    i = [Interval.closed(5, 5)] * 40 + [Interval.open(4, 6), Interval.greater_than(5), Interval.less_equal(5), Interval.closed(0, 1)]
    t = B.interval_table(spark, i)
    got = found(B.box_join(t, t))
    assert got == Counter((a, b) for a, x in enumerate(i) for b, y in enumerate(i) if x.intersects(y))


def test_no_product_in_the_plan(spark):
    t = B.cube_table(spark, cubes(40, 2, 5))
    plan = B.box_join(t, t)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("relation", ["intersects", "contains"])
def test_wide_boxes_are_compared_as_arrays(spark, relation, monkeypatch):
    """Boxes a quarter as wide as all of them share most bins: both sides of a bin are dealt, and no pair of rows reaches a condition of a join."""
    monkeypatch.setattr(B, "PIECE", 200)
    x = np.random.default_rng(8).normal(0, 1, (700, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")
    at = lambda r: B.boxes(df, "id", [F.col("x") - r, F.col("y") - r], [F.col("x") + r, F.col("y") + r], (True, False))
    got = B.box_join(at(0.5), at(0.25), relation)
    d = np.abs(x[:, None, :] - x[None, :, :]).max(axis=2)
    assert found(got) == Counter(zip(*(c.tolist() for c in np.nonzero(d < 0.75 if relation == "intersects" else d <= 0.25))))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
