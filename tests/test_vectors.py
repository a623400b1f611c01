import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nervemap.functions.projection import CauchyProjection, GaussianProjection
from nervemap.functions.vectors import MEASURES, as_array, distance, pairwise


def _unit(at):
    return [1.0 if i in at else 0.0 for i in range(10)]


V0, V1, V2 = _unit({0, 3, 6, 8}), _unit({1, 4, 7, 9}), _unit({2, 5, 7, 9})
GOLDEN = {"cosine": (0, 1, 0.5), "euclidean": (0, math.sqrt(8), 2.0), "manhattan": (0, 8, 4), "hamming": (0, 8, 4), "jaccard": (0, 1, 2 / 3)}


@pytest.mark.parametrize("name", list(GOLDEN))
def test_literal_distances(spark, name):
    rows = spark.createDataFrame([(V0, V0), (V0, V1), (V1, V2)], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(distance(name.upper(), F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx(GOLDEN[name])
    assert [pairwise(name, np.array([a]), np.array([b]))[0, 0] for a, b in ((V0, V0), (V0, V1), (V1, V2))] == pytest.approx(GOLDEN[name])


def test_vector_kinds_and_names(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.sparse(3, {1: 2.0}), Vectors.dense(0.0, 2.0, 0.0), [0.0, 2.0, 0.0], 5, "x")], ["s", "d", "a", "n", "t"])
    row = df.select(as_array(df, "s"), as_array(df, "d"), as_array(df, "a"), as_array(df, "n")).first()
    assert row[0] == row[1] == row[2] == [0.0, 2.0, 0.0] and row[3] == [5.0]
    with pytest.raises(TypeError):
        as_array(df, "t")
    with pytest.raises(ValueError):
        distance("chebyshev", F.col("a"), F.col("a"))


def test_distance_that_is_no_number_fails(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    for name in ("cosine", "jaccard"):
        other = "b" if name == "cosine" else "a"
        with pytest.raises(Exception, match="not a number"):
            df.select(distance(name, F.col("a"), F.col(other))).collect()
        assert math.isnan(df.select(distance(name, F.col("a"), F.col(other), strict=False)).first()[0])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(-10, 10), min_size=4, max_size=4), min_size=2, max_size=8))
def test_symmetry_and_zero(rows):
    v = np.array(rows, dtype=float)
    for name in MEASURES:
        d = pairwise(name, v, v)
        assert np.array_equal(d, d.T, equal_nan=True)
        ok = ~np.isnan(np.diag(d))
        assert np.allclose(np.diag(d)[ok], 0, atol=1e-7)


def test_projections(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, v array<double>")
    for kind in (GaussianProjection, CauchyProjection):
        p = kind(3, 2, seed=1)
        assert np.allclose(df.select(p.column(F.col("v"))).first()[0], p.apply(np.array([1.0, 2.0, 3.0])))
        assert np.array_equal(p.matrix, kind(3, 2, seed=1).matrix)
        with pytest.raises(ValueError):
            p.apply(np.zeros(4))
    big = GaussianProjection(200, 200, seed=2)
    assert abs(big.mean()) < 0.05 and abs(big.stddev() - 1) < 0.05
    assert abs(CauchyProjection(200, 200, seed=2).median()) < 0.1
