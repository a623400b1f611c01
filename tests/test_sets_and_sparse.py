from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import nervemap.operators.setjoin as S
from nervemap.functions.sparse import as_sparse, from_pairs, sparse_distance, to_dense
from nervemap.functions.vectors import MEASURES, distance
from nervemap.operators.neighbors import similarity_join
from nervemap.sources.points import lines_in_place, read_labelled, read_points

DRAW = np.random.default_rng(12)


def vectors(n=60, size=40, share=0.25):
    v = np.where(DRAW.random((n, size)) < share, np.round(DRAW.normal(0, 3, (n, size)), 2), 0.0)
    v[:, 0] = np.where(v.any(axis=1), v[:, 0], 1.5)
    v[5] = v[6]
    return v


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors())] + [(100, None)], "id long, vec array<double>")


@pytest.mark.parametrize("measure", list(MEASURES))
def test_sparse_distances_are_the_dense_ones(table, measure):
    df = table.withColumn("s", as_sparse(table, "vec"))
    other = df.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"), F.col("s").alias("t"))
    rows = df.join(other, "id").select(distance(measure, F.col("vec"), F.col("w")).alias("a"), sparse_distance(measure, F.col("s"), F.col("t")).alias("b")).collect()
    assert len(rows) == 59 and all(r["a"] == r["b"] for r in rows)


def test_sparse_columns_of_any_vectors(spark):
    rows = [(1, Vectors.sparse(5, {1: 2.0, 4: 0.0}), [0.0, 2.0, 0.0, 0.0, 0.0]), (2, Vectors.dense([0.0, 0, 3, -1, 0]), [0.0, 0.0, 3.0, -1.0, 0.0]), (3, Vectors.sparse(5, {}), [0.0] * 5)]
    df = spark.createDataFrame([r[:2] for r in rows], ["id", "v"])
    got = df.select("id", as_sparse(df, "v").alias("s")).orderBy("id").collect()
    assert [(r["s"]["size"], r["s"]["indices"], r["s"]["values"]) for r in got] == [(5, [1], [2.0]), (5, [2, 3], [3.0, -1.0]), (5, [], [])]
    assert got[1]["s"]["norm"] == 10**0.5
    back = df.select("id", to_dense(as_sparse(df, "v")).alias("d")).orderBy("id").collect()
    assert [r["d"] for r in back] == [r[2] for r in rows]
    both = df.select(as_sparse(df, "v").alias("s"))
    for bad in (lambda: both.select(sparse_distance("cosine", F.col("s"), F.col("s"))).collect(), lambda: both.select(sparse_distance("euclidean", F.col("s"), from_pairs(4, F.array(F.struct(F.lit(0), F.lit(1.0)))))).collect()):
        with pytest.raises(Exception, match="not a number|differ in length"):
            bad()
    none = both.select(sparse_distance("hamming", F.col("s"), F.lit(None).cast(both.schema["s"].dataType)).alias("d"))
    assert {r["d"] for r in none.collect()} == {None}


@pytest.mark.parametrize("measure", list(MEASURES))
def test_joins_of_sparse_vectors(table, measure):
    sparse = table.withColumn("vec", as_sparse(table, "vec"))
    assert Counter(map(tuple, similarity_join(sparse, 4, measure).collect())) == Counter(map(tuple, similarity_join(table, 4, measure).collect()))
    with pytest.raises(ValueError):
        similarity_join(sparse, 4, measure, pred=lambda a, b: a[..., 0] == b[..., 0])


@pytest.mark.parametrize("measure,piece", [("jaccard", 7), ("hamming", 2048)])
def test_set_join(spark, measure, piece, monkeypatch):
    monkeypatch.setattr(S, "PIECE", piece)
    draw = np.random.default_rng(3)
    rows = []
    for i in range(90):
        v = np.zeros(300)
        base = (i // 6) * 15
        v[base + draw.choice(15, 9, replace=False)] = 2.0
        v[draw.choice(300, int(draw.integers(0, 4)), replace=False)] = 1.0
        rows.append((int(i), v.tolist()))
    rows += [(200, np.eye(300)[299].tolist()), (201, np.zeros(300).tolist()), (202, None), (None, np.ones(300).tolist()), (203, np.ones(300).tolist()), (204, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    want = Counter(map(tuple, similarity_join(df, 5, measure).collect()))
    found, told = S.set_join(df, 5, measure, most=float("inf"))
    assert Counter(map(tuple, found.collect())) == want
    told = told.collect()
    assert told[0]["asking"] == 94 and told[-1]["asking"] < 30
    assert S.set_join(df.limit(0), 5, measure)[0].collect() == []


def test_few_pairs_of_rare_elements_are_compared(spark):
    """Two thousand sets of elements that few others hold: neighbours are found among a small share of all pairs."""
    draw = np.random.default_rng(5)
    pairs = lambda i: [(int(x), 1.0) for x in {*(40 * (i // 8) + draw.choice(40, 20, replace=False)).tolist(), 99_990 + int(draw.integers(0, 10))}]
    df = spark.createDataFrame([(i, pairs(i)) for i in range(2000)], "id long, p array<struct<i:int,x:double>>").select("id", from_pairs(100_000, F.col("p")).alias("vec"))
    found, told = S.set_join(df, 3)
    assert max(r["within"] for r in told.collect()) < 2 and found.count() == 6000 and sum(r["compared"] for r in told.collect()) < 0.08 * 2000 * 2000


def test_common_elements_are_compared_in_blocks(table):
    found, told = S.set_join(table, 4, "hamming", most=0.2)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, similarity_join(table, 4, "hamming").collect()))
    assert told.collect()[-1]["within"] == float("inf")


def test_odd_sets(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "id long, vec array<double>")
    with pytest.raises(ValueError, match="not a number"):
        S.set_join(df, 1)
    assert {tuple(r) for r in S.set_join(df.withColumn("vec", as_sparse(df, "vec")), 1, "hamming")[0].collect()} == {(1, 2, 0.0), (2, 1, 0.0), (3, 1, 1.0)}
    with pytest.raises(ValueError, match="differ in length"):
        S.set_join(df.unionByName(df.limit(1).withColumn("vec", F.array(F.lit(1.0)))), 1)
    with pytest.raises(ValueError):
        S.set_join(df, 1, "cosine")


def test_lines_keep_their_places(spark, tmp_path):
    lines = {"b.txt": [f"{i} {-i}" for i in range(400)], "a.txt": ["9 9", "", "  ", "7 1 x"], "c.txt": []}
    for name, own in lines.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in own))
    want = [x for name in sorted(lines) for x in lines[name] if x.strip()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted(map(tuple, lines_in_place(spark, str(tmp_path)).collect()))
        assert got == list(enumerate(want))
        points = read_points(spark, str(tmp_path), in_place=True).orderBy("id").collect()
        assert [r["features"] for r in points[:3]] == [[9.0, 9.0], [7.0, 1.0], [0.0, 0.0]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "l.txt").write_text("7 2:3 0:1.5 1:0\n5 1:2 9:4\n")
    got = read_labelled(spark, str(tmp_path / "l"), 3, sparse=True).orderBy("id").collect()
    assert [(r["id"], r["label"], r["features"]["indices"], r["features"]["values"]) for r in got] == [(0, 7, [0, 2], [1.5, 3.0]), (1, 5, [1], [2.0])]
    dense = read_labelled(spark, str(tmp_path / "l"), 3, in_place=True).orderBy("id").collect()
    assert [tuple(r) for r in dense] == [(0, 7, [1.5, 0.0, 3.0]), (1, 5, [0.0, 2.0, 0.0])]


def test_short_lists_take_one_round(spark, monkeypatch):
    """Sets of rare elements that are seldom near: all their lists hold few pairs, so that sets are sent once."""
    monkeypatch.setattr(S, "SHORT_SHARE", 0.2)
    draw = np.random.default_rng(7)
    rows = [(i, [(int(x), 1.0) for x in draw.choice(300, 4, replace=False)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, p array<struct<i:int,x:double>>").select("id", from_pairs(300, F.col("p")).alias("vec"))
    found, told = S.set_join(df, 3)
    assert [(r["within"], r["asking"]) for r in told.collect()] == [(1.0, 300)]
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, similarity_join(df, 3, "jaccard").collect()))
