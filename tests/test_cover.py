import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nervemap.operators.cover import Cover, CoverModel
from nervemap.streaming.cover import cover_stream

ROWS = [(51.472459345502074, 36)] * 2 + [(-75.82637174773971, -97)] * 3 + [(-16.66589911618783, 1)] * 2 + [(23.506155529566698, -99)] * 3


def test_two_dimensions_by_example(spark):
    df = spark.createDataFrame(ROWS, "double double, integer int")
    model = Cover(["double", "integer"], num_splits=3, overlap_ratio=0.5).fit(df)
    got = {(r[0], tuple(r[2])) for r in model.transform(df).collect()}
    assert got == {(ROWS[0][0], (8,)), (ROWS[2][0], (0,)), (ROWS[5][0], (4, 5)), (ROWS[7][0], (6,))}
    first = [r for r in model.cubes(spark).where("dim = 0").orderBy("cube_id").collect()]
    assert (first[0]["lo"], first[0]["hi"]) == (-86.43460767217653, -22.785192125555636)
    assert (first[8]["lo"], first[8]["hi"]) == (-1.5687202766820043, 62.080695269938886)
    assert [c.id for c in model.cube_list()] == list(range(9))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-100, 100), st.floats(-100, 100)), min_size=2, max_size=15), st.integers(1, 5), st.sampled_from([0.1, 0.5, 1.0]), st.booleans())
def test_against_cube_values(spark, rows, n, ratio, closed):
    if min(len({a for a, _ in rows}), len({b for _, b in rows})) < 2:
        return
    df = spark.createDataFrame(rows, "a int, b double").withColumn("v", F.array("b", F.col("a").cast("double")))
    for cols, pick in ((["a", "b"], lambda r: [float(r[0]), r[1]]), (["v"], lambda r: [r[1], float(r[0])])):
        model = Cover(cols, "ids", n, ratio, closed=closed).fit(df)
        cubes = model.cube_list()
        for r in model.transform(df).collect():
            assert r["ids"] == [c.id for c in cubes if c.contains(pick(r))] and r["ids"]


def test_many_pieces_agree_with_few(spark, monkeypatch):
    import nervemap.operators.cover as C

    df = spark.range(50).select((F.col("id") * 1.7).alias("x"))
    model = Cover(["x"], "ids", 9, 0.4).fit(df)
    a = model.transform(df).collect()
    monkeypatch.setattr(C, "UNROLLED", 0)
    assert a == model.transform(df).collect()


def test_exploded(spark):
    df = spark.createDataFrame([(7, 0.0), (8, 5.0), (9, 10.0), (10, float("nan"))], "key long, x double")
    model = Cover(["x"], "cell", 2, 0.5, exploding=True, id_col="key")
    fitted = CoverModel(model, [0.0], [10.0])
    assert sorted((r["key"], r["cell"]) for r in fitted.transform(df).collect()) == [(7, 0), (8, 0), (8, 1), (9, 1)]
    assert fitted.transform(df.drop("key")).columns == ["x", "key", "cell"]
    assert model.schema(df.schema).names == ["key", "x", "cell"]


def test_parameters_and_inputs(spark):
    for bad in ({"num_splits": 0}, {"overlap_ratio": 0.0}):
        with pytest.raises(ValueError):
            Cover(["x"], **bad)
    df = spark.createDataFrame([("a", 1.0)], "s string, x double")
    with pytest.raises(TypeError):
        Cover(["s"]).fit(df)
    with pytest.raises(ValueError):
        Cover(["x"]).fit(df).transform(df)  # constant
    with pytest.raises(ValueError):
        Cover(["x"]).fit(df.where("false"))
    with pytest.raises(ValueError):
        Cover(["x"]).fit(spark.createDataFrame([(None,), (1.0,)], "x double"))


def test_save_and_load(spark, tmp_path):
    cover = Cover(["x"], num_splits=4, closed=True)
    cover.save(str(tmp_path / "cover"))
    assert Cover.load(str(tmp_path / "cover")) == cover
    model = CoverModel(cover, [-1.0, 0.0], [1.0, 10.0])
    model.save(str(tmp_path / "model"))
    assert CoverModel.load(str(tmp_path / "model")) == model
    with pytest.raises(Exception):
        model.save(str(tmp_path / "model"))
    assert model.copy(num_splits=5).cover.num_splits == 5


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, x double")
    df.write.parquet(str(tmp_path / "in"))
    model = Cover(["x"], "cell", 3, 0.2, exploding=True).fit(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = cover_stream(model, stream).writeStream.format("memory").queryName("covered").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["id"], r["cell"])
    assert sorted(map(key, spark.table("covered").collect())) == sorted(map(key, model.transform(df).collect()))
    with pytest.raises(ValueError):
        cover_stream(model, stream.drop("id"))


def test_hot_keys_join_like_others(spark):
    from collections import Counter

    from nervemap.runtime import hot_join

    rows = spark.createDataFrame([(i % 5000, i) for i in range(9000)] + [(7, -i) for i in range(3000)] + [(None, 1)], "k long, v long")
    table = spark.createDataFrame([(i, str(i)) for i in range(0, 5000, 7)], "k long, name string")
    want = Counter((r["k"], r["v"], str(r["k"])) for r in rows.collect() if r["k"] is not None and r["k"] % 7 == 0)
    assert Counter(map(tuple, hot_join(rows, table, "k").select("k", "v", "name").collect())) == want
    assert hot_join(rows.where("false"), table, "k").count() == 0
