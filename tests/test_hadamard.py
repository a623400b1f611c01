"""The registered Hadamard query over vectors of more than 64 components."""


def test_entries_of_longer_vectors(spark, monkeypatch):
    from nervemap.plans import queries as Q

    table = spark.createDataFrame([(i, [float(i * 100 + j) for j in range(70)]) for i in (1, 66, 69, 80)], "id long, vec array<double>")
    monkeypatch.setattr(Q, "_vectors", lambda spark, sf_dir: table)
    got = {(r[0], r[1]): r[2] for r in Q.hadamard_transpose(spark, "").collect()}
    ids = (1, 66, 69)
    assert got == {(i, j): float((i * 100 + j) * (j * 100 + i)) for i in ids for j in ids}
