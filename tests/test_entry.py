import os
from pathlib import Path

import pytest

import __spark_entry__ as E

DATA = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.001"
SOME = ["mapper_nodes", "mapper_edges", "reeb_clusters", "cover_assign_2d", "cover_closed", "knn_cosine", "lsh_minhash_knn", "projection_cauchy", "remove_noise", "mutual_knn", "buffer_size", "snn_join_clusters", "interval_intersects", "relabelled", "knn_pred", "lsh_minhash_selectivity", "cube_intersects", "cube_contains", "index_leaf_sizes", "reeb_leaf_clusters", "leaf_knn_manhattan", "dist_sparse_cosine", "set_knn_jaccard", "l1_estimates", "pca_variance", "kmeans_invariants"]


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(SOME) <= set(E.queries())


def _value(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    cur = con.execute(E.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(_value(r[i]) for i in at) for r in cur.fetchall()), key=str)
    df = E.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == cols
    assert sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=str) == want
    assert want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry(spark):
    assert E.entry(spark).count() > 0
