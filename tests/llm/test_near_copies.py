"""The pipeline's near copies against all pairs by definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

DRAW = np.random.default_rng(4)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def rows():
    out = []
    for size in (30, 60, 150, 400):
        for _ in range(6):
            w = [f"w{x}" for x in DRAW.integers(0, 3000, size)]
            out.append(" ".join(w))
            for share in (0.005, 0.01, 0.02, 0.05):
                v = list(w)
                for at in DRAW.choice(size, max(1, round(size * share)), replace=False):
                    v[at] = "new"
                out.append(" ".join(v))
    base = [f"b{x}" for x in range(200)]
    out.append(" ".join(base))
    for i in range(100):  # a large group: each is like the first, few are like each other
        v = list(base)
        for at in DRAW.choice(200, 4, replace=False):
            v[at] = f"x{i}"
        out.append(" ".join(v))
    return [(i, t) for i, t in enumerate([*out, None, "", " \n", "One two", "one  TWO", out[0]])] + [(None, "one two")]


@pytest.mark.parametrize("large", [64, 8])
def test_near_dedup_keeps_one_of_each_group(spark, large, monkeypatch):
    import corpus_pipeline as P
    import nervemap.llm.near_copies as N

    monkeypatch.setattr(N, "LARGE", large)
    table = rows()
    sets = [shingles(t) for _, t in table]
    label = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    got = sorted(r["doc_id"] for r in P.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(label))
    assert len(got) < len(table) / 2


@pytest.mark.parametrize("low", [2, 5])
def test_fingerprints_meet_in_the_middle(low):
    """Over all keys exactly the pairs within two bits share a variant, whichever bits these are."""
    import nervemap.llm.near_copies as N

    draw, bits = np.random.default_rng(7), 12
    fps = draw.integers(0, 1 << bits, 150)
    fps[:20] = fps[20:40]
    got = set()
    for at in range(1 << low):
        own = np.flatnonzero(np.bitwise_count((fps ^ at) & ((1 << low) - 1)) <= 1)
        row, starts = N.meeting(fps[own], at, bits, low)
        for same in np.split(own[row], starts[1:]):
            got |= {(a, b) for a in same.tolist() for b in same.tolist() if a < b}
    assert got == {(a, b) for a in range(150) for b in range(a + 1, 150) if int(fps[a] ^ fps[b]).bit_count() <= 2}


def test_most_pairs_at_the_bound_meet():
    import nervemap.llm.near_copies as N

    draw, p = np.random.default_rng(8), N.differing(0.8)
    s = draw.integers(0, 2, (4000, 64 * N.WORDS), dtype=np.uint8)
    other = s ^ (draw.random(s.shape) < p)
    count = int(np.ceil(np.log(N.MISSED) / np.log(1 - N.met_share(0.8, N.BITS))))
    met = np.zeros(len(s), dtype=bool)
    for bits in N._chosen(N.BITS, count):
        met |= (s[:, bits] != other[:, bits]).sum(axis=1) <= N.RADIUS
    assert met.mean() > 0.985


def test_unlinked_pairs_of_a_group_are_no_rows():
    """Three hundred sketches near each other, all unlinked: what joins them is handed on, not their pairs."""
    import pyarrow as pa

    import nervemap.llm.near_copies as N

    draw, n = np.random.default_rng(9), 300
    s = np.tile(draw.integers(0, 1 << 62, N.WORDS), (n, 1))
    s ^= np.int64(1) << draw.integers(0, 62, (n, N.WORDS))
    cols = {"key": np.zeros(n, np.int64), "fp": np.zeros(n, np.int64), "v": np.arange(n), "label": np.arange(n)} | {f"s{k}": s[:, k] for k in range(N.WORDS)}
    got = pa.Table.from_batches(N._meet(180, True, N.BITS, 2)(iter([pa.RecordBatch.from_pydict(cols)])))
    assert got.num_rows == n - 1
    assert set(got["a"].to_pylist()) | set(got["b"].to_pylist()) == set(range(n))


@pytest.mark.parametrize("small", [64, 5])
def test_groups_around_the_bound(spark, small, monkeypatch):
    """Texts of one origin whose similarities lie around the bound, in one unit and in many."""
    import nervemap.llm.near_copies as N

    monkeypatch.setattr(N, "SMALL_UNIT", small)
    monkeypatch.setattr(N, "NEAREST", 1)
    draw, table = np.random.default_rng(10), []
    for i in range(120):
        v = [f"b{x}" for x in range(200)]
        for at in draw.choice(200, 2 + i % 3, replace=False):
            v[at] = f"x{i}"
        table.append((i, " ".join(v)))
    sets = [shingles(t) for _, t in table]
    label = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    group = N.near_copies(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    keys = spark.createDataFrame(table, "doc_id long, text string").select("doc_id", *N.text_key(F.col("text")))
    got = {r["doc_id"]: r["group"] for r in keys.join(group, N.KEY).collect()}
    assert len(set(zip((got[i] for i in range(120)), label, strict=True))) == len(set(got.values())) == len(set(label)) > 10


def test_no_row_with_a_near_one_is_left_out():
    """In a large variant: a text near another that is near the hub, however often it is drawn."""
    import nervemap.llm.near_copies as N

    for seed in range(60):
        draw = np.random.default_rng(seed)
        n, bits = 301, 64 * N.CARRIED
        flags = np.tile(draw.integers(0, 2, bits, dtype=np.uint8), (n, 1))
        flags[:299] ^= draw.random((299, bits)) < 0.06
        far, chain = draw.permutation(bits)[:25], None
        flags[299] = flags[0]
        flags[299, far] ^= 1
        flags[300] = flags[299]
        chain = draw.permutation(bits)[:22]
        flags[300, chain] ^= 1
        s = np.packbits(flags[draw.permutation(n)], axis=1, bitorder="little").view(np.uint64)
        a, b, d = N.nearest_met(s, np.arange(n), np.array([0]), 35)
        apart = np.array([N._apart(s, np.arange(n), np.full(n, i)) for i in range(n)])
        assert all(apart[x, y] == z <= 35 for x, y, z in zip(a, b, d))
        np.fill_diagonal(apart, 99)
        assert set(np.flatnonzero(apart.min(axis=1) <= 35)) == set(a.tolist()) | set(b.tolist())


@pytest.mark.parametrize("size", [65, 700, 2000])
def test_chains_off_large_groups(spark, size):
    """Texts that hang on a large group by another one that isn't in its middle either."""
    import nervemap.llm.near_copies as N

    draw = np.random.default_rng(size)
    base = [f"b{x}" for x in range(300)]
    table = [" ".join(base)]
    for i in range(size):
        v = list(base)
        v[int(draw.integers(0, 300))] = f"x{i}"
        table.append(" ".join(v))
    for chain in range(12):
        v = list(base)
        for link in range(3):  # each step changes another stretch of 5 words in a row, and so 9 shingles, at 0.82 or so of the one before
            for at in (40 + 80 * link, 60 + 80 * link, 75 + 80 * link):
                v[at : at + 6] = [f"c{chain}{link}{at}{k}" for k in range(6)]
            table.append(" ".join(v))
    sets = [shingles(t) for t in table]
    steps = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for c in range(12) for i, j in [(0, size + 1 + 3 * c), (size + 1 + 3 * c, size + 2 + 3 * c), (size + 2 + 3 * c, size + 3 + 3 * c)]]
    assert min(steps) >= 0.8 and len(sets[0] & sets[-1]) / len(sets[0] | sets[-1]) < 0.6
    got = N.near_copies(spark.createDataFrame([(t,) for t in table], "text string").repartition(4))
    # every step is a pair near the bound, of which about 1 in 100 may meet nowhere
    assert got.select("group").distinct().count() <= 2 and got.count() == len(set(table))


def test_texts_that_share_a_hash(spark, monkeypatch):
    import nervemap.llm.near_copies as N

    usual = N.text_key
    monkeypatch.setattr(N, "text_key", lambda t: [F.lit(7).cast("long").alias("_k1"), *usual(t)[1:]])
    table = [(i, " ".join(f"w{i // 2}{x}" for x in range(40)) + " same" * (i % 2)) for i in range(20)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = df.select("doc_id", *N.text_key(F.col("text"))).join(N.near_copies(df), N.KEY).collect()
    assert len(got) == 20 and len({r["group"] for r in got}) == 10 and len({(r["doc_id"] // 2, r["group"]) for r in got}) == 10
