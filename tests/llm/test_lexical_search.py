"""Ranked search against every document scored by definition."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nervemap.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """Sorted (item_id, rank, doc_id, score) by definition."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // n_words if b else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def tables():
    draw = np.random.default_rng(3)
    words = ["the", "of", "And", "été", "x1", "日本", "rare", "don't", "A-B", *(f"w{i}" for i in range(300))]
    share = np.r_[[0.2, 0.15, 0.1, 0.05, 0.05, 0.02, 0.005, 0.02, 0.02], np.full(300, 0.385 / 300)]
    texts = [" ".join(draw.choice(words, int(draw.integers(1, 60)), p=share / share.sum())) for _ in range(1500)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, None), (7, ""), (8, " .,! "), (None, texts[3]), (3, texts[3]), (9000, " ".join(texts[:300]))]
    docs += [(10_000 + i, "the rare W5 w5 copies") for i in range(900)]  # ties for the last place
    items = [(i, " ".join(draw.choice(words, int(draw.integers(1, 12)), p=share / share.sum()))) for i in range(20)]
    items += [(50, "rare w5"), (51, "the"), (52, None), (53, ""), (54, "nowhere at all"), (None, "w9 of the"), (50, "copies"), (55, "of The OF the")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return d.withColumns({c: F.lit("x") for c in ("id", "item", "score", "rank", "terms", "df", "_n", "_item")}), i.withColumns({c: F.lit(1) for c in ("id", "item", "doc_id", "term")})


@pytest.mark.parametrize("setting", ["usual", "all terms", "groups"])
def test_against_plain(frames, setting, monkeypatch):
    if setting == "all terms":
        monkeypatch.setattr(L, "VOCABULARY", 3)
    if setting == "groups":
        monkeypatch.setattr(L, "ITEMS", 9)
    got = [tuple(r) for r in L.ranked_search(*frames, k=10).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == plain(*tables(), 10)


def test_no_rows(spark, frames):
    docs, items = frames
    assert L.ranked_search(docs.limit(0), items).collect() == []
    assert L.ranked_search(docs, items.limit(0)).collect() == []


def test_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "two one"), (None, "one two")], "doc_id string, text string")
    got = L.ranked_search(docs, spark.createDataFrame([("q", "Two")], "item_id string, text string"), k=2).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [("q", 1, "a"), ("q", 2, "b")] and got[0]["score"] == got[1]["score"]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.integers(1, 9))
def test_terms_in_portions(text, step):
    text = text.replace("\ud800", "")
    usual, L.STEP = L.STEP, step
    try:
        assert [t.decode() for part in L.terms_of(text) for t in part] == terms(text)
    finally:
        L.STEP = usual


def test_tiers_prove(monkeypatch):
    """Whatever the floor, what a search returns is exact and complete from the floor on; rare high impacts are proved above the last tier."""
    monkeypatch.setattr(L, "FEW", 2)
    draw = np.random.default_rng(8)
    n, depths = 3000, Counter()
    rows = [np.flatnonzero(draw.random(n) < p) for p in draw.uniform(0.01, 0.6, 40)]
    cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    docs = np.concatenate(rows)
    tf = 1 + draw.geometric(0.6, len(docs)) * (draw.random(len(docs)) < 0.3)
    impact = L.impacts(tf, draw.integers(1, 4000, n)[docs], n, 1000 * n)
    whole = np.zeros((n, 40), np.int64)
    whole[docs, np.repeat(np.arange(40), np.diff(cuts))] = impact
    row = {"ids": list(range(n)), "terms": [b"%d" % t for t in range(40)]}
    row |= {f"t{i}_{k}": x for i, t in enumerate(L.tiers_of(cuts, docs, impact)) for k, x in t.packed().items()}
    order = np.argsort(docs, kind="stable")
    term = np.repeat(np.arange(40), np.diff(cuts))
    row |= {"f_cuts": np.searchsorted(docs[order], np.arange(n + 1)).astype(np.int64).tobytes(), "f_terms": term[order].astype(np.uint32).tobytes(), "f_impact": impact[order].astype(np.uint32).tobytes()}
    block = L.Block(row, 3, 10)
    for trial in range(60):
        own = draw.choice(40, int(draw.integers(1, 9)), replace=False)
        item = L.Item(0, [b"%d" % t for t in own] + [b"absent"], [*draw.integers(1, 9000, len(own)).tolist(), 5])
        score = whole[:, own] @ np.array(item.weights[:-1])
        floor = int(np.sort(score)[-10] * draw.uniform(0.5, 1.3))
        docs_, got, depth = block.search(item, floor)
        depths[depth] += 1
        least = max(1, floor, int(np.sort(score)[-10]))
        best = np.flatnonzero(score >= least)
        assert dict(zip(docs_.tolist(), got.tolist())) | {i: score[i] for i in best} == dict(zip(docs_.tolist(), got.tolist()))
        assert all(score[i] == s for i, s in zip(docs_, got))
        assert block.floor(item).tolist() == sorted(x for x in np.sort(block.added(block.tiers[0], *block.terms(item), True))[-10:].tolist() if x > 0)
    assert depths[1] + depths[2] > 0 and depths[3] > 0
