"""Toxicity: the decoder against all paths, the language model against a count by hand, disguised words, held-out accuracy."""

import math
import os
import random
import zlib
from collections import Counter
from itertools import groupby, product
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nervemap.llm import toxicity as T

DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))
WORDS = ["idiot", "stupid", "moron", "pathetic", "worthless", "clown", "the", "tree", "of", "a", "small", "been", "soon", "reading", "letters", "every", "thing", "there"]


def symbol(c):
    return T.Channel._symbol(c)


def counted(texts):
    """Trigram counts word by word."""
    n = Counter()
    for text in texts:
        for letters, word in groupby(text.lower(), key=lambda c: symbol(c) > 0):
            if letters:
                s = [0, 0, *map(symbol, word), 0]
                n.update(zip(s, s[1:], s[2:]))
    return n


TEXTS = [" ".join(random.Random(i).choices(WORDS, k=80)) for i in range(20)] + ["Été à ß — x1y2z", "", "ÀÉ..日本 a", "one\ntwo"]


def test_language_model(spark):
    n = counted(TEXTS)
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string").repartition(3)
    two, one = Counter(), Counter()
    for (a, b, c), k in n.items():
        two[b, c] += k
        one[c] += k
    costs = T.language_model(df)
    total = sum(one.values())
    for a, b, c in [*list(n)[:60], (1, 2, 3), (0, 0, 5)]:
        p1 = lambda x: (one[x] + 1) / (total + T.SYMBOLS)
        p2 = (two[b, c] + 2 * p1(c)) / (sum(k for (x, _), k in two.items() if x == b) + 2)
        p3 = (n[a, b, c] + 2 * p2) / (sum(k for (x, y, _), k in n.items() if (x, y) == (a, b)) + 2)
        assert math.isclose(costs[(a * T.SYMBOLS + b) * T.SYMBOLS + c], -math.log(p3), rel_tol=1e-5)
    assert len(costs) == T.SYMBOLS**3


@settings(max_examples=80, deadline=None)
@given(st.text("aé日 .\n-1", max_size=40))
def test_trigrams(text):
    codes = Counter(T.trigrams(text).tolist())
    assert codes == Counter({(a * T.SYMBOLS + b) * T.SYMBOLS + c: k for (a, b, c), k in counted([text]).items()})


@pytest.fixture(scope="module")
def channel():
    n = np.zeros(T.SYMBOLS**3)
    for (a, b, c), k in counted(TEXTS).items():
        n[(a * T.SYMBOLS + b) * T.SYMBOLS + c] += k
    n = n.reshape(T.SYMBOLS, T.SYMBOLS, T.SYMBOLS)
    return T.Channel(-np.log((n + 0.05) / (n.sum(axis=2, keepdims=True) + 0.05 * T.SYMBOLS)).reshape(-1))


def all_paths(channel, raw, joined):
    """The cost of every path of the lattice."""
    runs = [(c, len(list(g))) for c, g in groupby(raw.lower())]
    for way in product(*(channel._edges(c, n, joined) for c, n in runs)):
        cost, x, y = sum(w for w, _ in way), 0, 0
        out = "".join(o for _, o in way)
        words = " ".join(out.split())
        for word in words.split():
            x, y = 0, 0
            for s in [*map(symbol, word), 0]:
                cost += channel.costs[(x * T.SYMBOLS + y) * T.SYMBOLS + s]
                x, y = y, s
        yield cost, words


@pytest.mark.parametrize("raw,joined", [("1d10t", False), ("$tuupid", False), ("m0oor0n", False), ("w0rthl3ss", False), ("i.d.i.o.t", True), ("m o r 0 n", True), ("5o0n!x", False), ("12", False), ("a+b", False), ("treee", False)])
def test_cheapest_path(channel, raw, joined):
    found = channel.decode(raw, joined)
    paths = sorted(all_paths(channel, raw, joined))
    assert any(" ".join(found.split()) == w and math.isclose(c, paths[0][0]) for c, w in paths)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("etosanéx"), st.integers(1, 4)), min_size=1, max_size=7))
def test_repetitions_alone(channel, runs):
    """Deciding each repetition by itself is as cheap as the lattice."""
    word = "".join(c * n for c, n in runs)
    cost = {}
    for c, w in all_paths(channel, word, False):
        cost[w] = min(c, cost.get(w, c))
    assert math.isclose(cost[channel.restored(word)], min(cost.values())) and math.isclose(cost[channel.decode(word)], min(cost.values()))


@pytest.mark.parametrize("raw,want", [("1d10t", "idiot"), ("Stuuuupid!!", "stupid"), ("m0r0n,", "moron"), ("(cl0wn)", "clown"), ("p4thet1c", "pathetic"), ("i-d-i-o-t", "idiot"), ("c.l.o.w.n.", "clown"), ("Tree", "tree"), ("soon", "soon"), ("...", ""), ("", ""), ("日本", "日本")])
def test_restored(channel, raw, want):
    assert channel.restored(raw) == want


def test_spaced_letters(channel):
    words, spaced = T.tokens("so a m 0 r o n is I in the s t u p i d")
    assert words == ["so", "is", "I", "in", "the"] and spaced == ["a m 0 r o n", "s t u p i d"]
    assert channel.decode(spaced[1], joined=True) == "stupid"


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", max_size=60), st.integers(1, 9))
def test_portions(text, step):
    usual, T.STEP = T.STEP, step
    try:
        assert "".join(T.portions(text)) == text
    finally:
        T.STEP = usual


def table(n=1200):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = draw.choices(WORDS[6:], k=draw.randint(5, 120))
        toxic = draw.random() < 0.3
        if toxic:
            for _ in range(max(2, len(words) // 12)):
                words.insert(draw.randrange(len(words)), draw.choice(WORDS[:6]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def disguised(text, draw):
    signs = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}
    out = []
    for w in text.split():
        if w in WORDS[:6]:
            kind = draw.randrange(3)
            at = draw.randrange(len(w))
            w = "".join(signs.get(c, c) for c in w) if kind == 0 else w[:at] + w[at] * 4 + w[at + 1 :] if kind == 1 else ".".join(w)
        out.append(w)
    return " ".join(out)


def test_learns_words_not_their_disguise(spark):
    rows, labels = table()
    docs = spark.createDataFrame([*rows, (None, None), (9_000, ""), (9_001, None)], "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("y", "id", "own", "bucket", "x", "score")})
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (77_777, 1)], "doc_id long, toxic int")
    model = T.fit(docs, marks)
    scored = T.with_toxicity(docs, model)
    assert scored.count() == len(rows) + 3 and set(scored.columns) == {*docs.columns, "predicted"}
    got = {r["doc_id"]: r for r in scored.collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    truth = dict(labels)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    draw, text = random.Random(9), dict(rows)
    toxic = [i for i in held if truth[i]]
    assert np.mean(model.scores([disguised(text[i], draw) for i in toxic]) >= 0.3) > 0.9
    restored = T.with_restored(spark.createDataFrame([("Y0u st0pp3d, 1diot", 1), (None, 2)], "text string, restored int"), model.costs)
    assert [r["restored"] for r in restored.orderBy(F.col("text").isNull()).collect()][1] is None


def test_no_labels_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in T.with_toxicity(docs, T.fit(docs, none)).collect()} == {0.5}
    assert T.with_toxicity(docs.limit(0), T.fit(docs.limit(0), none)).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_held_out(spark):
    docs = spark.read.parquet(str(DATA / "sf0.1" / "documents.parquet")).select("doc_id", "text")
    labels = spark.read.parquet(str(DATA / "sf0.1" / "labels.parquet")).where("toxic is not null")
    rows = T.with_toxicity(docs, T.fit(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").select("toxic", "predicted").collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.9 and np.mean([r["predicted"] for r in rows if not r["toxic"]]) < 0.04
