"""Operators against plain versions: sharding, packing, search, preferences, near duplicates, decontamination, substrings."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nervemap.llm.queries import _tokenizer

RNG = np.random.default_rng(11)
DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))
WORDS = ["alpha", "beta", "Gamma", "delta,", "epsilon.", "zeta", "été", "ß", "eta", "theta"]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def texts():
    long = prose(400, 1)
    out = [None, "", " \n\t ", "a", "One two three four five", long, long, long + " tail", "tail " + long, prose(5000, 2), "x" * 700, "日本語 テキスト です"]
    out += [prose(60, s) for s in range(3, 12)]
    out.append(" ".join(["changed" if i == 200 else w for i, w in enumerate(long.split())]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts())] + [(None, "a", None, None, 1), (5, texts()[5], "en", "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def clashing(df):
    """The table with more columns, named as operators name theirs."""
    return df.withColumns({c: F.lit("x") for c in ("_k1", "fp", "id", "block", "part", "size", "shard", "score", "length", "_row", "component_id", "n_words", "x")})


# sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.integers(0, 5))
def test_permutation_and_inverse(n, seed):
    from nervemap.llm.sharding import FeistelPermutation

    p = FeistelPermutation(n, seed)
    seen = [p.forward(x) for x in range(n)]
    assert sorted(seen) == list(range(n)) and [p.inverse(y) for y in seen] == list(range(n))


def test_permutation_of_many():
    from nervemap.llm.sharding import FeistelPermutation

    p = FeistelPermutation(10**12 + 7, 3)
    for x in (0, 1, 10**11, 10**12 + 6):
        assert p.inverse(p.forward(x)) == x and p.forward(x) < p.n
    with pytest.raises(ValueError):
        FeistelPermutation(5, rounds=3)


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_sharding(docs, pairs, shards):
    from nervemap.llm.sharding import FeistelPermutation, shard_rows

    got = shard_rows(clashing(docs), shards=shards, seed=1).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in pairs)
    slots = defaultdict(list)
    perm = FeistelPermutation(len(pairs), 1)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
        assert r["slot"] * shards + r["shard"] == perm.forward(r["row_number"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    again = shard_rows(docs.repartition(7), shards=shards, seed=1).collect()
    key = lambda r: (r["doc_id"], r["size"], r["shard"], r["slot"])
    assert Counter(map(key, got)) == Counter(map(key, again))


def test_sharding_nothing(docs):
    from nervemap.llm.sharding import shard_rows

    assert shard_rows(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        shard_rows(docs, shards=0)


# packing


def test_packing(docs, pairs):
    from tokenizers import Tokenizer

    from nervemap.llm.packing import pack

    model = Tokenizer.from_file(_tokenizer())
    want = Counter()
    for i, t in pairs:
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        for k, lo in enumerate(range(0, len(ids), 256)):
            part = ids[lo : lo + 256]
            want[i, k, lo, len(part), zlib.crc32(part.tobytes())] += 1
    got = pack(clashing(docs).drop("length"), _tokenizer(), capacity=256, bins=16).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for runs in held.values():
        at = 0
        for offset, n in sorted(runs):
            assert offset == at
            at += n
        assert at <= 256
    assert pack(docs.where("false"), _tokenizer()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=30), st.sampled_from([4, 10, 100]))
def test_plan_holds_everything(histogram, bins):
    from nervemap.llm.packing import plan

    held = Counter()
    for layout in plan(histogram, 100, bins, 4):
        assert layout.repeats > 0 and sum(x * k for x, k in layout.runs) <= 100
        for x, k in layout.runs:
            held[x] += k * layout.repeats
    assert held == Counter(histogram)


def test_plan_is_tight():
    from nervemap.llm.packing import plan

    sizes = np.minimum(4096, np.exp(RNG.normal(6.5, 1.0, 30_000)).astype(int) + 1)
    h = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    assert sum(x.repeats for x in plan(h, 4096)) <= 1.005 * -(-int(sizes.sum()) // 4096)
    with pytest.raises(ValueError):
        plan({101: 1}, 100)


def _ids(path, texts):
    import pyarrow as pa

    import nervemap.llm.packing as P

    out = [None] * len(texts)
    for first, ids, sizes in P.text_ids(P.WordIds(path), pa.array(texts, pa.string())):
        for i, (at, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True), first):
            out[i] = ids[at : at + n].tolist()
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("together", [6 << 20, 300])
def test_ids_of_any_text(name, together, monkeypatch):
    from tokenizers import Tokenizer

    import nervemap.llm.packing as P

    monkeypatch.setattr(P, "TOGETHER", together)
    model = Tokenizer.from_file(_tokenizer(name))
    odd = ["", "<|endoftext|> a", "a<|ENDOFTEXT|>b <|start of", "x\u0301 \u00e9", "a\tb\r\nc\x0bd\x0ce\x1cf\x85g", "İstanbul ǅ it's 'S can't 12345 !!!??", "\x00 a\x01b", "Ünï©ode ÀÉ, ÿ. µ ª", "ΣΑΣ ς", " \u0301 a", *[t or "" for t in texts()]]
    draw = np.random.default_rng(6)
    letters = [*"abcdeghi iÀéßÖ÷×'’.,!?-_<|>0129 \t\n", "'s", "<|endoftext|>", "the ", "ing ", "ÀB", "\u0300x", "漢字"]
    odd += ["".join(draw.choice(letters, draw.integers(0, 40))) for _ in range(3000)]
    assert P.WordIds(_tokenizer(name)).merges is None or name.startswith("word")
    assert _ids(_tokenizer(name), [*odd, None]) == [x.ids for x in model.encode_batch([*odd, ""], add_special_tokens=False)]


def test_no_more_sequences_than_best_fit_alone():
    from nervemap.llm.packing import _realised, plan

    draw = np.random.default_rng(1)
    shapes = [np.minimum(4096, np.exp(draw.normal(6.5, 1.0, 9_000)).astype(int) + 1), np.minimum(4096, np.exp(draw.normal(7.5, 0.7, 9_000)).astype(int) + 1), draw.integers(1, 4097, 9_000), draw.integers(1000, 3000, 9_000), draw.integers(1000, 3000, 50), np.array([4096] * 9 + [1])]
    for sizes in shapes:
        h = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        alone = _realised([], np.bincount(sizes, minlength=4097), 4096, 32)
        assert sum(x.repeats for x in plan(h, 4096)) <= sum(x.repeats for x in alone)


# search


def search(rows, k, every):
    good = []
    for i, v in rows:
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for n, (i, q) in enumerate(good):
        if i is not None and i % every == 0:
            top = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j is None, j or 0) for m, (j, c) in enumerate(good) if m != n)[:k]
            out.update((i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(top))
    return out


@pytest.mark.parametrize("spread", [0.05, 1.0, 1e4, 1e14])
def test_search(spark, spread, monkeypatch):
    import nervemap.llm.topk_search as S

    v = (RNG.normal(0, spread, (90, 8))).astype(np.float32)
    v[5:25] = v[4]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(100, None), (None, rows[0][1]), (None, rows[4][1]), (120, [None] * 8), (140, [float("nan")] * 8), (160, [float("inf")] * 8), (180, [0.0] * 8), (40, v[41].tolist()), (40, v[40].tolist()), (41, v[3].tolist()), (200, v[7].tolist()[:5]), (201, []), (220, [])]
    if spread == 1e14:  # scores of about 2**63 don't fit
        rows = [(i, None if x is None else [y / 1e8 if y is not None else y for y in x]) for i, x in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit(1)).withColumn("row", F.lit(1)).withColumn("c", F.lit("x"))
    want = search(rows, 7, 20)
    got = lambda: Counter(tuple(r) for r in S.top_k(df, k=7, every=20).collect())
    assert got() == want
    monkeypatch.setattr(S, "CANDIDATES", 16)
    monkeypatch.setattr(S, "QUERIES", 2)
    monkeypatch.setattr(S, "IMPACTS", 5)
    monkeypatch.setattr(S, "FEW", 1)
    assert got() == want
    assert S.top_k(df.where("vec_id = 0"), k=7).count() == 0 and S.top_k(df.where("false")).count() == 0


@pytest.mark.parametrize("impacts", [1024, 12])
def test_search_stops_on_proof(impacts, monkeypatch):
    """On vectors like those of the tables: queries stop early, score few rows again, and miss none."""
    import nervemap.llm.topk_search as S

    monkeypatch.setattr(S, "IMPACTS", impacts)
    if (DATA / "sf0.01").exists():
        import pyarrow.parquet as pq

        raw = pq.read_table(DATA / "sf0.1" / "embeddings.parquet").column("embedding").to_pylist()
    else:
        raw = RNG.normal(0, 1, (2000, 64))
        raw = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).tolist()
    c = np.floor(64 * np.array(raw)).astype(np.int64)
    ids = RNG.permutation(len(c))
    index = S.Index.unpacked(S.Index.of(ids, np.arange(len(c)), c).packed())
    assert int(np.diff(index.cuts).sum()) == np.count_nonzero(c) and len(set(zip(index.dim.tolist(), index.impact.tolist(), strict=True))) == len(index.dim)
    searcher, early = S.Searcher(index, 20), []
    for i in range(0, len(c), 20):
        found, exact = searcher.search(c[i], i), c @ c[i]
        order = sorted((-int(exact[j]), int(ids[j]), j) for j in range(len(c)) if j != i)[:20]
        assert [j for _, _, j in order] == found.at.tolist() and [-s for s, _, _ in order] == found.score.tolist()
        early.append((found.proved, found.postings / len(index.members), found.rescored))
    if impacts > 1000:
        assert all(p for p, _, _ in early) and np.mean([x for _, x, _ in early]) < 0.7 and all(r <= 1280 for _, _, r in early)


@pytest.mark.parametrize(("spread", "at_once"), [(8, 1 << 18), (8, 1), (1 << 24, 1 << 18), (1 << 24, 1)])
def test_search_adds_many_segments_at_once(spread, at_once, monkeypatch):
    """Few sums for thousands of segments, and the same best, where doubles hold the sums and where they don't."""
    import nervemap.llm.topk_search as S

    monkeypatch.setattr(S, "AT_ONCE", at_once)
    draw, calls = np.random.default_rng(3), []
    c = np.round(draw.normal(0, spread, (3000, 32))).astype(np.int64)
    searcher = S.Searcher(S.Index.of(np.arange(len(c)), np.arange(len(c)), c), 9)
    plain = np.bincount
    monkeypatch.setattr(S.np, "bincount", lambda *a, **k: calls.append(1) or plain(*a, **k))
    for i in range(0, 3000, 600):
        found, exact = searcher.search(c[i], i), c @ c[i]
        order = sorted((-int(exact[j]), j) for j in range(len(c)) if j != i)[:9]
        assert [j for _, j in order] == found.at.tolist() and [-x for x, _ in order] == found.score.tolist()
    assert (0 < len(calls) < 5 * 40 < len(searcher.segments) if spread == 8 else not calls) or at_once == 1


# preferences


def test_preferences(spark):
    from nervemap.llm.preferences import format_preferences, preference_pairs

    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no <|x|>")
    rows = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [a], [b]), (4, None, [u]), (5, [u, a, u, b], [u, a, u]), (6, [(None, None), a], [(None, None), b])]
    df = spark.createDataFrame(rows, "k int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("prompt", F.lit("x")).withColumns({c: F.lit("mine") for c in ("_x", "_a", "_b", "turns", "chosen_side")})
    assert all(r[c] == "mine" for r in format_preferences(df).collect() for c in ("_x", "_a", "_b", "turns", "chosen_side"))
    got = {r["k"]: r for r in format_preferences(df).collect()}
    turn = lambda t: f"<|{t[0] or ''}|>\n{(t[1] or '').replace('<|', '< |')}<|end|>\n"
    for k, x, y in rows:
        x, y = x or [], y or []
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        r = got[k]
        assert (r["n_prompt_turns"], r["prompt"]) == (n, "".join(map(turn, x[:n])))
        for side, rest in (("chosen", x[n:]), ("rejected", y[n:])):
            text = r[f"{side}_completion"]
            assert text == "".join(map(turn, rest))
            seen = [text[s["start"] : s["end"]] for s in r[f"{side}_spans"]]
            assert seen == [turn(t).split("\n", 1)[1] for t in rest if t[0] == "assistant"]
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s"), (2, 0, "user", "q"), (3, 0, "assistant", "z"), (3, 0, "assistant", "z"), (None, 0, "assistant", None), (None, 1, "user", "w"), (None, 1, "user", "w")]
    made = preference_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    alone = [r for r in made if r[0] is None]
    assert sorted(len(r["chosen"]) for r in alone) == [1, 1]
    made = {r[0]: r for r in made} | {None: next(r for r in alone if r["chosen"][0]["role"] == "assistant")}
    assert set(made) == {1, 2, 3, None} and made[2]["chosen"] == made[2]["rejected"] and len(made[2]["chosen"]) == 1
    assert [t["text"] for t in made[1]["chosen"]] == ["q", "a", "r", "b"] and [t["text"] for t in made[1]["rejected"]] == ["q", "a", "r", "a"]
    assert [t["text"] for t in made[3]["rejected"]] == [""] and made[None]["chosen"][0]["text"] is None
    assert format_preferences(df.where("false")).count() == 0


# near duplicates


def fingerprint(text, width=4):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(fps, ids, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = defaultdict(list)
    for i, n in enumerate(label):
        least[n].append(ids[i])
    return [min((x for x in least[n] if x is not None), default=None) for n in label]


def test_near_duplicates(docs, pairs, monkeypatch):
    import nervemap.llm.simhash as S

    fps = [fingerprint(t) for _, t in pairs]
    want = Counter(zip([i for i, _ in pairs], [f"{x:016x}" for x in fps], reachable(fps, [i for i, _ in pairs], 4), strict=True))
    run = lambda: Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(clashing(docs)).collect())
    assert run() == want
    assert S.near_duplicates(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        S.fingerprint_links(docs, radius=3)


@pytest.mark.parametrize("at_once", [1_000_000, 2_000])
def test_balls_meet(spark, at_once, monkeypatch):
    import nervemap.llm.simhash as S

    monkeypatch.setattr(S, "AT_ONCE", at_once)
    fps = [int(x) for x in RNG.integers(0, 2**63, 60)]
    for x in fps[:30]:
        for n in (1, 3, 4, 5):
            y = x
            for b in RNG.choice(64, n, replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    fps = sorted(set(fps))
    found = []
    values = np.array(fps, dtype=np.uint64)
    for key in range(1 << 6):
        spare = 2 - np.bitwise_count((values & np.uint64(63)) ^ np.uint64(key)).astype(int)
        found += list(S.linked(values[spare >= 0], spare[spare >= 0], 6, 4))
    a, b = S.forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
    least = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [least.get(x, x) for x in fps] == reachable(fps, fps, 4)


# decontamination


def contaminated(docs, items, span=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = defaultdict(set)
    for name, t in items:
        w = split(t)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            runs[tuple(w[i : i + n])].add(str(name) if name is not None else "")
    sizes = {len(r) for r in runs}
    out = Counter()
    for key, t in docs:
        w = split(t)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in runs:
                    hit |= set(range(i, i + n))
                    names |= runs[tuple(w[i : i + n])]
        out[key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_decontamination(spark, docs, monkeypatch):
    from nervemap.llm.decontamination import decontaminate

    word = lambda n, s: " ".join(f"w{x}" for x in np.random.default_rng(s).integers(0, 500, n))
    items = [(1, word(30, 1)), (2, word(13, 2)), (3, word(12, 3)), (10, "Ab-C é9"), (4, None), (5, ""), (6, word(30, 1)), (None, word(20, 4)), (2, word(20, 5)), (7, "q " * 20)]
    rows = [(0, word(400, 9) + " " + word(30, 1).upper() + " end"), (1, word(12, 2)), (2, "x " + word(12, 3) + " y"), (3, "zz, ab c É9 ab c é9"), (4, None), (5, ""), (6, word(29, 1)[3:]), (7, word(20, 4) + " " + word(20, 4)), (8, word(20, 5)), (None, word(13, 2)), (0, word(13, 2)), (9, "q " * 500), (10, "q " * 12)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit("x")).withColumn("_k1", F.lit(1)).withColumn("runs", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate(table, bench).collect())
    assert got == contaminated(rows, items)
    import nervemap.llm.decontamination as C

    monkeypatch.setattr(C, "BROADCAST_TEXTS", 0)  # salted rows
    monkeypatch.setattr(C, "SLOTS", (64, 64))  # a filter that lets most through
    again = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate(table, bench).collect())
    assert again == got
    assert not decontaminate(table, bench.where("false")).where("n_hit > 0 or contaminated").count()
    assert decontaminate(table.where("false"), bench).count() == 0


# substrings


def removed(texts, length):
    seen = Counter()
    data = [t.encode() for t in texts]
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] += 1
    out = []
    for b in data:
        cut = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cut[p : p + length] = True
        spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
        out.append((len(b), int(cut.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut])).hexdigest()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_substrings(docs, pairs, small, monkeypatch):
    import nervemap.llm.substring_dedup as D

    if small:
        monkeypatch.setattr(D, "BLOCK", 3000)
        monkeypatch.setattr(D, "PART", 5000)
    for length, gram in ((200, 100), (40, 8)):
        want = Counter((i, *x) for (i, _), x in zip(pairs, removed([t for _, t in pairs], length), strict=True))
        got = D.repeated_spans(clashing(docs), length, gram).collect()
        assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == want
    assert D.repeated_spans(docs.where("false")).count() == 0


def test_texts_without_repeats(spark):
    from nervemap.llm.substring_dedup import without_repeats

    same = "x" * 5 + "repeated " * 12
    rows = [(1, "é" + same + "ü"), (2, "ĩ" + same + "à"), (3, same), (4, None), (5, "short é"), (6, "a" + same + "b")]
    twin = [(7, "é".encode()[:1].decode("latin-1") + same), (8, "日本" * 40), (9, "本日" * 40)]
    df = spark.createDataFrame([*rows, *twin], "doc_id long, text string")
    df = df.withColumns({c: F.lit("mine") for c in ("kept", "id", "_k1", "_k2", "block", "n_bytes", "part", "_c0", "of")})
    got = {r["doc_id"]: r for r in without_repeats(df, length=50, gram=20).collect()}
    assert without_repeats(df, length=50, gram=20).columns == df.columns
    assert all(r[c] == "mine" for r in got.values() for c in ("kept", "id", "_k1", "_k2", "block", "n_bytes", "part", "_c0", "of"))
    assert [got[i]["text"] for i in range(1, 7)] == ["", "", "", "", "short é", "ab"]  # the halves left of é and ü don't make a ü
    assert set(got[8]["text"]) <= set("日本") and set(got[9]["text"]) <= set("日本")


@pytest.mark.parametrize("steps", [2, 4])
def test_texts_added_to_a_stored_index(spark, docs, pairs, steps, monkeypatch):
    """Whatever the steps, the result is that of all texts at once; later steps find what earlier ones have left in the shared folder."""
    import nervemap.llm.substring_dedup as D

    monkeypatch.setattr(D, "BLOCK", 3000)
    index = D.SuffixIndex(40, 8, parts=3)
    sizes = []
    for k in range(steps):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) == k))
        sizes.append(index.levels.select(F.sum(F.length("data"))).first()[0])
    assert sizes == sorted(sizes) and index.levels.select("part").distinct().count() == 3
    want = Counter((i, *x) for (i, _), x in zip(pairs, removed([t for _, t in pairs], 40), strict=True))
    got = index.spans().collect()
    assert Counter(tuple(r[c] for c in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == want


def test_long_texts_come_in_pieces(monkeypatch):
    import nervemap.llm.suffixes as X

    monkeypatch.setattr(X, "STEP", 300)
    s = X.Sampler(50, 20)
    text = prose(300, 8).encode()
    r = s.records([text, b"", text[:49], text[100:400]])
    for i, t in ((0, text), (3, text[100:400])):
        own = r.text == i
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(r.low[own], r.high[own], strict=True)])
        assert sorted(starts.tolist()) == list(range(len(t) - 49))
    assert set(r.text.tolist()) == {0, 3}


@pytest.mark.parametrize("kept", [False, True])
def test_index_family(kept):
    from nervemap.llm.substring_dedup import FULL, FULL_SENDS, NONE, OPEN, IndexFamily, _packed, _unpacked

    family, seen, told = IndexFamily(), Counter(), {}
    for b in range(13):
        found = Counter((int(x), int(y)) for x, y in RNG.integers(0, 14, (9, 2)))
        pairs = sorted(found)
        seen.update(found)
        x, y = (np.array([p[i] for p in pairs], dtype=np.uint64) for i in (0, 1))
        states = family.insert(b, x, y, np.array([min(2, found[p]) for p in pairs], np.uint8))
        told[b] = (pairs, states)
        if kept and b == 7:  # written and read again; changes so far are told
            for batch, changes in family.changes.items():
                for at, s in changes:
                    np.maximum.at(told[batch][1], at, s)
            family = IndexFamily({rank: _unpacked(_packed(level)) for rank, level in family.levels.items()})
    for batch, changes in family.changes.items():
        for at, s in changes:
            np.maximum.at(told[batch][1], at, s)
    assert sorted(family.levels) == [0, 2, 3]  # 13 = 1 + 4 + 8
    assert sum(len(level.x) for level in family.levels.values()) == len(seen)
    others = Counter(x for x, _ in seen)
    for b, (pairs, states) in told.items():
        for p, s in zip(pairs, states.tolist(), strict=True):
            first = min(c for c in told if p in told[c][0]) == b
            want = (OPEN if others[p[0]] > 1 else NONE) if seen[p] == 1 else FULL_SENDS if others[p[0]] > 1 and first else FULL
            assert s == want
