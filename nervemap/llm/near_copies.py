"""Near copies by similarity: pairs whose sets of word shingles have a Jaccard similarity of a bound or more, through SimHash.

A text of that similarity differs from its like in too many of 64 bits for a ball around one fingerprint. Each text therefore gets a
sketch of 1,024 bits, of which about 155 differ at a similarity of 0.8, and of these bits several short fingerprints, one
of which at least is within two bits of its like's. Those meet in the middle: a fingerprint stands for its variants of one
flipped bit at most, which are shuffled by their lowest bits and made where these send it. Texts that share a variant
and are near in their sketches are candidates; all that count are proved on the texts. A first round proves the few nearest candidates of each
text, and a large group is joined by a hub, so that it takes some pairs a text, never all its pairs. A second one proves every candidate pair that is
still between different components; only texts that had a candidate in the first can have one. These pairs, which can be as many as the square of
a group's size, are never rows: what they join is a cluster, whose texts meet block by block in memory. Sketches alone are shuffled by variants, and
of the texts only those of candidates are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nervemap.llm.decontamination import KEY, text_key
from nervemap.llm.simhash import shingle_hashes
from nervemap.operators.graph import connected_components, forest
from nervemap.runtime import hot_join, materialize, partitions, trimmed

#: Words of 64 bits in a sketch, and how many of them go with the rows of a band in the first round; in the second all do.
WORDS, CARRIED = 16, 2
#: Bits of a short fingerprint (more of them for more texts than 2^22), how many of these two texts may differ in, and the share of pairs at the bound that may meet in no fingerprint.
BITS, RADIUS, MISSED = 24, 2, 0.006
#: Rows that a key of variants gets at most on average, and the lowest bits that keys have at least.
PER_KEY, LOW = 500_000, 2
#: Texts of a variant from which the nearest are looked for in a few sorted orders, and by a hub, rather than each with each in the first round.
LARGE = 64
#: Those orders, and how far ahead they are looked through.
ORDERS, AHEAD = 4, 6
#: Candidates of a text that the first round proves, and those that it compares for them in all their bits; the second one proves the rest.
NEAREST, COMPARED = 4, 16
#: Standard deviations above the mean of differing bits up to which a pair is a candidate, by the words carried and by all.
SLACK, SLACK_ALL = 4.0, 2.5
#: Texts and bytes of a block at most, on average; a smaller cluster is dealt into up to SPREAD blocks of SMALL_UNIT texts or more.
UNIT, UNIT_BYTES, SPREAD, SMALL_UNIT = 2048, 16 << 20, 16, 64
#: Tasks that a text of many pairs is sent to.
SALTS = 64
#: Texts of candidates up to which their keys (28 bytes each) are broadcast to find them; beyond, they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; all texts without words have the same single one."""
    return np.unique(np.array(shingle_hashes(text, width) or [0], dtype=np.uint64))


def sketch(hashes: np.ndarray, step: int = 16_384) -> np.ndarray:
    """WORDS majority fingerprints of a set of hashes, each of them by another mixing of the hashes."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for lo in range(0, len(hashes), step):
        x = hashes[lo : lo + step, None] + np.arange(WORDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def differing(similarity: float) -> float:
    """Share of differing bits of two sets of equal size."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([sketch(shingle_set(t.as_py(), width)) for t in batch["text"]], dtype=np.uint64).reshape(-1, WORDS)
            out = batch.drop_columns(["text"])
            for k in range(WORDS):
                out = out.append_column(f"s{k}", pa.array(made[:, k].view(np.int64)))
            yield out

    return run


def _words(n: int) -> list[str]:
    return [f"s{k}" for k in range(n)]


def met_share(similarity: float, bits: int) -> float:
    """Share of pairs of that similarity of which fingerprints of so many bits are within RADIUS."""
    p = differing(similarity)
    return sum(comb(bits, r) * p**r * (1 - p) ** (bits - r) for r in range(RADIUS + 1))


def _chosen(bits: int, count: int, seed: int = 0) -> np.ndarray:
    """Which bits of a sketch make each short fingerprint."""
    draw = np.random.default_rng(seed)
    return np.array([np.sort(draw.choice(64 * WORDS, bits, replace=False)) for _ in range(count)])


def _sent(bits: int, count: int, low: int, carried: list[str]):
    """Rows (key, fp, v, label, some words of the sketch) of every short fingerprint of a text, one for each value that the ``low`` lowest bits of its variants have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _chosen(bits, count)
        flips = np.array([0, *(1 << b for b in range(low))], dtype=np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_000):
                batch = whole.slice(lo, 1_000)
                n = batch.num_rows
                s = np.ascontiguousarray(np.stack([batch[f"s{k}"].to_numpy() for k in range(WORDS)], axis=1))
                flags = np.unpackbits(s.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
                fp = np.zeros((n, count), dtype=np.int64)
                for k in range(bits):
                    fp |= flags[:, chosen[:, k]].astype(np.int64) << k
                key = ((fp & ((1 << low) - 1)) | (np.arange(count, dtype=np.int64) << low)[None, :])[:, :, None] ^ flips[None, None, :]
                own = [c for c in batch.schema.names if c in ("v", "label") or c in carried]
                made = [key.ravel(), np.repeat(fp.ravel(), len(flips)), *(np.repeat(batch[c].to_numpy(), count * len(flips)) for c in own)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "fp", *own])

    return run


def meeting(fps: np.ndarray, at: int, bits: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by the variants (one flipped bit at most) whose ``low`` lowest bits are ``at``, and where each variant begins; variants of one row are left out."""
    flipped = np.bitwise_count((fps ^ at) & ((1 << low) - 1))
    free, spent = np.flatnonzero(flipped == 0), np.flatnonzero(flipped == 1)
    flips = np.array([0, *(1 << b for b in range(bits - low))], dtype=np.int64)
    variants = np.concatenate([((fps[free] >> low)[:, None] ^ flips[None, :]).ravel(), fps[spent] >> low])
    packed = np.sort(variants << 32 | np.concatenate([np.repeat(free, len(flips)), spent]))
    new = np.ones(len(packed) + 1, dtype=bool)
    new[1:-1] = packed[1:] >> 32 != packed[:-1] >> 32
    shared = ~(new[:-1] & new[1:])
    return packed[shared] & ((1 << 32) - 1), np.flatnonzero(new[:-1][shared])


def _apart(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(s[a] ^ s[b]).sum(axis=1).astype(np.int64)


def _small(row: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows that share a variant of at most LARGE rows."""
    ends = np.append(starts[1:], len(row))
    size, end = (np.repeat(x, ends - starts) for x in (ends - starts, ends))
    left, step = np.flatnonzero(size <= LARGE), 1
    while len(left := left[left + step < end[left]]):
        yield row[left], row[left + step]
        step += 1


def _large(row: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of larger variants, each once, with all that such variants join."""
    size = np.diff(np.append(starts, len(row)))
    most = np.repeat(size > LARGE, size)
    if not most.any():
        return
    first, own = np.repeat(row[starts], size)[most], row[most]
    root = np.arange(int(row.max()) + 1)
    v, p = forest(first, own)
    root[v] = p
    own = np.unique(own)
    own = own[np.argsort(root[own], kind="stable")]
    yield from np.split(own, np.flatnonzero(np.diff(root[own])) + 1)


def nearest_met(s: np.ndarray, row: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, bits) for rows sorted by variants, which begin at ``starts``: of each row the nearest found that shares a variant, and a hub of a large group.

    A row that shares a variant with another within ``most`` bits is in one of these pairs at least, however large the variant.
    """
    bits, other = np.full(len(s), 1 << 20, dtype=np.int64), np.full(len(s), -1, dtype=np.int64)

    def offer(a: np.ndarray, b: np.ndarray) -> None:
        d = _apart(s, a, b)
        order = np.argsort(-d[d <= most], kind="stable")
        a, b, d = (x[d <= most][order] for x in (a, b, d))
        for x, y in ((a, b), (b, a)):  # of equal x the last, which is the nearest, stays
            better = d < bits[x]
            bits[x[better]], other[x[better]] = d[better], y[better]

    for a, b in _small(row, starts):
        offer(a, b)
    draw, hubs = np.random.default_rng(5), [[], [], []]
    for own in _large(row, starts):
        flags = np.unpackbits(s[own].view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
        for _ in range(ORDERS):
            mixed = np.ascontiguousarray(np.packbits(flags[:, draw.permutation(flags.shape[1])[:64]], axis=1)).view(">u8").ravel()
            order = own[np.argsort(mixed, kind="stable")]
            for d in range(1, AHEAD + 1):
                offer(order[:-d], order[d:])
        left = np.arange(len(own))
        while len(left):
            around = left[_apart(s, own[left], own[left[:1]]) <= most]
            if len(around) == 1:
                # what is near it, if anything is, went with earlier hubs: it isn't alone for that
                d = _apart(s, own, own[left[:1]])
                d[left[0]] = most + 1
                if d.min() <= most:
                    for held, x in zip(hubs, (own[left[:1]], own[[np.argmin(d)]], d[[np.argmin(d)]]), strict=True):
                        held.append(x)
                left = left[1:]
                continue
            middle = np.packbits(2 * flags[around].sum(axis=0, dtype=np.int64) > len(around), bitorder="little").view(np.uint64)
            hub = around[np.argmin(np.bitwise_count(s[own[around]] ^ middle).sum(axis=1))]
            d = _apart(s, own[left], own[[hub]])
            near = (d <= most) & (left != hub)
            for held, x in zip(hubs, (own[left[near]], np.full(np.count_nonzero(near), own[hub]), d[near]), strict=True):
                held.append(x)
            left = left[d > most]  # the first row is near the hub, so this ends
    found = np.flatnonzero(bits <= most)
    return tuple(np.concatenate([x, *more]).astype(np.int64) for x, more in zip((found, other[found], bits[found]), hubs, strict=True))


def unlinked_met(label: np.ndarray, s: np.ndarray, row: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows that share a variant, have different labels and differ in at most ``most`` bits; what has a large group's commonest label isn't gone through."""
    for a, b in _small(row, starts):
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        near = _apart(s, a, b) <= most
        yield a[near], b[near]
    for own in _large(row, starts):
        of = label[own]
        names, n = np.unique(of, return_counts=True)
        major, at = names[np.argmax(n)], np.arange(len(own))
        for i in np.flatnonzero(of != major).tolist():
            others = own[(of != of[i]) & ((of == major) | (at > i))]
            near = others[_apart(s, others, own[i : i + 1]) <= most]
            yield np.full(len(near), own[i]), near


def _meet(most: int, labelled: bool, bits: int, low: int):
    """Rows (a, b, d): of a text the nearest that it meets, and hubs; with labels as few pairs as join all that are near and not linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # PER_KEY rows of 48 bytes on average, or of fewer texts with whole sketches
        if not held or sum(b.num_rows for b in held) < 2:
            return
        table = pa.Table.from_batches(held)
        del held
        order = np.lexsort((table["v"].to_numpy(), table["key"].to_numpy()))
        key, fp, v = (table[c].to_numpy()[order] for c in ("key", "fp", "v"))
        s = np.ascontiguousarray(np.stack([table[c].to_numpy()[order] for c in table.column_names if c[0] == "s"], axis=1)).view(np.uint64)
        label = table["label"].to_numpy()[order] if labelled else None
        del table, order

        def made(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, d)], ["a", "b", "d"])

        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = v[lo:hi]
            row, starts = meeting(fp[lo:hi], int(key[lo]) & ((1 << low) - 1), bits, low)
            if not len(row):
                continue
            if not labelled:
                a, b, d = nearest_met(s[lo:hi], row, starts, most)
                yield made(own[a], own[b], d)
                continue
            found: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for x in unlinked_met(label[lo:hi], s[lo:hi], row, starts, most):
                found.append(x)
                size += len(x[0])
                if size > 1_000_000:
                    found, size = [forest(*(np.concatenate(c) for c in zip(*found, strict=True)))], 0
            if found:
                a, b = forest(*(np.concatenate(c) for c in zip(*found, strict=True)))
                yield made(own[a], own[b], np.zeros(len(a)))

    return run


def _proved(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, sets = [], {}
            for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
                pair = []
                for t in (x.as_py(), y.as_py()):
                    if t not in sets:
                        if len(sets) > 1_000:
                            sets.clear()
                        sets[t] = shingle_set(t, width)
                    pair.append(sets[t])
                both = len(np.intersect1d(*pair, assume_unique=True))
                good.append(both >= similarity * (len(pair[0]) + len(pair[1]) - both))
            at = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(at), batch["b"].filter(at)], ["a", "b"])

    return run


@dataclass(frozen=True)
class _Texts:
    """The texts, ``docs`` (KEY, text), whose numbers ``named`` (v, KEY) has."""

    docs: DataFrame
    named: DataFrame

    def of(self, numbers: DataFrame) -> DataFrame:
        """(v, text) of distinct numbers v. A text is known by all of its key; its number stands for it among numbers only."""
        keys = materialize(self.named.join(numbers, "v"), "candidate-keys")
        if keys.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        return materialize(self.docs.join(keys, KEY).select("v", "text").dropDuplicates(["v"]), "candidate-texts")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()


def _proof(pairs: DataFrame, docs: _Texts, width: int, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose texts are as similar as that. A text of many pairs goes to up to SALTS tasks."""
    n = partitions(pairs.sparkSession)
    texts = docs.of(_ends(pairs))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt_b"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt_a"))
    for side in ("a", "b"):
        to = salted.select(side, f"salt_{side}").distinct()
        sent = to.join(texts.withColumnsRenamed({"v": side, "text": f"text_{side}"}), side)
        salted = salted.repartition(n, side, f"salt_{side}").join(sent.repartition(n, side, f"salt_{side}"), [side, f"salt_{side}"])
    return materialize(salted.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(_proved(width, similarity)), "a long, b long"), "links")


def unit_links(v: np.ndarray, label: np.ndarray, block: np.ndarray, s: np.ndarray, texts: list[str], most: int, width: int, similarity: float) -> tuple[list[int], list[int]]:
    """As few links as join what the proved pairs of a unit join to what labels join: pairs of two blocks, or of all if there is one."""
    up = {x: x for x in label.tolist()}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    sets: dict[int, np.ndarray] = {}
    two, a, b = bool((block != block[0]).any()), [], []
    for i in range(len(v) - 1):
        at = np.arange(i + 1, len(v))
        at = at[(label[at] != label[i]) & ((block[at] != block[i]) | (not two))]
        for j in at[_apart(s, at, np.array([i])) <= most].tolist():
            x, y = top(int(label[i])), top(int(label[j]))
            if x == y:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingle_set(texts[k], width)
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small < similarity * large:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (small + large - both):
                up[max(x, y)] = min(x, y)
                a.append(int(v[i]))
                b.append(int(v[j]))
    return a, b


def _units(most: int, width: int, similarity: float):
    """Links of the units (cluster, i, j) that a task's sorted rows hold; one unit is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            s = np.ascontiguousarray(np.stack([table[f"s{k}"].to_numpy() for k in range(WORDS)], axis=1)).view(np.uint64)
            a, b = unit_links(*(table[c].to_numpy() for c in ("v", "label", "block")), s, table["text"].to_pylist(), most, width, similarity)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])

        last = None
        for batch in batches:
            unit = np.stack([batch[c].to_numpy() for c in ("cluster", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(unit, axis=0) != 0).any(axis=1)) + 1).tolist(), len(unit)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and tuple(unit[lo].tolist()) != last:
                    yield done()
                held.append(batch.slice(lo, hi - lo))
                last = tuple(unit[lo].tolist())
        if held:
            yield done()

    return run


def _proof_within(rows: DataFrame, docs: _Texts, most: int, width: int, similarity: float) -> DataFrame:
    """Links that join all near and similar enough rows (v, label, cluster, words of the sketch) of a cluster.

    A cluster is dealt into blocks, and two of them, or one with itself, are a unit of work. Each text goes to as many units as there are
    blocks, and a unit yields fewer links than it has labels, so that pairs are compared in memory and are nobody's rows.
    """
    texts = docs.of(rows.select("v"))
    size = F.octet_length("text").cast("long")
    dealt = rows.select("v", "cluster").join(texts.select("v", size.alias("size")), "v").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    up = lambda x, each: F.ceil(F.col(x) / F.lit(each)).cast("long")
    count = F.greatest(up("n", UNIT), up("size", UNIT_BYTES), F.least(F.lit(SPREAD).cast("long"), up("n", SMALL_UNIT)), F.lit(1).cast("long"))
    blocks = materialize(dealt.select("cluster", count.alias("blocks")), "blocks")
    own = hot_join(rows, blocks, "cluster").join(texts, "v").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    sent = own.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "v", "label", "block", "text", *_words(WORDS))
    sent = sent.repartition(partitions(rows.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "v")
    return materialize(sent.mapInArrow(trimmed(_units(most, width, similarity)), "a long, b long"), "links")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """(_k1, _k2, _k3, group) of every distinct text: texts of that similarity or more are linked, group names what links reach.

    A pair is found if fingerprints of it meet and its sketches are near, as all but about 1 in 100 at the bound do and nearly all above it; every
    link is proved on the texts.
    Texts without words, null ones too, are like each other. Repeated rows are one text. Long texts count whole. An empty table gives an
    empty result. Other columns play no part.
    """
    spark = docs.sparkSession
    slim = docs.select(*text_key(F.col(text_col)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = {k: slim.schema[k].dataType.simpleString() for k in KEY} | {f"s{k}": "long" for k in range(WORDS)}
    made = slim.mapInArrow(trimmed(_sketches(width)), ", ".join(f"{c} {t}" for c, t in kinds.items())).dropDuplicates(KEY)
    made = materialize(made.withColumn("v", F.monotonically_increasing_id()), "sketches")  # written once, so a number stays
    n = made.count()
    p = differing(similarity)
    bits = max(BITS, n.bit_length() + 2)
    count = int(np.ceil(np.log(MISSED) / np.log(1 - met_share(similarity, bits))))
    most = lambda words, slack: int(64 * words * p + slack * (64 * words * p * (1 - p)) ** 0.5)
    texts = _Texts(slim, made.select("v", *KEY))

    def met(rows: DataFrame, n: int, labelled: bool) -> DataFrame:
        carried = _words(WORDS if labelled else CARRIED)
        low = LOW
        while n * (low + 1) > PER_KEY << low:
            low += 1
        sent = rows.mapInArrow(trimmed(_sent(bits, count, low, carried)), "key long, fp long, " + ", ".join(f"{c} long" for c in ("v", *["label"] * labelled, *carried)))
        sent = sent.repartition(max(partitions(spark), n * count * (low + 1) // PER_KEY), "key")
        return sent.mapInArrow(trimmed(_meet(most(WORDS, SLACK_ALL) if labelled else most(CARRIED, SLACK), labelled, bits, low)), "a long, b long, d long")

    near = materialize(met(made.select("v", *_words(WORDS)), n, False).distinct(), "near")
    both = near.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("n") <= COMPARED).select("a", "b")
    for x in ("a", "b"):
        both = both.join(made.select(F.col("v").alias(x), F.array(*_words(WORDS)).alias(f"s_{x}")), x)
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    ranked = both.select("a", "b", apart.alias("d")).where(F.col("d") <= most(WORDS, SLACK_ALL))
    nearest = ranked.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("n") <= NEAREST)
    tried = materialize(nearest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    links = _proof(tried, texts, width, similarity)
    parts = connected_components(links, "a", "b")
    rows = made.join(_ends(near), "v").join(parts, F.col("v") == F.col("vertex"), "left").select("v", F.coalesce("component", "v").alias("label"), *_words(WORDS))
    rows = materialize(rows, "labelled-sketches")
    apart = connected_components(met(rows, rows.count(), True), "a", "b")
    rest = materialize(rows.join(apart.select(F.col("vertex").alias("v"), F.col("component").alias("cluster")), "v"), "clusters")
    if not rest.isEmpty():
        links = links.unionByName(_proof_within(rest, texts, most(WORDS, SLACK_ALL), width, similarity))
        parts = connected_components(links, "a", "b")
    return made.join(parts, F.col("v") == F.col("vertex"), "left").select(*KEY, F.coalesce("component", "v").alias("group"))
