"""SimHash near-duplicates: fingerprints that meet in the middle of their Hamming balls.

Two fingerprints within ``radius`` bits (even) share a value within half of it from either. Every distinct fingerprint
therefore stands for all its variants of at most ``radius // 2`` flipped bits, 2,081 for a radius of 4; variants
are shuffled by their lowest bits: a fingerprint goes to each of the few keys that some variant of it has, and the
variants with that key are made there, sorted, and those that collide give links. A link is verified
by counting differing bits. No pair of a group is emitted twice, and a task hands on a forest of what it linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nervemap.llm.decontamination import KEY, text_key
from nervemap.operators.graph import connected_components
from nervemap.runtime import hot_join, materialize, partitions, trimmed

BITS = 64
#: Variants made at once in a task (8 bytes each, some copies of it); larger keys are split by further bits.
AT_ONCE = 1_000_000
#: Fingerprints that a key gets on average.
PER_KEY = 16_384


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64, seed 42, of every ``width``-word shingle (A-Z in lower case, joined by spaces); fewer words: of all; none: nothing."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(whole, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, width: int, step: int = 65_536) -> int:
    """Bit b is set if it is set in over half the shingle hashes; without words 0. Bits are unpacked for ``step`` shingles at once."""
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), step):
        part = np.array(hashes[lo : lo + step], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.array([fingerprint(t.as_py(), width) for t in batch["text"]], dtype=np.uint64)
            yield batch.drop_columns(["text"]).append_column("fp", pa.array(value.view(np.int64)))

    return run


@lru_cache(maxsize=64)
def masks(low: int, most: int) -> np.ndarray:
    """All masks over bits low..63 with at most ``most`` bits set."""
    bits = [1 << b for b in range(low, BITS)]
    return np.array([sum(c) for n in range(most + 1) for c in combinations(bits, n)], dtype=np.uint64)


def linked(fps: np.ndarray, spare: np.ndarray, low: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among distinct fingerprints whose variants flip at most ``spare`` of the bits from ``low`` on."""
    total = int(sum(np.count_nonzero(spare == r) * len(masks(low, r)) for r in range(radius // 2 + 1)))
    if len(fps) < 2:
        return
    if total > AT_ONCE and low < BITS:
        step = min(4, BITS - low)
        here = (fps >> np.uint64(low)).astype(np.int64) & ((1 << step) - 1)
        for key in range(1 << step):
            rest = spare - np.bitwise_count(here ^ key).astype(np.int64)
            at = np.flatnonzero(rest >= 0)
            yield from linked(fps[at], rest[at], low + step, radius)
        return
    # which bits below ``low`` a variant has is the same for all here; it is known by those from ``low`` on
    top = fps >> np.uint64(low) if low < BITS else np.zeros_like(fps)
    made, owners = [], []
    for r in range(radius // 2 + 1):
        at = np.flatnonzero(spare == r)
        if len(at):
            m = masks(low, r) >> np.uint64(low) if low < BITS else np.zeros(1, dtype=np.uint64)
            made.append((top[at][:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(at, len(m)))
    variants, owner = np.concatenate(made), np.concatenate(owners)
    order = np.sort(variants)
    shared = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(shared):
        return
    group = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
    at = np.flatnonzero(shared[group] == variants)
    group, owner = group[at], owner[at]
    first = np.full(len(shared), len(fps), dtype=np.int64)
    np.minimum.at(first, group, owner)
    pairs = np.unique(first[group] * len(fps) + owner)
    a, b = fps[pairs // len(fps)], fps[pairs % len(fps)]
    good = (a != b) & (np.bitwise_count(a ^ b) <= radius)
    yield a[good], b[good]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join what the links (a, b) join: each fingerprint and the smallest of its component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(names)))
    return names[own], names[label[own]]


def _links(low: int, radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)) for pdf in batches]
        if not parts:
            return
        keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        fps = fps.view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, fps = keys[order], fps[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> pd.DataFrame:
            a, b = forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            own = fps[lo:hi]
            spare = radius // 2 - np.bitwise_count((own & np.uint64((1 << low) - 1)) ^ np.uint64(keys[lo])).astype(np.int64)
            for x in linked(own, spare, low, radius):
                found.append(x)
                size += len(x[0])
                if size > 500_000:
                    yield joined()
                    found, size = [], 0
        if found:
            yield joined()

    return run


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` of a table, such that all within ``radius`` bits are connected."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even")
    n, half = fps.count(), radius // 2
    low = 6
    near = lambda b: sum(1 for k in range(half + 1) for _ in combinations(range(b), k))
    while low < 30 and n * near(low) > PER_KEY << low:
        low += 1
    flips = F.array(*(F.lit(sum(1 << b for b in c)).cast("long") for k in range(half + 1) for c in combinations(range(low), k)))
    own = F.col("fp").bitwiseAND(F.lit((1 << low) - 1))
    sent = fps.select("fp", F.explode(F.transform(flips, lambda m: own.bitwiseXOR(m))).alias("key"))
    tasks = max(partitions(fps.sparkSession), min(1 << low, n * near(low) // 400_000))
    return sent.repartition(tasks, "key").mapInPandas(_links(low, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, group, and the key of its text.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; component_id is the smallest id of all
    that can be reached, the row itself included (null if all those ids are null); group names the component even then. Null and empty texts have fingerprint
    zero and are linked like any others; so are repeated rows. An empty table gives an empty result. Other
    columns play no part.
    """
    slim = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialize(slim.mapInArrow(trimmed(_fingerprints(width)), f"id {kind}, _k1 long, _k2 long, _k3 int, fp long"), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    components = connected_components(fingerprint_links(fps.select("fp"), radius), "a", "b")
    named = fps.join(components.withColumnsRenamed({"vertex": "fp", "component": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "named-fingerprints")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = materialize(hot_join(named.select("fp", "root"), least, "root"), "components")
    return hot_join(rows, of_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("root").alias("group"), *KEY)
