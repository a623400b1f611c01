"""Removal of repeated substrings with a logarithmic family of suffix arrays.

Texts are dealt into blocks. Each block indexes sampled suffixes, such that every window of ``length`` bytes holds a sample
chosen by its own bytes alone: two equal windows share one. Sorted, a block's suffixes are one batch's suffix
array, cut by hash into as many parts as the corpus needs. For each part an index family takes one batch after another as they
stream by. A batch is merge-scanned against every level there is, which tells at once what of it repeats an earlier batch, and
which entries of earlier batches it repeats; what is new becomes a level of rank 0, and while two levels have the same rank they merge into one
of the next. An entry's state only ever rises: its suffix shares its first bytes with others, or repeats in full, or both. Each batch
is told the states of its entries when it comes, and later the changes of those that it brought first. Suffixes that share their first bytes
with others only are decided by a second family of the same kind, of their single windows.

The order is that of 64-bit hashes of the bytes, not of the bytes, so that parts are even whatever the texts are; equality is
told by 128 bits for suffixes and 96 for windows. A hot suffix is one entry of a block and one of a family, so a part holds it once and streams a row
a block of it. ``SuffixIndex`` keeps the levels in the shared folder, so that later texts are only scanned against them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.llm.decontamination import KEY, text_key
from nervemap.llm.suffixes import Records, Sampler
from nervemap.runtime import materialize, partitions, trimmed, trimmed_group

_U = np.uint64
#: Bytes of text of a block, and of the corpus for each part of the index.
BLOCK, PART = 4 << 20, 12 << 20
#: States of an entry. SHARED: others have the same first bytes. REPEATED: the whole is there again. The batch that brought an entry of both states first sends its windows.
SHARED, REPEATED = 1, 2
NONE, OPEN, FULL, FULL_SENDS = 0, SHARED, REPEATED, SHARED | REPEATED


@dataclass
class Level:
    """Distinct (x, y), sorted; their states; the batch that brought each first, and where it stands among that batch's entries."""

    x: np.ndarray
    y: np.ndarray
    state: np.ndarray
    batch: np.ndarray
    place: np.ndarray

    def merged(self, other: Level) -> Level:
        """Both in one; nothing is in both."""
        x, y, state, batch, place = (np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("x", "y", "state", "batch", "place"))
        order = np.lexsort((y, x))
        return Level(x[order], y[order], state[order], batch[order], place[order])

    def scan(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each (x, y): where the first entry of the same x is, and where it is itself; -1 if there is none."""
        if not len(self.x):
            return np.full(len(x), -1), np.full(len(x), -1)
        low, high = np.searchsorted(self.x, x, side="left"), np.searchsorted(self.x, x, side="right")
        first = np.where(high > low, low, -1)
        same = np.where((high > low) & (self.y[np.minimum(low, len(self.y) - 1)] == y), low, -1)
        more = np.flatnonzero((same < 0) & (high > low + 1))
        if len(more):
            lo, hi, want = low[more] + 1, high[more], y[more]
            for _ in range(int((hi - lo).max()).bit_length()):
                mid = (lo + hi) >> 1
                less = (mid < hi) & (self.y[np.minimum(mid, len(self.y) - 1)] < want)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            there = (lo < high[more]) & (self.y[np.minimum(lo, len(self.y) - 1)] == want)
            same[more[there]] = lo[there]
        return first, same


class IndexFamily:
    """Levels of geometrically growing size; level r holds what 2**r batches brought."""

    def __init__(self, levels: dict[int, Level] | None = None):
        self.levels: dict[int, Level] = dict(levels or {})
        self.batches = 0
        #: Changes of states that batches haven't been told yet: of each batch the places and the new states.
        self.changes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def _raise(self, level: Level, at: np.ndarray, by: int) -> None:
        at = np.unique(at[(level.state[at] & by) == 0])
        if not len(at):
            return
        level.state[at] |= by
        order = np.argsort(level.batch[at], kind="stable")
        at = at[order]
        batch = level.batch[at]
        for lo, hi in zip(*(f(np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1])))) for f in (list, lambda c: [*c[1:], len(batch)])), strict=True):
            self.changes[int(batch[lo])].append((level.place[at[lo:hi]], level.state[at[lo:hi]].copy()))

    def insert(self, batch: int, x: np.ndarray, y: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The states of a batch's entries, distinct and sorted by (x, y); ``seen``: how often each is in the batch, two meaning two or more."""
        state = np.where(seen >= 2, REPEATED, 0).astype(np.uint8)
        if len(x) > 1:
            again = x[1:] == x[:-1]
            state[1:][again] |= SHARED
            state[:-1][again] |= SHARED
        told, known = state.copy(), np.zeros(len(x), dtype=bool)
        for level in self.levels.values():
            first, same = level.scan(x, y)
            here = same >= 0
            known |= here
            told[here] = REPEATED
            self._raise(level, same[here], REPEATED)
            others = (first >= 0) & ~here
            state[others] |= SHARED
            # two entries of the same x are both marked by the time the second comes, so the first of them tells for all
            self._raise(level, first[others], SHARED)
        told[~known] = state[~known]
        new = np.flatnonzero(~known)
        if len(new):
            level, rank = Level(x[new], y[new], state[new], np.full(len(new), batch, dtype=np.int64), new.astype(np.uint32)), 0
            while rank in self.levels:
                level = self.levels.pop(rank).merged(level)
                rank += 1
            self.levels[rank] = level
        self.batches += 1
        return told


@dataclass
class Entries:
    """Distinct (x, y) of a block, ordered by part, x and y; ``of`` gives each input its entry."""

    x: np.ndarray
    y: np.ndarray
    seen: np.ndarray
    of: np.ndarray
    parts: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def from_pairs(x: np.ndarray, y: np.ndarray, times: np.ndarray, parts: int) -> Entries:
        part = (x % _U(parts)).astype(np.int64)
        order = np.lexsort((y, x, part))
        xs, ys = x[order], y[order]
        new = np.concatenate(([True], (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1]))) if len(xs) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        of = np.empty(len(x), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        seen = np.minimum(np.add.reduceat(times[order], at), 2).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
        mine = part[order][at]
        first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1]))) if len(mine) else np.zeros(0, np.int64)
        return Entries(xs[at], ys[at], seen, of, mine[first], np.append(first, len(at)))

    def rows(self, block: int, narrow: bool) -> pa.Table:
        out = []
        for part, lo, hi in zip(self.parts.tolist(), self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            y = (self.y[lo:hi] >> _U(32)).astype("<u4") if narrow else self.y[lo:hi].astype("<u8")
            out.append((part, block, self.x[lo:hi].astype("<u8").tobytes() + y.tobytes() + self.seen[lo:hi].tobytes()))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"part": pa.array(cols[0], pa.int64()), "block": pa.array(cols[1], pa.int64()), "entries": pa.array(cols[2], pa.binary())})

    def answers(self, told: list[tuple[int, int, bytes]]) -> np.ndarray:
        """The states of all entries from what the families told: (part, kind, data)."""
        out = np.zeros(len(self.x), dtype=np.uint8)
        low = dict(zip(self.parts.tolist(), zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True), strict=True))
        for part, kind, data in told:
            lo, hi = low[part]
            if kind == STATES:
                np.maximum(out[lo:hi], np.frombuffer(data, np.uint8), out=out[lo:hi])
            else:
                n = len(data) // 5
                at = lo + np.frombuffer(data, "<u4", n).astype(np.int64)
                np.maximum.at(out, at, np.frombuffer(data, np.uint8, n, 4 * n))
        return out


#: What a family tells: the states of a batch's entries, later changes of them, and, of a kept index, its levels (the rank in place of the block).
STATES, CHANGES, LEVEL = range(3)
_ROWS = "part long, block long, entries binary"
_TOLD = "block long, part long, kind int, data binary"


def _entries(data: bytes, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // (13 if narrow else 17)
    x = np.frombuffer(data, "<u8", n)
    y = np.frombuffer(data, "<u4", n, 8 * n).astype(_U) << _U(32) if narrow else np.frombuffer(data, "<u8", n, 8 * n)
    return x, y, np.frombuffer(data, np.uint8, n, len(data) - n)


def _packed(level: Level) -> bytes:
    names, batch = np.unique(level.batch, return_inverse=True)
    head = np.array([len(level.x), len(names)], "<i8")
    return b"".join(z.tobytes() for z in (head, names.astype("<i8"), level.x.astype("<u8"), level.y.astype("<u8"), batch.astype("<u4"), level.place.astype("<u4"), level.state))


def _unpacked(data: bytes) -> Level:
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    at, out = 16, []
    for kind, count in (("<i8", m), ("<u8", n), ("<u8", n), ("<u4", n), ("<u4", n), ("u1", n)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    names, x, y, batch, place, state = out
    return Level(x, y, state.copy(), names[batch], place)


def _families(narrow: bool, keep: bool):
    """The families of the parts of a task. Rows come by part: first the levels of a kept index, then batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, family, held, size = None, IndexFamily(), [], 0

        def rows() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "part", "kind", "data"])

        def ended() -> None:
            for batch, changes in family.changes.items():
                at, state = (np.concatenate(c) for c in zip(*changes, strict=True))
                held.append((batch, part, CHANGES, at.astype("<u4").tobytes() + state.tobytes()))
            if keep:
                held.extend((rank, part, LEVEL, _packed(level)) for rank, level in family.levels.items())

        for found in batches:
            for p, kind, block, data in zip(found["part"].to_pylist(), found["kind"].to_pylist(), found["block"].to_pylist(), found["entries"], strict=True):
                if p != part:
                    if part is not None:
                        ended()
                    part, family = p, IndexFamily()
                if kind == LEVEL:
                    family.levels[block] = _unpacked(data.as_py())
                else:
                    held.append((block, part, STATES, family.insert(block, *_entries(data.as_py(), narrow)).tobytes()))
                size += len(held[-1][3]) if held else 0
                if size > 4_000_000:
                    yield rows()
                    held, size = [], 0
        if part is not None:
            ended()
        if held:
            yield rows()

    return run


def _told(entries: DataFrame, tasks: int, narrow: bool, levels: DataFrame | None = None, keep: bool = False) -> DataFrame:
    own = entries.select("part", F.lit(STATES).alias("kind"), "block", "entries")
    if levels is not None:
        own = own.unionByName(levels.select("part", "kind", "block", F.col("data").alias("entries")))
    own = own.repartition(tasks, "part").sortWithinPartitions("part", F.desc("kind"), "block")
    return own.mapInArrow(trimmed(_families(narrow, keep)), _TOLD)


class _Block:
    """A block's texts and what is known of their suffixes."""

    def __init__(self, table: pa.Table, sampler: Sampler, parts: int):
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()]
        self.block = table["block"][0].as_py()
        self.sampler, self.parts = sampler, parts
        self.records: Records = sampler.records(self.texts)
        self.entries = Entries.from_pairs(self.records.gram, self.records.around, np.ones(len(self.records.gram), np.int64), parts)

    def decided(self, told: pa.Table) -> np.ndarray:
        return self.entries.answers(list(zip(*(told[c].to_pylist() for c in ("part", "kind", "data")), strict=True)))[self.entries.of]

    def windows(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, Entries]:
        """Of all windows sent: their records, starts, and entries. Of a suffix that repeats the first record sends."""
        sends = np.flatnonzero(code == FULL_SENDS)
        sends = sends[np.unique(self.entries.of[sends], return_index=True)[1]]
        chosen = np.sort(np.concatenate([sends, np.flatnonzero(code == OPEN)]))
        record, start, x, y = self.sampler.windows(self.texts, self.records, chosen)
        y = y >> _U(32) << _U(32)
        return record, start, Entries.from_pairs(x, y, np.where(code[record] == OPEN, 1, 2), self.parts)


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [low, high) as maximal spans."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, top = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate(([True], low[1:] > top[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(low)) - 1
    return low[new], top[last]


def _whole_runs(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The runs kept as they are, and each without the parts of characters at its ends."""
    runs = [text[e:s] for e, s in zip([0, *high.tolist()], [*low.tolist(), len(text)], strict=True)]
    return runs, [r.decode("utf-8", "ignore").encode() for r in runs]


class SuffixIndex:
    """Texts that are added in any number of steps, and which of their bytes repeat anywhere among all that were added.

    Each step is scanned against the levels that the steps before have left in the shared folder. ``parts``: of the index, fixed by the first
    step; name more if much is to follow. A step's ids and columns are as the first's.
    """

    def __init__(self, length: int = 200, gram: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), parts: int | None = None, keep: bool = True):
        self.length, self.gram, self.id_col, self.text_col, self.carry, self.parts, self.keep = length, gram, id_col, text_col, list(carry), parts, keep
        self.steps = 0
        self.texts: DataFrame | None = None
        self.told: DataFrame | None = None
        self.levels: DataFrame | None = None

    def add(self, docs: DataFrame) -> SuffixIndex:
        total = docs.select(F.sum(F.octet_length(F.col(self.text_col).cast("string")))).first()[0] or 0
        blocks = total // BLOCK + 1
        self.parts = self.parts or total // PART + 1
        # copies of a row are spread by where they come from
        at = F.pmod(F.xxhash64(F.lit("block"), F.col(self.id_col), F.col(self.text_col), F.spark_partition_id()), F.lit(blocks)) + (self.steps << 40)
        text = F.col(self.text_col).cast("string")
        slim = docs.select(F.col(self.id_col).alias("id"), text.alias("text"), *text_key(F.col(self.text_col)), at.alias("block"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(self.carry)))
        self.kinds = {"id": docs.schema[self.id_col].dataType} | {f"_c{i}": docs.schema[c].dataType for i, c in enumerate(self.carry)}
        if self.keep:
            slim = materialize(slim, "texts")
        sampler, parts = (self.length, self.gram), self.parts

        def first(table: pa.Table) -> pa.Table:
            b = _Block(table, Sampler(*sampler), parts)
            return b.entries.rows(b.block, narrow=False)

        told = _told(slim.groupBy("block").applyInArrow(trimmed_group(first), _ROWS), self._tasks(docs), False, self.levels, self.keep)
        if self.keep:
            told = materialize(told, "suffix-index")
            self.levels = told.where(F.col("kind") == LEVEL)
        told = told.where(F.col("kind") != LEVEL)
        self.texts = slim if self.texts is None else self.texts.unionByName(slim)
        self.told = told if self.told is None else self.told.unionByName(told)
        self.steps += 1
        return self

    def _tasks(self, docs: DataFrame) -> int:
        return max(partitions(docs.sparkSession), min(self.parts, 2000))

    def spans(self, with_text: bool = False) -> DataFrame:
        """A row for each row added: see ``repeated_spans``."""
        sampler, parts, n_carry = (self.length, self.gram), self.parts, len(self.carry)
        length = self.length
        by_block = self.texts.groupBy("block")
        names = ["id", *KEY, *(f"_c{i}" for i in range(n_carry))]

        def second(table: pa.Table, told: pa.Table) -> pa.Table:
            if not table.num_rows or not told.num_rows:
                return Entries.from_pairs(*(np.zeros(0, dtype=_U),) * 2, np.zeros(0, np.int64), parts).rows(0, narrow=True)
            b = _Block(table, Sampler(*sampler), parts)
            return b.windows(b.decided(told))[2].rows(b.block, narrow=True)

        def last(table: pa.Table, told: pa.Table) -> pa.Table:
            kept: list[str] = []
            sizes, removed, spans, digests = [], [], [], []
            if table.num_rows:
                b = _Block(table, Sampler(*sampler), parts)
                code = b.decided(told.filter(pa.compute.equal(told["of"], 0)))
                record, start, entries = b.windows(code)
                again = told.filter(pa.compute.equal(told["of"], 1))
                state = entries.answers(list(zip(*(again[c].to_pylist() for c in ("part", "kind", "data")), strict=True)))
                hit = (state[entries.of] & REPEATED > 0) & (code[record] == OPEN)
                full = code >= FULL
                text = np.concatenate([b.records.text[full], b.records.text[record[hit]]])
                low = np.concatenate([b.records.low[full], start[hit]])
                high = np.concatenate([b.records.high[full], start[hit]]) + length
                order = np.argsort(text, kind="stable")
                text, low, high = text[order], low[order], high[order]
                edges = np.searchsorted(text, np.arange(len(b.texts) + 1))
                for i, t in enumerate(b.texts):
                    lo, hi = _spans(low[edges[i] : edges[i + 1]], high[edges[i] : edges[i + 1]])
                    runs, whole = _whole_runs(t, lo, hi) if len(lo) else ([t], [t])
                    digest = hashlib.sha256()
                    for r in runs:
                        digest.update(r)
                    sizes.append(len(t))
                    removed.append(int((hi - lo).sum()))
                    spans.append(len(lo))
                    digests.append(digest.hexdigest())
                    if with_text:
                        kept.append(b"".join(whole).decode("utf-8", "ignore"))
            out = {"id": table["id"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            out |= {k: table[k] for k in names[1:]}
            if with_text:
                out["kept"] = pa.array(kept, pa.string())
            return pa.table(out)

        told = self.told.select("block", "part", "kind", "data")
        again = _told(by_block.cogroup(told.groupBy("block")).applyInArrow(trimmed_group(second), _ROWS), self._tasks(self.texts), True)
        both = told.withColumn("of", F.lit(0)).unionByName(again.withColumn("of", F.lit(1)))
        fields = [T.StructField("id", self.kinds["id"]), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
        fields += [T.StructField(k, self.texts.schema[k].dataType) for k in names[1:]] + [T.StructField("kept", T.StringType())] * with_text
        return by_block.cogroup(both.groupBy("block")).applyInArrow(trimmed_group(last), T.StructType(fields))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and the key of its text.

    Removed is each byte of a ``length``-byte string that also starts anywhere else in the table, the same text
    included, judged on the input. Matches never cross texts. A null text is empty; texts shorter than ``length``
    bytes lose nothing; long texts count whole; repeated rows repeat each other. An empty table gives an empty result. Other columns play no part.
    """
    found = SuffixIndex(length, gram, id_col, text_col, keep=False).add(docs).spans()
    return found.withColumnRenamed("id", id_col).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *KEY)


def without_repeats(docs: DataFrame, length: int = 200, gram: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text as ``repeated_spans`` leaves it, and all other columns, whatever they are called.

    A character of which a part is removed goes whole; the runs that stay are never joined to a new one. A null text becomes empty.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    found = SuffixIndex(length, gram, id_col, text_col, others, keep=False).add(docs).spans(with_text=True)
    place = {id_col: "id", text_col: "kept"} | {c: f"_c{i}" for i, c in enumerate(others)}
    return found.select(*(F.col(place[c]).alias(c) for c in docs.columns))
