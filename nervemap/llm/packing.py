"""Best-fit packing of token sequences: length patterns by non-negative least squares, residuals by best fit.

1. Texts are tokenised in the executors and cut into pieces of at most ``capacity`` tokens.
2. The histogram of piece lengths (``capacity`` numbers at most, whatever the corpus) goes to the driver.
   Lengths are grouped into bins; every pattern of up to ``parts`` pieces whose bins fill a sequence
   is enumerated; non-negative least squares fits how often to repeat each pattern; the counts are
   rounded down. A pattern is realised on exact lengths, the last piece being the longest that fits.
3. What is left over is packed best-fit decreasing, first into the slack of those sequences.
4. The plan is a list of (sequence layout, repeats), as long as there are lengths and patterns, not pieces. Each
   piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nervemap.runtime import materialize, ordered, trimmed

#: Bytes of text that are tokenised together; a longer text comes in several such parts.
TOGETHER = 3 << 20
#: Texts and characters that a tokenizer without word ends gets at once.
AT_ONCE, CHARS_AT_ONCE = 256, 400_000
#: A chunk of composed Latin letters and then marks: the vocabulary always parts the two, and the letters' case doesn't count.
_PLAIN = r"^(?P<stem>[a-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=?@\[-`{-~]*)$"
#: How a tokenizer file says that white space is dropped, case doesn't count, and nothing joins across letters and marks.
_DROPS = ["NFC", "Replace", "Lowercase"]
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NO_RANK = np.iinfo(np.int32).max


def _ragged(starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the runs ``pick`` one after another, and their sizes."""
    n = sizes[pick]
    return np.arange(int(n.sum())) + np.repeat(starts[pick] - (np.cumsum(n) - n), n), n


class PairMerges:
    """Byte-pair merges of many words at once: in every round each word merges its leftmost pair of least rank, as the model does."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made[order]
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]  # bytes that stand for themselves
        others = [c for c in range(256) if c not in set(plain)]
        name = {c: chr(c) for c in plain} | {c: chr(256 + i) for i, c in enumerate(others)}
        self.inner = np.array([vocab[name[c]] for c in range(256)], dtype=np.int64)
        self.last = np.array([vocab[name[c] + suffix] for c in range(256)], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NO_RANK)

    def of(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that lie one after another in ``data``, and how many each has. No word is empty."""
        symbol = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[data[ends]]
        found = np.zeros(len(sizes), dtype=np.int64)
        words = np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbol), _NO_RANK, dtype=np.int32)  # of a symbol and the next of its word
        rank[:-1] = self._ranks(symbol[:-1], symbol[1:])
        rank[ends] = _NO_RANK
        n = sizes.astype(np.int64)
        while len(words):
            starts = np.cumsum(n) - n
            least = np.minimum.reduceat(rank, starts)
            live = least < _NO_RANK
            if not live.all():
                at, _ = _ragged(starts, n, np.flatnonzero(~live))
                done.append((words[~live], n[~live], symbol[at]))
                found[words[~live]] = n[~live]
                at, _ = _ragged(starts, n, np.flatnonzero(live))
                symbol, rank, words, n, least = symbol[at], rank[at], words[live], n[live], least[live]
                starts = np.cumsum(n) - n
                if not len(words):
                    break
            best = np.flatnonzero(rank == np.repeat(least, n))
            owner = np.searchsorted(starts, best, side="right") - 1
            best = best[np.concatenate(([True], owner[1:] != owner[:-1]))]
            at = np.searchsorted(self.key, symbol[best] << 32 | symbol[best + 1])
            symbol[best] = self.made[at]
            rank[best] = rank[best + 1]
            keep = np.ones(len(symbol), dtype=bool)
            keep[best + 1] = False
            best = best - np.arange(len(best))  # each earlier word has lost one symbol
            symbol, rank, n = symbol[keep], rank[keep], n - 1
            first = np.cumsum(n) - n
            right = best[best < first + n - 1]
            rank[right] = self._ranks(symbol[right], symbol[right + 1])
            left = best[best > first] - 1
            rank[left] = self._ranks(symbol[left], symbol[left + 1])
        out = np.empty(int(found.sum()), dtype=np.uint32)
        starts = np.cumsum(found) - found
        for own, _, ids in done:
            out[_ragged(starts, found, own)[0]] = ids
        return out, found


class WordIds:
    """Ids of whole texts by a tokenizer file, without special tokens.

    Where the file drops white space, ignores case and parts letters from marks, texts are cut at ASCII white space and each
    distinct chunk of a part of the texts is looked at once: the merges of plain words are made for all of them together,
    and everything else goes through the library. Texts that may hold a special token, and all texts by any other file, go through the library whole.
    Nothing is kept between calls but the file's own tables.
    """

    _made: ClassVar[dict[str, WordIds]] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = None
        if self._by_words(spec):
            self.merges = PairMerges(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])

    @staticmethod
    def _by_words(spec: dict) -> bool:
        normal, parts, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
        steps = normal.get("normalizers", [])
        if [x.get("type") for x in steps] != _DROPS or (steps[1].get("pattern"), steps[1].get("content")) != ({"Regex": r"\s+"}, " "):
            return False
        cuts = parts.get("pretokenizers", [])
        if [x.get("type") for x in cuts] != ["Split", "ByteLevel"] or (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) != ({"Regex": _PARTS}, "Removed", True):
            return False
        if cuts[1].get("add_prefix_space") or cuts[1].get("use_regex"):
            return False
        if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return False
        return all("<|" in x["content"] for x in spec.get("added_tokens", []))

    @classmethod
    def at(cls, path: str) -> WordIds:
        """The one of this process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, by the library, and how many each has."""
        out, sizes, lo = [], [], 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and hi - lo < AT_ONCE and (hi == lo or chars + len(texts[hi]) <= CHARS_AT_ONCE):
                chars += len(texts[hi])
                hi += 1
            for x in self.model.encode_batch_fast(texts[lo:hi], add_special_tokens=False):
                ids = x.ids
                sizes.append(len(ids))
                out.append(np.array(ids, dtype=np.uint32))
            lo = hi
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array(sizes, dtype=np.int64)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct chunks one after another, and how many each has."""
        parts = pc.extract_regex(chunks, _PLAIN)
        plain = np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False))
        other = np.flatnonzero(parts.is_null().to_numpy(zero_copy_only=False))
        stems = pc.utf8_lower(pc.struct_field(parts, "stem").take(pa.array(plain))).dictionary_encode()
        marks = pc.struct_field(parts, "marks").take(pa.array(plain)).dictionary_encode()
        sizes = pc.binary_length(stems.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(stems.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint8)
        units = [self.merges.of(data, sizes), self._encoded(marks.dictionary.to_pylist()), self._encoded(chunks.take(pa.array(other)).to_pylist())]
        ids, n = (np.concatenate(x) for x in zip(*units, strict=True))
        # a chunk is two units: its stem and its marks, or itself and nothing
        unit = np.full((len(chunks), 2), len(n), dtype=np.int64)
        unit[plain, 0] = stems.indices.to_numpy(zero_copy_only=False)
        unit[plain, 1] = marks.indices.to_numpy(zero_copy_only=False) + len(stems.dictionary)
        unit[other, 0] = np.arange(len(other)) + len(stems.dictionary) + len(marks.dictionary)
        n = np.append(n, 0)
        at, sizes = _ragged(np.cumsum(n) - n, n, unit.ravel())
        return ids[at], sizes.reshape(-1, 2).sum(axis=1)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has. Nulls are empty."""
        texts = pc.fill_null(texts, "")
        if self.merges is None:
            return self._encoded(texts.to_pylist())
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            easy, hard = np.flatnonzero(~special), np.flatnonzero(special)
            (a, n), (b, m) = self.of(texts.take(pa.array(easy))), self._encoded(texts.take(pa.array(hard)).to_pylist())
            sizes = np.concatenate([n, m])
            place = np.empty(len(texts), dtype=np.int64)
            place[easy], place[hard] = np.arange(len(easy)), np.arange(len(hard)) + len(easy)
            at, sizes = _ragged(np.cumsum(sizes) - sizes, sizes, place)
            return np.concatenate([a, b])[at], sizes
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = split.flatten().dictionary_encode()
        edges = split.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        if not len(words.dictionary):
            return np.zeros(0, np.uint32), np.zeros(len(texts), dtype=np.int64)
        ids, n = self._chunks(words.dictionary)
        at, sizes = _ragged(np.cumsum(n) - n, n, words.indices.to_numpy(zero_copy_only=False))
        return ids[at], np.diff(np.concatenate(([0], np.cumsum(sizes)))[edges])


def _cut(text: str) -> list[str]:
    """A text in parts of about TOGETHER characters, cut at a space or line end."""
    out, lo = [], 0
    while len(text) - lo > TOGETHER:
        hi = max(text.rfind(" ", lo + 1, lo + TOGETHER), text.rfind("\n", lo + 1, lo + TOGETHER))
        if hi < 0:
            at = [x for x in (text.find(" ", lo + TOGETHER), text.find("\n", lo + TOGETHER)) if x >= 0]
            if not at:
                break
            hi = min(at)
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TOGETHER bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOGETHER, side="right")))
        yield lo, hi
        lo = hi


def text_ids(words: WordIds, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, ids and sizes of ranges of texts, in order."""
    for lo, hi in _groups(texts):
        part = texts.slice(lo, hi - lo)
        if hi - lo == 1 and words.merges is not None and part[0].is_valid and len(text := part[0].as_py()) > TOGETHER and "<|" not in text:
            own = [words.of(pa.array([x], pa.string()))[0] for x in _cut(text)]
            yield lo, np.concatenate(own), np.array([sum(map(len, own))])
        else:
            yield lo, *words.of(part)


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = WordIds.at(path)
        for batch in batches:
            rows = []
            for first, ids, sizes in text_ids(words, batch["text"]):
                whole, at = ids.astype("<u4", copy=False).tobytes(), 0
                for i, n in enumerate(sizes.tolist(), first):
                    x = whole[4 * at : 4 * (at + n)] + end
                    at += n
                    for k, lo in enumerate(range(0, n + 1, capacity)):
                        part = x[4 * lo : 4 * (lo + capacity)]
                        rows.append((i, k, lo, len(part) // 4, zlib.crc32(part)))
            at, *cols = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), *arrays], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, piece, start, length and ids_crc32 of each piece of each row's text (null: empty) and its end id."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(trimmed(_pieces(tokenizer, capacity, end_id)), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def nnls(patterns: np.ndarray, weight: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |A @ x - target|, by active sets; at most as many non-zeros as rows.

    A pattern's column of A adds ``weight[b]`` in row b for each b in its row of ``patterns``; entries of len(weight) add nothing.
    """
    m, n = len(weight), len(patterns)
    padded = np.append(weight, 0.0)

    def columns(at: np.ndarray) -> np.ndarray:
        out = np.zeros((m + 1, len(at)))
        np.add.at(out, (patterns[at], np.arange(len(at))[:, None]), padded[patterns[at]])
        return out[:m]

    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    scale = 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0)))
    rest = target.astype(np.float64)
    for _ in range(rounds):
        gain = (padded * np.append(rest, 0.0))[patterns].sum(axis=1)
        gain[free] = -np.inf
        j = int(np.argmax(gain))
        if not gain[j] > scale:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            a = columns(at)
            gram = a.T @ a
            best = np.zeros(n)
            best[at] = np.linalg.solve(gram + 1e-10 * np.trace(gram) / len(at) * np.eye(len(at)), a.T @ target)
            low = at[best[at] <= 1e-12]
            if not len(low):
                x = best
                rest = target - a @ x[at]
                break
            drop = x[low] - best[low]
            step = float(np.min(np.where(drop > 0, x[low] / np.where(drop > 0, drop, 1), 0.0)))
            x = x + step * (best - x)
            gone = free & (x <= 1e-12)
            gone[low[np.argmin(x[low])]] = True
            x[gone] = 0.0
            free &= ~gone
            if not free.any():
                rest = target.astype(np.float64)
                break
    return x


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """Every way to fill ``bins`` with up to ``parts`` pieces, larger first."""
    out: list[tuple[int, ...]] = []

    def add(left: int, most: int, taken: tuple[int, ...]) -> None:
        if not left:
            out.append(taken)
        elif len(taken) < parts:
            for x in range(min(left, most), 0, -1):
                if x * (parts - len(taken)) < left:
                    break
                add(left - x, x, (*taken, x))

    add(bins, bins, ())
    return out


@dataclass
class Layout:
    """``repeats`` sequences that hold, from offset 0, runs of (length, how many)."""

    runs: list[tuple[int, int]]
    repeats: int


#: Shares of the fitted repeats that are tried, in this order; smaller ones leave more pieces, and more short ones, to best fit.
SHARES = (1.0, 0.95, 0.9, 0.8, 0.65, 0.5, 0.3, 0.15, 0.05)


def plan(histogram: dict[int, int], capacity: int, bins: int = 128, parts: int = 4) -> list[Layout]:
    """Layouts that hold every piece of the histogram exactly once.

    The fitted repeats are rounded down, and of a few shares of them the one counts that needs the fewest sequences in all; as soon as
    one needs no more than the tokens would fill without a gap, the others aren't tried. The work depends on the
    lengths that occur and the patterns, not on the pieces.
    """
    if any(x < 1 or x > capacity for x in histogram):
        raise ValueError("a length is outside 1..capacity")
    pieces = np.zeros(capacity + 1, dtype=np.int64)
    for x, k in histogram.items():
        pieces[x] += k
    width = -(-capacity // bins)
    bins = -(-capacity // width)
    in_bin = np.zeros(bins + 1)
    np.add.at(in_bin, -(-np.arange(capacity + 1) // width), pieces)
    every = patterns(bins, parts)
    at_bins = np.array([[*(b - 1 for b in p), *[bins] * (parts - len(p))] for p in every], dtype=np.int64)
    weight = np.sqrt(np.arange(1, bins + 1) / bins)  # a long piece left over costs more room than a short one
    fit = nnls(at_bins, weight, in_bin[1:] * weight)
    order = sorted(np.flatnonzero(fit >= 1), key=lambda j: (-max(every[j]), len(every[j]), every[j]))
    least = -(-int((np.arange(capacity + 1) * pieces).sum()) // capacity)
    best, fewest = [], None
    for share in SHARES:
        repeats = [(every[j], int(fit[j] * share + 1e-6)) for j in order]
        made = _realised(repeats, pieces.copy(), capacity, width)
        size = sum(x.repeats for x in made)
        if fewest is None or size < fewest:
            best, fewest = made, size
        if fewest <= least:
            break
    return best


def _realised(repeats: list[tuple[tuple[int, ...], int]], left: np.ndarray, capacity: int, width: int) -> list[Layout]:
    """The patterns on exact lengths, each pattern's last piece being the longest that fits, then what is left by best fit, longest first."""
    open_: list[list[Layout]] = [[] for _ in range(capacity + 1)]  # by slack

    def longest(most: int, least: int = 1) -> int:
        at = np.flatnonzero(left[least : most + 1])
        return least + int(at[-1]) if len(at) else 0

    for pattern, count in repeats:
        while count > 0:
            taken: dict[int, int] = {}
            room, order = capacity, []
            for k, b in enumerate(pattern):
                last = k == len(pattern) - 1
                most, least = (room, 1) if last else (min(b * width, room), (b - 1) * width + 1)
                x = 0
                while most >= least and (x := longest(most, least)) and left[x] <= taken.get(x, 0):
                    most = x - 1
                    x = 0
                if not x:
                    break
                taken[x] = taken.get(x, 0) + 1
                room -= x
                order.append(x)
            if len(order) < len(pattern):
                break
            n = min([count, *(int(left[x]) // k for x, k in taken.items())])
            for x, k in taken.items():
                left[x] -= n * k
            open_[room].append(Layout([(x, k) for x, k in sorted(taken.items(), reverse=True)], n))
            count -= n
    some = np.array([len(x) for x in open_])
    for x in range(capacity, 0, -1):
        n = int(left[x])
        while n:
            fits = np.flatnonzero(some[x:])
            if len(fits):
                slack = x + int(fits[0])
                old = open_[slack].pop()
                some[slack] -= 1
                put = min(n, old.repeats)
                if put < old.repeats:
                    open_[slack].append(Layout(old.runs, old.repeats - put))
                    some[slack] += 1
                runs = [*old.runs[:-1], (x, old.runs[-1][1] + 1)] if old.runs and old.runs[-1][0] == x else [*old.runs, (x, 1)]
                open_[slack - x].append(Layout(runs, put))
                some[slack - x] += 1
                n -= put
            else:
                each = min(capacity // x, n)
                whole = n // each
                open_[capacity - each * x].append(Layout([(x, each)], whole))
                some[capacity - each * x] += 1
                n -= whole * each
    return [x for group in open_ for x in group]


def _placing(layouts: list[Layout], histogram: dict[int, int], before: list[int], capacity: int):
    """Gives pieces, sorted by length, their sequence and offset, from their place in that order."""
    first = np.zeros(capacity + 2, dtype=np.int64)
    for x, k in histogram.items():
        first[x + 1] = k
    first = np.cumsum(first)
    used = first.copy()
    rows, base = [], 0
    for layout in layouts:
        offset = 0
        for x, k in layout.runs:
            rows.append((int(used[x]), base, k, offset, x))
            used[x] += k * layout.repeats
            offset += x * k
        base += layout.repeats
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    starts = np.array(before, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = starts[batch["_part"].to_numpy(zero_copy_only=False)] + batch["_pos"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(table[:, 0], row, side="right") - 1
            low, base, each, offset, x = table[at].T
            k, within = np.divmod(row - low, each)
            out = batch.drop_columns(["_part", "_pos"])
            yield out.append_column("sequence_id", pa.array(base + k)).append_column("offset", pa.array(offset + within * x))

    return run, base


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, bins: int = 128, parts: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id alone. Only texts of more than ``capacity``
    ids are cut. Repeated rows are packed like any others. An empty table gives an empty result. Other
    columns play no part. Sequence numbers run from 0 without gaps.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed, before = ordered(pieces, "length", "id", "piece", "ids_crc32", name="packing")
    run, _ = _placing(plan(histogram, capacity, bins, parts), histogram, before, capacity)
    out = placed.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
