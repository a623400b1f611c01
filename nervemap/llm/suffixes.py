"""Sampled suffixes of byte texts: which positions are indexed, and by what."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
#: Bytes looked at together; longer texts are cut into overlapping pieces, so memory doesn't grow with a text.
STEP = 1 << 19
_INDEX_BITS = 24


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any substring of a buffer: polynomials modulo 2**64 over random byte values, made position-free."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.values = draw.integers(0, 2**64, 256, dtype=_U, endpoint=False)
        base = int(draw.integers(0, 2**62)) * 4 + 3
        size = STEP * 3
        self.up, self.down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


@dataclass
class Records:
    """Sampled suffixes of some texts, in text order. Those of one text whose windows start at low..high share a sample.

    gram: hash of the ``gram`` bytes from the sample on. around: hash of all bytes of all those windows, and where the
    sample is among them. Equal grams are necessary for two windows to be equal; equal arounds make all of them so.
    """

    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    around: np.ndarray


class Sampler:
    """Positions of texts of which every window of ``length`` bytes has one, chosen by the window's own bytes alone."""

    def __init__(self, length: int = 200, gram: int = 100):
        if not 0 < gram <= length:
            raise ValueError("gram must be within length")
        self.length, self.gram = length, gram
        self.first, self.second = Rolling(11), Rolling(23)

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
        """Buffers of whole pieces; of each (text, its first byte in the text, its bytes)."""
        held: list[tuple[int, int, int]] = []
        data: list[bytes] = []
        size = 0
        for i, t in enumerate(texts):
            for lo in range(0, max(1, len(t) - self.length + 1), STEP):
                part = t[lo : lo + STEP + self.length - 1]
                if len(part) < self.length:
                    continue
                if size and size + len(part) > STEP * 2:
                    yield held, b"".join(data)
                    held, data, size = [], [], 0
                held.append((i, lo, len(part)))
                data.append(part)
                size += len(part)
        if held:
            yield held, b"".join(data)

    def records(self, texts: list[bytes]) -> Records:
        found: list[list[np.ndarray]] = []
        for held, data in self.pieces(texts):
            x = np.frombuffer(data, dtype=np.uint8)
            sums = self.first.sums(x)
            at = np.arange(len(x) - self.gram + 1)
            grams = self.first.of(sums, at, at + self.gram)
            packed = (grams >> _U(_INDEX_BITS) << _U(_INDEX_BITS)) | at.astype(_U)
            sample = (_sliding_min(packed, self.length - self.gram + 1) & _U((1 << _INDEX_BITS) - 1)).astype(np.int64)
            sizes = np.array([n for _, _, n in held])
            starts = np.cumsum(sizes) - sizes
            windows = sizes - self.length + 1
            piece = np.repeat(np.arange(len(held)), windows)
            p = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[piece]
            m = sample[p]
            first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            last = np.concatenate((first[1:], [len(m)])) - 1
            low, high, owner = p[first], p[last], piece[first]
            around = self.first.of(sums, low, high + self.length)
            around = _mixed(around ^ _mixed(((high - low) << 32 | (m[first] - low)).astype(_U)))
            shift = np.array([lo for _, lo, _ in held]) - starts
            found.append([np.array([i for i, _, _ in held])[owner], low + shift[owner], high + shift[owner], grams[m[first]], around])
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return Records(none, none, none, none.astype(_U), none.astype(_U))
        return Records(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def windows(self, texts: list[bytes], records: Records, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of the chosen records: index of the record, start in the text, and two independent hashes."""
        out: list[list[np.ndarray]] = []
        for i in np.unique(records.text[chosen]):
            own = chosen[records.text[chosen] == i]
            for lo in range(0, max(1, len(texts[i]) - self.length + 1), STEP):
                here = own[(records.low[own] >= lo) & (records.low[own] < lo + STEP)]
                if not len(here):
                    continue
                x = np.frombuffer(texts[i][lo : lo + STEP + self.length - 1], dtype=np.uint8)
                n = records.high[here] - records.low[here] + 1
                p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(records.low[here] - lo, n)
                hashes = [r.of(r.sums(x), p, p + self.length) for r in (self.first, self.second)]
                out.append([np.repeat(here, n), p + lo, *map(_mixed, hashes)])
        if not out:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.astype(_U), none.astype(_U)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
