"""Hidden Markov chains over symbols: exact likelihoods and Baum-Welch counts of many sequences at once.

Sequences are cut into chunks. Each chunk's product of scaled transition and emission matrices is made for all chunks together;
the forward and backward messages are then handed from chunk to chunk, so a sequence of any length costs memory for
its own symbols only, and nothing is cut off at a chunk's edge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 64
#: Steps between rescalings of a product.
RESCALE = 8


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: float = 0.0

    @staticmethod
    def zeros(states: int, symbols: int) -> Counts:
        return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)))


class Chunks:
    """Symbols of sequences (each of one symbol at least) as chunks, longest first."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        per = -(-sizes // CHUNK)
        sequence = np.repeat(np.arange(len(sizes)), per)
        ordinal = np.arange(len(sequence)) - np.repeat(np.cumsum(per) - per, per)
        size = np.minimum(CHUNK, sizes[sequence] - ordinal * CHUNK)
        low = (np.cumsum(sizes) - sizes)[sequence] + ordinal * CHUNK
        order = np.argsort(-size, kind="stable")
        self.size, self.low, self.first = size[order], low[order], ordinal[order] == 0
        self.active = [int(np.count_nonzero(self.size > t)) for t in range(CHUNK)]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        longest = np.argsort(-per, kind="stable")  # sequences by chunks, most first
        begin = (np.cumsum(per) - per)[longest]
        #: Of the j-th chunks of sequences: the sequences, in the order of ``longest``, and the chunks.
        self.rounds = [place[begin[:m] + j] for j in range(int(per.max(initial=0))) for m in [int(np.count_nonzero(per > j))]]
        self.longest = longest
        self.symbols = symbols

    def at(self, t: int) -> np.ndarray:
        return self.symbols[self.low[: self.active[t]] + t]


class HiddenMarkov:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.by_symbol = np.ascontiguousarray(emit.T)

    @staticmethod
    def initial(states: int, frequency: np.ndarray, seed: int, stay: float = 0.9) -> HiddenMarkov:
        """States that differ at random from the symbols' frequencies."""
        draw = np.random.default_rng(seed)
        emit = (frequency + 1e-9)[None, :] * np.exp(draw.normal(0.0, 1.0, (states, len(frequency))))
        move = np.full((states, states), (1 - stay) / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, stay if states > 1 else 1.0)
        return HiddenMarkov(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    @staticmethod
    def fitted(counts: Counts, prior: float = 0.01) -> HiddenMarkov:
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        return HiddenMarkov(norm(counts.start + prior), norm(counts.move + prior), norm(counts.emit + prior))

    def _products(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.start)
        product = np.where(chunks.first[:, None, None], self.start[None, None, :], self.move[None, :, :]) * self.by_symbol[chunks.at(0)][:, None, :]
        logs = np.zeros(len(product))
        for t in range(1, CHUNK):
            n = chunks.active[t]
            if not n:
                break
            product[:n] = (product[:n].reshape(n * k, k) @ self.move).reshape(n, k, k) * self.by_symbol[chunks.at(t)][:, None, :]
            if t % RESCALE == 0:
                top = product[:n].max(axis=(1, 2))
                product[:n] /= top[:, None, None]
                logs[:n] += np.log(top)
        return product, logs

    def _forward(self, chunks: Chunks, product: np.ndarray, logs: np.ndarray, sequences: int) -> tuple[np.ndarray, np.ndarray]:
        """What enters each chunk, and the log-likelihood of each sequence."""
        k = len(self.start)
        enters = np.empty((len(product), k))
        state, total = np.full((sequences, k), 1 / k), np.zeros(sequences)
        for at in chunks.rounds:
            m = len(at)
            enters[at] = state[:m]
            out = np.einsum("nk,nkl->nl", state[:m], product[at])
            mass = out.sum(axis=1)
            state[:m] = out / mass[:, None]
            total[:m] += np.log(mass) + logs[at]
        result = np.empty(sequences)
        result[chunks.longest] = total
        return enters, result

    def log_likelihood(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.zeros(0)
        chunks = Chunks(symbols, sizes)
        return self._forward(chunks, *self._products(chunks), len(sizes))[1]

    def expect(self, symbols: np.ndarray, sizes: np.ndarray, into: Counts) -> None:
        """Add the expected counts of the sequences."""
        if not len(sizes):
            return
        k = len(self.start)
        chunks = Chunks(symbols, sizes)
        product, logs = self._products(chunks)
        enters, likelihood = self._forward(chunks, product, logs, len(sizes))
        leaves = np.ones((len(product), k))
        state = np.ones((len(sizes), k))
        for at in reversed(chunks.rounds):
            m = len(at)
            leaves[at] = state[:m]
            back = np.einsum("nkl,nl->nk", product[at], state[:m])
            state[:m] = back / back.max(axis=1, keepdims=True)
        here = np.where(chunks.first[:, None], self.start[None, :], enters @ self.move) * self.by_symbol[chunks.at(0)]
        ahead = [here / here.sum(axis=1, keepdims=True)]
        for t in range(1, CHUNK):
            n = chunks.active[t]
            if not n:
                break
            here = (ahead[-1][:n] @ self.move) * self.by_symbol[chunks.at(t)]
            ahead.append(here / here.sum(axis=1, keepdims=True))
        behind = leaves.copy()
        for t in range(len(ahead) - 1, -1, -1):
            n = chunks.active[t]
            seen = chunks.at(t)
            both = ahead[t] * behind[:n]
            both /= both.sum(axis=1, keepdims=True)
            for s in range(k):
                into.emit[s] += np.bincount(seen, weights=both[:, s], minlength=into.emit.shape[1])
            tail = self.by_symbol[seen] * behind[:n]
            before = ahead[t - 1][:n] if t else enters
            inner = slice(None) if t else ~chunks.first
            if not t:
                into.start += both[chunks.first].sum(axis=0)
            b, a = before[inner], tail[inner]
            mass = np.einsum("nk,nk->n", b @ self.move, a)
            into.move += ((b / mass[:, None]).T @ a) * self.move
            back = tail @ self.move.T
            behind[:n] = back / back.max(axis=1, keepdims=True)
        into.log_likelihood += float(likelihood.sum())
