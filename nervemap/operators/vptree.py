"""A vantage-point tree over vectors, which tasks build, search for many points at once and keep as rows of a node table (``metric_index``)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from nervemap.functions.vectors import measure_name, pairwise


def metric(measure: str, d: np.ndarray) -> np.ndarray:
    """Distances as ones that keep the triangle inequality: of cosine distances those of the lines' unit vectors, sqrt(2 d); others do so already."""
    return np.sqrt(2 * d) if measure == "cosine" else d


def slack(measure: str, *sizes: np.ndarray | float) -> np.ndarray | float:
    """How far sums of metric distances of such sizes can be off, with room to spare; a root of a rounding error, where there is one, is far larger."""
    return 1e-6 if measure == "cosine" else 1e-9 * sum(sizes)


@dataclass
class _Node:
    rows: np.ndarray | None = None
    vantage: int = -1
    radius: float = 0.0
    near: _Node | None = None
    far: _Node | None = None
    leaf: int = -1


class Nearest:
    """The k best (distance, id) met so far; the radius is that of the worst, or 0 while there is none."""

    def __init__(self, k: int):
        self.k, self._heap = k, []

    def offer(self, distance: float, id_: int) -> None:
        item = (-distance, -id_)
        if len(self._heap) < self.k:
            heapq.heappush(self._heap, item)
        elif item > self._heap[0]:
            heapq.heapreplace(self._heap, item)

    @property
    def full(self) -> bool:
        return len(self._heap) >= self.k

    @property
    def radius(self) -> float:
        return -self._heap[0][0] if self._heap else 0.0

    def sorted(self) -> list[tuple[int, float]]:
        return [(-i, -d) for d, i in sorted(self._heap, reverse=True)]


@dataclass
class VPTree:
    """Splits at the median distance from the candidate whose distances to a sample vary most; zero medians and small sets are leaves.

    Without candidates the first point of a set is the one, so that the tree follows from the order of the points alone.
    """

    ids: np.ndarray
    vectors: np.ndarray
    measure: str = "euclidean"
    leaf_size: int = 10
    candidates: int = 10
    samples: int = 100
    seed: int = 0
    leaves: int = field(init=False, default=0)

    def __post_init__(self):
        self.measure = measure_name(self.measure)
        self.ids, self.vectors = np.asarray(self.ids, dtype=np.int64), np.atleast_2d(np.asarray(self.vectors, dtype=np.float64))
        self._draw = np.random.default_rng(self.seed)
        self.root = self._build(np.arange(len(self.ids))) if len(self.ids) else None

    def _leaf(self, rows: np.ndarray) -> _Node:
        self.leaves += 1
        return _Node(rows=rows, leaf=self.leaves - 1)

    def _build(self, rows: np.ndarray) -> _Node:
        if len(rows) <= self.leaf_size:
            return self._leaf(rows)
        vantage = int(rows[0])
        if self.candidates:
            tried = self._draw.choice(rows, min(self.candidates, len(rows)), replace=False)
            sample = self._draw.choice(rows, min(self.samples, len(rows)), replace=False)
            vantage = int(tried[pairwise(self.measure, self.vectors[tried], self.vectors[sample]).var(axis=1).argmax()])
        d = pairwise(self.measure, self.vectors[[vantage]], self.vectors[rows])[0]
        median = float(np.median(d))
        if median == 0 or not (d < median).any():
            return self._leaf(rows)
        node = _Node(vantage=vantage, radius=median)
        node.near, node.far = self._build(rows[d < median]), self._build(rows[d >= median])
        return node

    def query(self, v, k: int) -> list[tuple[int, float]]:
        """The k nearest (id, distance), the point itself included if it is in the tree; ties go to the smaller id."""
        v, found = np.asarray(v, dtype=np.float64)[None, :], Nearest(k)

        def visit(node: _Node) -> None:
            if node.rows is not None:
                for i, d in zip(self.ids[node.rows], pairwise(self.measure, v, self.vectors[node.rows])[0], strict=True):
                    found.offer(float(d), int(i))
                return
            d = float(pairwise(self.measure, v, self.vectors[[node.vantage]])[0, 0])
            first, second = (node.near, node.far) if d < node.radius else (node.far, node.near)
            visit(first)
            reach = d + found.radius >= node.radius if d < node.radius else d - found.radius <= node.radius
            # the rule of reaching needs the triangle inequality, which the cosine measure lacks
            if not found.full or reach or self.measure == "cosine":
                visit(second)

        if self.root is not None:
            visit(self.root)
        return found.sorted()

    def leaf_of(self, v) -> int:
        """The leaf that a descent without turning back ends in."""
        node, v = self.root, np.asarray(v, dtype=np.float64)[None, :]
        if node is None:
            raise KeyError("the tree is empty")
        while node.rows is None:
            node = node.near if float(pairwise(self.measure, v, self.vectors[[node.vantage]])[0, 0]) < node.radius else node.far
        return node.leaf


    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """``leaf_of`` of every row."""
        if self.root is None:
            raise KeyError("the tree is empty")
        vectors = np.atleast_2d(np.asarray(vectors, dtype=np.float64))
        out = np.empty(len(vectors), dtype=np.int64)
        open_ = [(self.root, np.arange(len(vectors)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            if node.rows is not None:
                out[at] = node.leaf
                continue
            near = pairwise(self.measure, vectors[at], self.vectors[[node.vantage]])[:, 0] < node.radius
            open_ += [(node.near, at[near]), (node.far, at[~near])]
        return out

    def bounds(self, vectors: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, bound) for each leaf that may hold a point within ``reach`` (metric) of a row's vector: no point of it is nearer than ``bound``.

        Every point that ``leaves_of`` sends to a leaf counts, whether the tree was built from it or not.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_ = [(self.root, np.arange(len(vectors)), np.zeros(len(vectors)))] if self.root is not None and len(vectors) else []
        while open_:
            node, at, low = open_.pop()
            if not len(at):
                continue
            if node.rows is not None:
                out.append((at, np.full(len(at), node.leaf), low))
                continue
            d = metric(self.measure, pairwise(self.measure, vectors[at], self.vectors[[node.vantage]])[:, 0])
            cut = float(metric(self.measure, np.float64(node.radius)))
            room = slack(self.measure, d, cut)
            for child, least in ((node.near, d - cut - room), (node.far, cut - d - room)):
                new = np.fmax(low, least)  # a distance that is no number bounds nothing
                ok = new <= reach[at]
                open_.append((child, at[ok], new[ok]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def nearest_many(self, vectors: np.ndarray, k: int, reach: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row, id, distance) of up to k nearest points of the tree within ``reach`` (metric) of each row, ties by id, and how many distances that took.

        ``skip``: an id for each row that isn't its neighbour. A row goes to the nearer side first, and to the other only if something there can be
        nearer than its k-th so far; all rows that stand before a node go on together.
        """
        n, compared = len(vectors), 0
        ids = np.full((n, k), np.iinfo(np.int64).max)
        best = np.full((n, k), np.inf)
        reach = np.array(reach, dtype=np.float64)

        def visit(node: _Node, at: np.ndarray) -> None:
            nonlocal compared
            if not len(at):
                return
            if node.rows is not None:
                d = pairwise(self.measure, vectors[at], self.vectors[node.rows])
                if np.isnan(d).any():
                    raise ValueError("a distance is not a number of 0 or more")
                compared += d.size
                own = np.broadcast_to(self.ids[node.rows], d.shape)
                if skip is not None:
                    d = np.where(own == skip[at][:, None], np.inf, d)
                d, own = np.concatenate([best[at], d], axis=1), np.concatenate([ids[at], own], axis=1)
                order = np.lexsort((own, d), axis=1)[:, :k]
                best[at], ids[at] = np.take_along_axis(d, order, 1), np.take_along_axis(own, order, 1)
                reach[at] = np.minimum(reach[at], metric(self.measure, best[at, -1]))
                return
            d = metric(self.measure, pairwise(self.measure, vectors[at], self.vectors[[node.vantage]])[:, 0])
            compared += len(at)
            cut = float(metric(self.measure, np.float64(node.radius)))
            room = slack(self.measure, d, cut)
            near = d < cut
            visit(node.near, at[near])
            visit(node.far, at[~near])
            visit(node.far, at[near & ~(cut - d - room > reach[at])])
            visit(node.near, at[~near & ~(d - cut - room > reach[at])])

        if self.root is not None and n:
            visit(self.root, np.arange(n))
        row, place = np.nonzero(np.isfinite(best))
        return row, ids[row, place], best[row, place], compared

    def nodes(self) -> list[dict]:
        """The tree as rows, the root first: ``node``, ``vantage`` and ``radius`` of a branch with its children ``near`` and ``far``, ``leaf`` of a leaf."""
        out: list[dict] = []

        def add(node: _Node) -> int:
            row = {"node": len(out), "vantage": None, "radius": None, "near": None, "far": None, "leaf": None}
            out.append(row)
            if node.rows is not None:
                row["leaf"] = node.leaf
            else:
                row |= {"vantage": self.vectors[node.vantage].tolist(), "radius": node.radius}
                row["near"], row["far"] = add(node.near), add(node.far)
            return row["node"]

        if self.root is not None:
            add(self.root)
        return out

    @staticmethod
    def of_nodes(rows: list[dict], measure: str) -> VPTree:
        """The tree of such rows, without its points: it names leaves and bounds."""
        tree = VPTree([], np.zeros((0, 0)), measure)
        rows = sorted(rows, key=lambda r: r["node"])
        vantages = [r["vantage"] for r in rows if r["leaf"] is None]
        tree.vectors = np.array(vantages, dtype=np.float64) if vantages else np.zeros((0, 0))
        made = [_Node(rows=np.zeros(0, np.int64), leaf=r["leaf"]) if r["leaf"] is not None else _Node(radius=r["radius"]) for r in rows]
        at = 0
        for r, node in zip(rows, made, strict=True):
            if r["leaf"] is None:
                node.vantage, at = at, at + 1
                node.near, node.far = made[r["near"]], made[r["far"]]
        tree.root, tree.leaves = (made[0] if made else None), sum(r["leaf"] is not None for r in rows)
        return tree


@dataclass
class TopTrees:
    """A tree for each cell; leaves are numbered over all of them."""

    trees: dict[int, VPTree]

    def __post_init__(self):
        self._first, n = {}, 0
        for cell in sorted(self.trees):
            self._first[cell] = n
            n += self.trees[cell].leaves
        self.num_indices = n

    def is_defined_at(self, cell: int) -> bool:
        return cell in self.trees and self.trees[cell].root is not None

    def get(self, cell: int, v) -> int | None:
        return self._first[cell] + self.trees[cell].leaf_of(v) if self.is_defined_at(cell) else None

    def leaves(self, cell: int, vectors: np.ndarray) -> np.ndarray:
        return self._first[cell] + self.trees[cell].leaves_of(vectors)

    def get_or_else(self, cell: int, v, default: int) -> int:
        found = self.get(cell, v)
        return default if found is None else found

    def __call__(self, cell: int, v) -> int:
        found = self.get(cell, v)
        if found is None:
            raise KeyError(f"no tree for cell {cell}")
        return found


@dataclass(frozen=True)
class LeafPartitioner:
    """A partition for each leaf."""

    num_partitions: int

    def partition(self, key: int) -> int:
        if not isinstance(key, int) or not 0 <= key < self.num_partitions:
            raise ValueError(f"{key} is no leaf")
        return key
