"""Exact top-k inner-product search over an impact-ordered index, a score at a time.

Vectors are cut to integers, which are the quantised impacts. Rows are dealt into blocks, and each block is written as an index: posting
segments (dimension, impact, members) of the rows that have the same impact in a dimension, and the vectors themselves. A query
goes through a block's segments by descending size of what they add to a score, |weight * impact|. What a row can still gain or lose is
bounded by the postings of it that are left, each of at most the size of the next segment. The query stops only when these
bounds prove that few rows can be among its k best; those are scored again, exactly, from their vectors. If that is never
proved, all segments are scored.

Every query has to meet every row, so blocks of queries meet blocks of the index: a pair takes a task seconds and one block of each to
read, and yields k rows a query at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nervemap.runtime import materialize

#: Rows of a block of the index, and queries of a block.
CANDIDATES, QUERIES = 65_536, 512
#: Impacts that are told apart in a block; if its values spread wider, neighbouring ones share a segment.
IMPACTS = 1024
#: Possible members a query, as multiple of k, that are few enough to be scored one by one.
FEW = 64
#: Postings of consecutive segments that are added up at once, about.
AT_ONCE = 1 << 18
#: The proof is tried each time the next segment is so much smaller than at the last try.
TRY = 0.6
_NARROW = (np.int16, np.int32, np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    rows = column.combine_chunks()
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


@dataclass
class Index:
    """Posting segments of a block. Segment s has the rows ``members[cuts[s]:cuts[s + 1]]``, whose component ``dim[s]`` is within ``half`` of ``impact[s]``. Rows that are ``nameless`` have no id and come after all others."""

    ids: np.ndarray
    nameless: np.ndarray
    rows: np.ndarray
    vectors: np.ndarray
    dim: np.ndarray
    impact: np.ndarray
    cuts: np.ndarray
    members: np.ndarray
    half: int

    @staticmethod
    def of(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, nameless: np.ndarray | None = None) -> Index:
        nameless = np.zeros(len(ids), bool) if nameless is None else nameless
        low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
        step = max(1, -(-(high - low + 1) // IMPACTS))
        level = (vectors - low) // step
        levels = int(level.max(initial=0)) + 1
        row, dim = np.nonzero(vectors)  # a component of zero adds nothing
        key = dim * levels + level[row, dim]
        order = np.argsort(key, kind="stable")
        key, members = key[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        of = key[first]
        return Index(ids, nameless, rows, vectors, of // levels, low + of % levels * step + step // 2, np.append(first, len(key)), members, step // 2)

    def packed(self) -> dict[str, bytes | int]:
        """As the written index has it: numbers in few bytes."""
        most = int(np.abs(self.vectors).max(initial=0))
        kind = next(i for i, t in enumerate(_NARROW) if most <= np.iinfo(t).max)
        place = "<u2" if len(self.ids) <= 1 << 16 else "<u4"
        parts = {"ids": self.ids, "nameless": self.nameless.astype(np.uint8), "rows": self.rows, "vectors": self.vectors.astype(_NARROW[kind]), "dim": self.dim.astype(np.int64), "impact": self.impact.astype(np.int64), "cuts": self.cuts.astype(np.int64), "members": self.members.astype(place)}
        return {k: x.tobytes() for k, x in parts.items()} | {"kind": kind, "half": self.half}

    @staticmethod
    def unpacked(row: dict) -> Index:
        ids, rows, dim, impact, cuts = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "dim", "impact", "cuts"))
        vectors = np.frombuffer(row["vectors"], _NARROW[row["kind"]]).reshape(len(ids), -1)
        members = np.frombuffer(row["members"], "<u2" if len(ids) <= 1 << 16 else "<u4").astype(np.intp)
        return Index(ids, np.frombuffer(row["nameless"], np.uint8).astype(bool), rows, vectors, dim, impact, cuts, members, row["half"])


@dataclass
class Found:
    """Of one query in one block: places and exact scores of its best, and how many postings and rows were scored for them."""

    at: np.ndarray
    score: np.ndarray
    postings: int
    rescored: int
    proved: bool


class Searcher:
    """Answers queries from one block's index."""

    def __init__(self, index: Index, k: int):
        self.index, self.k = index, k
        self.segments = [index.members[a:b] for a, b in zip(index.cuts[:-1].tolist(), index.cuts[1:].tolist(), strict=True)]
        self.posts = np.bincount(index.members, minlength=len(index.ids))
        self.width = index.vectors.shape[1]
        self.most = int(np.abs(index.vectors).max(initial=0)) + index.half
        self.longest = float(np.sqrt((index.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))

    def search(self, q: np.ndarray, own: int | None = None) -> Found:
        """The k best of the block for the query, all rows that tie for the last place being weighed by id; ``own``: a place that doesn't count."""
        index, n = self.index, len(self.index.ids)
        q = np.pad(q, (0, max(0, self.width - len(q))))[: self.width]
        size = np.abs(q)
        add = q[index.dim] * index.impact
        reach = size[index.dim] * (np.abs(index.impact) + index.half)
        order = np.argsort(-reach, kind="stable")
        order = order[: int(np.count_nonzero(reach))]
        # a row's postings that were scored are counted in the low bits of its sum, if there is room for them
        bits = self.width.bit_length() if int(size.sum()) * self.most < 1 << 55 else 0
        sums = np.zeros(n, dtype=np.int64)
        step = (add << bits) + (bits > 0)
        blur = int(size.sum()) * index.half
        keep = min(self.k, n - (own is not None))
        if keep <= 0:
            return Found(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, False)
        next_try = TRY * float(np.linalg.norm(q.astype(np.float64))) * self.longest / max(1, self.width)
        possible, postings, proved, done = None, 0, False, 0
        reaches, sizes = reach[order], (index.cuts[1:] - index.cuts[:-1])[order]
        small = (int(size.sum()) * self.most + 1) << bits < 1 << 52
        while done < len(order):
            if reaches[done] < next_try:
                possible = self._possible(sums, bits, int(reaches[done]), blur, keep, own)
                if len(possible) <= max(FEW * self.k, keep):
                    proved = True
                    break
                next_try = TRY * int(reaches[done])
            # all segments up to the next try, some at a time; the first at least
            upto = done + max(1, int(np.count_nonzero(reaches[done:] >= next_try)))
            upto = min(upto, done + max(1, int(np.searchsorted(np.cumsum(sizes[done:upto]), AT_ONCE))))
            at = np.concatenate([self.segments[s] for s in order[done:upto].tolist()])
            each = np.repeat(step[order[done:upto]], sizes[done:upto])
            if small:  # doubles hold such sums exactly
                sums += np.bincount(at, weights=each, minlength=n).astype(np.int64)
            else:
                np.add.at(sums, at, each)
            postings += len(at)
            done = upto
        if not proved:
            possible = self._possible(sums, bits, 0, blur, keep, own)
        score = index.vectors[possible].astype(np.int64) @ q
        best = np.lexsort((index.ids[possible], index.nameless[possible], -score))[:keep]
        return Found(possible[best], score[best], postings, len(possible), proved)

    def _possible(self, sums: np.ndarray, bits: int, most: int, blur: int, keep: int, own: int | None) -> np.ndarray:
        """Places that can be among the ``keep`` best, if each posting left adds or takes ``most`` at most."""
        left = (self.posts - (sums & ((1 << bits) - 1))) * most + blur
        score = sums >> bits
        low, high = score - left, score + left
        if own is not None:
            low[own] = high[own] = np.iinfo(np.int64).min
        least = np.partition(low, len(low) - keep)[len(low) - keep]
        good = high >= least
        if own is not None:
            good[own] = False
        return np.flatnonzero(good)


_INDEX = "c int, ids binary, nameless binary, rows binary, vectors binary, dim binary, impact binary, cuts binary, members binary, kind int, half long"
_FOUND = "query_row long, query_id long, vec_id long, score long"


def _indexed(table: pa.Table) -> pa.Table:
    made = Index.of(table["id"].fill_null(0).to_numpy(), table["row"].to_numpy(), _matrix(table["v"]), table["id"].is_null().to_numpy()).packed()
    fields = [("c", pa.int32()), *((c, pa.binary()) for c in ("ids", "nameless", "rows", "vectors", "dim", "impact", "cuts", "members")), ("kind", pa.int32()), ("half", pa.int64())]
    return pa.Table.from_pylist([{"c": table["c"][0].as_py()} | made], pa.schema(fields))


def _meeting(k: int):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        made: list[tuple[int, int, Found]] = []
        if block.num_rows and queries.num_rows:
            index = Index.unpacked(block.to_pylist()[0])
            searcher = Searcher(index, k)
            place = {r: i for i, r in enumerate(index.rows.tolist())}
            for row, id_, q in zip(queries["row"].to_pylist(), queries["id"].to_pylist(), _matrix(queries["v"]), strict=True):
                made.append((row, id_, searcher.search(q, place.get(row))))
            at = np.concatenate([f.at for _, _, f in made])
            n = [len(f.at) for _, _, f in made]
            cols = [*(np.repeat([x[i] for x in made], n) for i in (0, 1)), pa.array(index.ids[at], mask=index.nameless[at]), np.concatenate([f.score for _, _, f in made])]
        else:
            cols = [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), (c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols), strict=True)))

    return run


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by ``every`` the k other rows of highest integer inner product.

    Components become floor(scale * x). Ties go to the smaller id, null last. Rows whose vector is null or holds null or non-finite components take no part; one whose id is
    null asks for nothing, but is a candidate like others. Each row counts, those that share an id too: such a row is a candidate of its like, and as a query each
    of them has k rows of its own. Vectors of different lengths are compared over the components that both have. Fewer rows
    than k give all; an empty table gives an empty result. Other columns play no part. Scores must fit 64 bits.
    """
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    fine = F.col(vec_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    cut = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e).cast("long"))
    rows = materialize(vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), cut.alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    n, n_queries = rows.select(F.count(F.lit(1)), F.count_if(asks)).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    block = lambda name, count: F.pmod(F.xxhash64(F.lit(name), "row"), F.lit(count)).cast("int")
    every_block = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = materialize(rows.select(block("c", c_blocks).alias("c"), "id", "row", "v").groupBy("c").applyInArrow(_indexed, _INDEX), "postings")
    blocks = index.withColumn("q", every_block(q_blocks))
    queries = rows.where(asks).select("id", "row", "v", every_block(c_blocks).alias("c"), block("q", q_blocks).alias("q"))
    found = blocks.groupBy("c", "q").cogroup(queries.groupBy("c", "q")).applyInArrow(_meeting(k), _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
