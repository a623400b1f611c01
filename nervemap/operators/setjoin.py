"""Exact nearest neighbours of sets, by the jaccard or hamming distance, over an inverted index of prefixes.

Elements are ordered by how many sets hold them, the rarest first. Two sets within a distance share an element among the first few of both, the
fewer the smaller the distance; so a round at a small distance looks at rare elements only. Whoever has k neighbours within it is done, exactly,
since every pair within it was found; the others go on at a larger one. In a list of an element a task compares blocks of those that still ask with
blocks of those that stand there, by matrix products, and a pair counts at the first element that both prefixes share, nowhere else.

Sets that share nothing are at jaccard distance 1, where smaller ids come first: what is missing of k after all rounds is filled from the 2 k + 1 smallest
ids. For hamming distances all sets hold one element more, the commonest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nervemap.functions.sparse import is_sparse
from nervemap.functions.vectors import as_array, measure_name, support
from nervemap.operators.metric_index import MOST, Counted
from nervemap.operators.neighbors import similarity_join, top_k
from nervemap.runtime import hot_join, importable, materialize, partitions, trimmed_group

#: Sets of a list that are compared at once.
PIECE = 2048
#: Rows of a bucket of lists, on average.
BUCKET = 20_000
#: Jaccard distances of the rounds; the last one is all that share an element.
DISTANCES = (0.2, 0.5, 0.8, 1.0)
#: Pairs of a set in all its lists, on average, and share of all pairs, up to which there is one round: comparing costs less than sending sets to more of them.
SHORT, SHORT_SHARE = 512, 0.001
#: The element that all sets hold, for hamming distances.
_ALL = (1 << 63) - 1
_FOUND = "i long, j long, value double"


def _ordered(df: DataFrame, id_col: str, vec_col: str, measure: str) -> tuple[DataFrame, float]:
    """(id, n, s): a set's elements, the rarest first; and how many pairs stand in the lists of all elements."""
    kind = df.schema[vec_col].dataType
    own = F.col(vec_col)["indices"] if is_sparse(kind) else support(as_array(df, vec_col))
    size = F.col(vec_col)["size"] if is_sparse(kind) else F.size(vec_col)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), own.cast("array<bigint>").alias("s"), size.alias("size"))
    rows = materialize(rows, "sets")
    least, most, empty = rows.agg(F.min("size"), F.max("size"), F.count_if(F.size("s") == 0)).first()
    if least != most:
        raise ValueError("vectors differ in length")
    if measure == "jaccard" and empty > 1:
        raise ValueError("a distance is not a number of 0 or more")
    each = rows.select("id", F.explode("s").alias("t"))
    counts = materialize(each.groupBy("t").agg(F.count(F.lit(1)).alias("c")), "elements")
    lists = hot_join(each, counts, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("x"))
    full = lists.select("id", F.transform("x", lambda p: p["t"]).alias("s")).unionByName(rows.where(F.size("s") == 0).select("id", "s"))
    if measure == "hamming":
        full = full.withColumn("s", F.concat("s", F.array(F.lit(_ALL))))
    pairs = counts.agg(F.sum(F.col("c").cast("double") * F.col("c"))).first()[0] or 0.0
    return materialize(full.select("id", F.size("s").alias("n"), "s"), "ordered-sets"), pairs


def _prefix(measure: str, within: float) -> Column:
    """How many elements of a set are looked at, so that two within the distance share one of them."""
    n = F.col("n")
    if measure == "hamming":
        return F.least(n, F.lit(int(within) + 1))
    return F.least(n, n - F.ceil((1.0 - within) * n - 1e-9).cast("int") + 1)


def _matrices(flat: np.ndarray, sizes: np.ndarray, place: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """By row and element: which a set holds, and which of those come before the list's own, whose place is ``place``."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    held, early = (np.zeros((len(sizes), names), np.float32) for _ in range(2))
    held[row, flat] = 1
    first = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(place, sizes)
    early[row[first], flat[first]] = 1
    return held, early


def _compared(measure: str, k: int, within: float):
    """The lists of a bucket, one after another: those that ask with those that stand there."""

    def sides(table: pa.Table) -> tuple[np.ndarray, ...]:
        table = table.sort_by([("t", "ascending"), ("id", "ascending")])
        s = table["s"].combine_chunks()
        sizes = s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return table["t"].to_numpy(), table["id"].to_numpy(), table["pos"].to_numpy(), sizes, np.concatenate(([0], np.cumsum(sizes))), s.flatten().to_numpy(zero_copy_only=False)

    def run(asking: pa.Table, there: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        compared = 0
        if asking.num_rows and there.num_rows:
            a, b = sides(asking), sides(there)
            for t in np.intersect1d(a[0], b[0]).tolist():
                (i, hi, si, fi), (j, hj, sj, fj) = (
                    (x[1][lo:up], x[2][lo:up], x[3][lo:up], x[5][x[4][lo] : x[4][up]]) for x in (a, b) for lo, up in [(np.searchsorted(x[0], t), np.searchsorted(x[0], t, "right"))]
                )
                names, at = np.unique(np.concatenate([fi, fj]), return_inverse=True)
                (p, ep), (q, eq) = _matrices(at[: len(fi)], si, hi, len(names)), _matrices(at[len(fi) :], sj, hj, len(names))
                both = (p @ q.T).astype(np.float64)
                either = si.astype(np.float64)[:, None] + sj.astype(np.float64)[None, :] - both
                d = either - both if measure == "hamming" else 1.0 - both / either
                compared += d.size
                row, col = np.nonzero((i[:, None] != j[None, :]) & ((ep @ eq.T) == 0) & (d <= within))
                value = d[row, col]
                order = np.lexsort((j[col], value, row))
                row, col, value = row[order], col[order], value[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                found.append((i[row[top]], j[col[top]], value[top]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array([*cols[0].tolist(), None], pa.int64()), pa.array([*cols[1].tolist(), None], pa.int64()), pa.array([*cols[2].tolist(), float(compared)])], ["i", "j", "value"])

    return run


def _lists(asking: DataFrame, sets: DataFrame, measure: str, within: float) -> tuple[DataFrame, DataFrame, Counted]:
    """A row for each element of each prefix, of those that ask and of all, and (t, na, nb): how many of either stand in an element's list."""
    heads = lambda df: df.withColumn("head", _prefix(measure, within)).where("head > 0").select("id", "s", F.posexplode(F.slice("s", F.lit(1), F.col("head"))).alias("pos", "t"))
    a, b = heads(asking), heads(sets)
    number = lambda df, name: df.groupBy("t").agg(F.count(F.lit(1)).alias(name))
    return a, b, Counted.of(number(a, "na").join(number(b, "nb"), "t"), "lists")


def _round(a: DataFrame, b: DataFrame, lists: Counted, measure: str, k: int, within: float) -> DataFrame:
    """(i, j, value): of each that asks up to k pairs within the distance from every list, all in all its k nearest; a row without j for each unit, with the pairs compared."""
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pieces = [F.ceil(F.col(n) / PIECE).cast("int").alias(n) for n in ("na", "nb")]
    rows = lists.table.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("t"), F.lit(max(partitions(a.sparkSession), rows // BUCKET))).alias("bucket")  # short lists share a task
    a = lists.joined(a, "t", *pieces).withColumn("p", deal("na")).withColumn("q", every("nb")).drop("na", "nb")
    b = lists.joined(b, "t", *pieces).withColumn("q", deal("nb")).withColumn("p", every("na")).drop("na", "nb")
    a, b = (x.select(bucket, "p", "q", "t", "id", "pos", "s") for x in (a, b))
    return a.groupBy("bucket", "p", "q").cogroup(b.groupBy("bucket", "p", "q")).applyInArrow(trimmed_group(_compared(measure, k, within)), _FOUND)


def set_join(df: DataFrame, k: int, measure: str = "jaccard", id_col: str = "id", vec_col: str = "vec", most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(i, j, value) of the k nearest other rows of each row, ties by id, as ``similarity_join`` gives it, and (within, asking, compared) of each round.

    Vectors, dense or sparse, count as the sets of their indices that aren't zero; ids are unique. Rows with a null id or vector take no part, vectors that
    differ in length fail the query, and so do two empty sets for jaccard distances. Where the lists of a round hold more than ``most`` of the pairs of those that ask
    with all, which is so if elements are common, all pairs are compared in blocks after all; the result is the same.
    """
    measure = measure_name(measure)
    if measure not in ("jaccard", "hamming"):
        raise ValueError("sets are compared by jaccard or hamming")
    if k < 1:
        raise ValueError("k must be positive")
    spark = importable(df.sparkSession)
    sets, pairs = _ordered(df, id_col, vec_col, measure)
    longest = sets.agg(F.max("n")).first()[0] or 0
    rounds = list(DISTANCES)
    if measure == "hamming":
        rounds = [1.0]
        while rounds[-1] < 2 * longest:
            rounds.append(rounds[-1] * 2)
    asking, done, told = sets.toDF(*sets.columns), None, []  # columns of its own
    total = sets.count()
    if measure == "jaccard" and pairs <= min(SHORT * total, SHORT_SHARE * total * total):
        rounds = rounds[-1:]  # rounds that settle few would send all sets again
    for within in rounds:
        n = asking.count()
        a, b, lists = _lists(asking, sets, measure, within)
        if (lists.table.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0) > most * n * total:
            told.append((float("inf"), total, total * total))
            return similarity_join(df, k, measure, id_col, vec_col), spark.createDataFrame(told, "within double, asking long, compared long")
        found = materialize(_round(a, b, lists, measure, k, within), "found")
        compared = found.where("j is null").agg(F.sum("value")).first()[0] or 0.0
        told.append((float(within), int(n), int(compared)))
        best = top_k(found.where("j is not null"), k)
        last = within == rounds[-1]
        full = best.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("i").alias("id"))
        kept = best if last else best.join(full.withColumnRenamed("id", "i"), "i", "left_semi")
        kept = materialize(kept, "nearest")
        done = kept if done is None else done.unionByName(kept)
        asking = materialize(asking.join(full, "id", "left_anti"), "asking")
        if asking.isEmpty():
            break
    if measure == "jaccard" and not asking.isEmpty():
        smallest = [r["id"] for r in sets.select("id").orderBy("id").limit(2 * k + 1).collect()]
        far = asking.select(F.col("id").alias("i"), F.explode(F.array(*map(F.lit, smallest))).alias("j")).where("i <> j")
        rest = far.join(done.select("i", "j"), ["i", "j"], "left_anti").withColumn("value", F.lit(1.0))
        order = Window.partitionBy("i").orderBy("value", "j")
        done = done.unionByName(rest.select("i", "j", "value")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return done, spark.createDataFrame(told, "within double, asking long, compared long")
