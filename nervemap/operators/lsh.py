"""Locality-sensitive hashing: five families, two amplifications, approximate self-joins."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nervemap.functions.vectors import as_array, dot, support
from nervemap.operators.neighbors import BOTH, LEFT, RIGHT, in_units, nearest, top_k
from nervemap.runtime import materialize

#: The distance that each family approximates.
FAMILIES = {"simhash": "cosine", "minhash": "jaccard", "pstable_l1": "manhattan", "pstable_l2": "euclidean", "bitsampling": "hamming"}


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


@dataclass
class Lsh:
    """Hash functions of one family, drawn from a seed; the tables of a smaller number are the first of a larger one."""

    family: str
    num_features: int
    signature_length: int
    num_tables: int
    seed: int = 0
    bucket_width: float = 1.0
    prime: int = 2147483647
    num_bands: int = 1
    draws: list = field(init=False, repr=False)

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"no family is called {self.family}; there are {', '.join(FAMILIES)}")
        if min(self.num_features, self.signature_length, self.num_tables) < 1:
            raise ValueError("features, signature length and tables must be positive")
        if self.family.startswith("pstable") and not self.bucket_width > 0:
            raise ValueError("bucket_width must be positive")
        if self.family == "minhash" and not is_prime(self.prime):
            raise ValueError("prime must be a prime number")
        if self.num_bands < 1 or self.signature_length % self.num_bands:
            raise ValueError("num_bands must be positive and divide the signature length")
        if self.family != "minhash" and self.num_bands != 1:
            raise ValueError("only minhash has bands")
        self.draws = [self._draw(np.random.default_rng([self.seed, t])) for t in range(self.num_tables)]

    def _draw(self, r: np.random.Generator):
        n, m = self.signature_length, self.num_features
        if self.family == "simhash":
            return r.standard_normal((n, m))
        if self.family == "minhash":
            return [(int(a), int(b)) for a, b in zip(r.integers(1, self.prime, n), r.integers(0, self.prime, n), strict=True)]
        if self.family == "bitsampling":
            return sorted(set(r.integers(0, m, n).tolist()))
        rows = r.standard_cauchy((n, m)) if self.family == "pstable_l1" else r.standard_normal((n, m))
        return rows, r.uniform(0, self.bucket_width, n)

    def signature(self, table: int, v: Column) -> Column:
        """array<long> of one table: set bit positions, permutation minima, quantised projections, or sampled non-zero indices."""
        d = self.draws[table]
        row = lambda x: F.array(*(F.lit(float(y)) for y in x))
        if self.family == "simhash":
            bits = F.transform(F.array(*map(row, d)), lambda g: dot(g, v) > 0)
            return F.filter(F.transform(bits, lambda b, i: F.when(b, i.cast("long"))), lambda x: x.isNotNull())
        if self.family == "minhash":
            s = support(v)
            mins = [F.array_min(F.transform(s, self._permuted(a, b))) for a, b in d]
            return F.when(F.size(s) > 0, F.array(*mins)).otherwise(F.raise_error(F.lit("a vector without non-zero components has no minimum hash")).cast("array<bigint>"))
        if self.family == "bitsampling":
            return F.filter(F.array(*(F.when(F.get(v, F.lit(i)) != 0, F.lit(i).cast("long")) for i in d)), lambda x: x.isNotNull())
        rows, offsets = d
        both = F.array(*(F.struct(row(a).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(rows, offsets, strict=True)))
        return F.transform(both, lambda x: F.floor((dot(x["a"], v) + x["b"]) / self.bucket_width).cast("long"))

    def _permuted(self, a: int, b: int):
        return lambda i: F.pmod(F.pmod(i.cast("long") * a + b, F.lit(self.prime)), F.lit(self.num_features)).cast("long")

    def buckets(self, df: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
        """(id, v, tbl, band, key): each row once in every table and band; the key is the signature itself, so buckets never merge by chance."""
        rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), as_array(df, vec_col).alias("v"))
        out = rows.select("id", "v", F.posexplode(F.array(*(self.signature(t, F.col("v")) for t in range(self.num_tables)))).alias("tbl", "sig"))
        width = self.signature_length // self.num_bands
        bands = F.transform(F.sequence(F.lit(0), F.lit(self.num_bands - 1)), lambda i: F.slice("sig", i * width + 1, F.lit(width))) if self.num_bands > 1 else F.array("sig")
        return out.select("id", "v", "tbl", F.posexplode(bands).alias("band", "key"))


def approx_similarity_join(df: DataFrame, k: int, lsh: Lsh, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(i, j, value): the k nearest other rows of each row among those that share a bucket with it."""
    name = F.concat_ws(":", "tbl", "band", F.array_join(F.col("key").cast("array<string>"), ","))
    points = lsh.buckets(df, id_col, vec_col).select(name.alias("g"), "id", "v", F.lit(True).alias("picked"))
    return top_k(nearest(points, k, FAMILIES[lsh.family]).select("i", "j", "value").distinct(), k)


def _shared(table: pa.Table) -> pa.Table:
    """Ordered pairs of a unit for which this bucket is the first of those that they share."""
    side, slot = table["side"].to_numpy(), int(table["slot"][0].as_py())
    keys = table["keys"].combine_chunks()
    known = keys.flatten().to_numpy().reshape(len(side), -1)
    left, right = known[side != RIGHT], known[side != LEFT]
    total = 0
    for lo in range(0, len(left), 256):  # 256 rows against a block
        fresh = np.ones((len(left[lo : lo + 256]), len(right)), dtype=bool)
        for t in range(slot):
            fresh &= left[lo : lo + 256, t][:, None] != right[:, t][None, :]
        total += int(np.count_nonzero(fresh))
    return pa.table({"pairs": pa.array([total * (2 if (side != BOTH).any() else 1)], pa.int64())})


def avg_selectivity(df: DataFrame, lsh: Lsh, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(selectivity): distinct ordered pairs that share a bucket, each row with itself included, over the square of the rows.

    No pair is made: a bucket's blocks are held against each other and only counts leave the task. A pair counts in the first of its shared
    buckets, for which each row brings 64-bit hashes of all its keys. A row is told by its place, so rows may share an id.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(as_array(df, vec_col).alias("v")).withColumn("id", F.monotonically_increasing_id())
    width = lsh.signature_length // lsh.num_bands
    keys = [F.xxhash64(F.lit(t), F.lit(b), F.slice(lsh.signature(t, F.col("v")), b * width + 1, width) if lsh.num_bands > 1 else lsh.signature(t, F.col("v"))) for t in range(lsh.num_tables) for b in range(lsh.num_bands)]
    held = materialize(rows.select("id", F.array(*keys).alias("keys")), "bucket-keys")
    points = held.select("id", "keys", F.posexplode("keys").alias("slot", "key")).select(F.concat_ws(":", "slot", "key").alias("g"), "id", "slot", "keys")
    counts = in_units(materialize(points, "bucket-points")).groupBy("g", "l", "r").applyInArrow(_shared, "pairs long")
    one = counts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).withColumn("_", F.lit(0))
    n = held.agg(F.count(F.lit(1)).alias("n")).withColumn("_", F.lit(0))
    return one.join(n, "_").select((F.col("pairs") / F.nullif(F.col("n").cast("double") * F.col("n"), F.lit(0.0))).alias("selectivity"))
