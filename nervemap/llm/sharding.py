"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Rows get global numbers 0..N-1 in the order of (id, text hash, size, crc). A keyed permutation of
0..N-1 then gives each row its place: place % shards is the shard, place // shards the slot. So the law
is ``rows``: counts differ by one at most, slots have no gaps, and both are computable for any row number,
and back, from (N, seed, shards) alone.

The permutation works on a grid of a * b >= N cells with a, b about sqrt(N), fewer than a cells beyond N;
a place beyond N is permuted again until it falls below N. The longest such walk is found beforehand
from the fewer than a cells beyond N, so the expression has exactly as many steps as are ever needed.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nervemap.runtime import numbered

#: Field of the round function, 2**31 - 1: squares stay within 64 bits.
PRIME = 2147483647


@dataclass(frozen=True)
class FeistelPermutation:
    """A permutation of 0..n-1, the same for the same n, seed and rounds (an even number)."""

    n: int
    seed: int = 0
    rounds: int = 8

    def __post_init__(self):
        if self.n < 0 or self.rounds < 2 or self.rounds % 2:
            raise ValueError("n must be 0 or more and rounds even")

    @property
    def grid(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(0, self.n - 1)) + 1)
        return a, max(1, -(-self.n // a))

    @property
    def keys(self) -> list[tuple[int, int, int]]:
        """Of each round: what is added before and after cubing, and the modulus of the half it changes."""
        draw = random.Random(f"{self.seed}/{self.n}/{self.rounds}")
        return [(draw.randrange(1, PRIME), draw.randrange(PRIME), self.grid[i % 2]) for i in range(self.rounds)]

    def step(self, x: int) -> int:
        left, right = divmod(x, self.grid[1])
        for k, c, m in self.keys:
            t = (right + k) % PRIME
            left, right = right, (left + (t * t % PRIME * t + c) % PRIME) % m
        return left * self.grid[1] + right

    def back(self, y: int) -> int:
        left, right = divmod(y, self.grid[1])
        for k, c, m in reversed(self.keys):
            t = (left + k) % PRIME
            left, right = (right - (t * t % PRIME * t + c) % PRIME) % m, left
        return left * self.grid[1] + right

    def forward(self, x: int) -> int:
        x = self.step(x)
        while x >= self.n:
            x = self.step(x)
        return x

    def inverse(self, y: int) -> int:
        y = self.back(y)
        while y >= self.n:
            y = self.back(y)
        return y

    def longest_walk(self) -> int:
        """Steps after the first that some row may need."""
        if not self.n:
            return 0
        a, b = self.grid
        most = 0
        for x in range(self.n, a * b):
            steps = 1
            while (x := self.step(x)) >= self.n:
                steps += 1
            most = max(most, steps)
        return most

    def column(self, row: Column) -> Column:
        b = F.lit(self.grid[1]).cast("long")
        keys = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("c"), F.lit(m).cast("long").alias("m")) for k, c, m in self.keys))
        p = F.lit(PRIME).cast("long")

        def once(x: Column) -> Column:
            def turn(h: Column, key: Column) -> Column:
                t = (h["r"] + key["k"]) % p
                return F.struct(h["r"].alias("l"), ((h["l"] + ((t * t) % p * t + key["c"]) % p) % key["m"]).alias("r"))

            halves = F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r"))
            return F.aggregate(keys, halves, turn, lambda h: h["l"] * b + h["r"])

        walk = self.longest_walk()
        if not walk:
            return once(row)
        return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once(row), lambda x, _: F.when(x >= self.n, once(x)).otherwise(x))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, size, text_crc32, row number, law, shard, slot and grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` its unsigned CRC-32; a null text counts
    as empty. Null ids come first. Equal rows are interchangeable and get different places. An empty table gives
    an empty result. Other columns play no part. ``grown_shard`` is null: only the law ``key`` has it. Under the law ``rows``
    copies of one text are spread like any other rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text).alias("_hash"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(slim, "_id", "_hash", "size", "text_crc32", name="shards")
    place = FeistelPermutation(n, seed).column(F.col("_row"))
    return rows.withColumn("_place", place).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_row").alias("row_number"),
    )
