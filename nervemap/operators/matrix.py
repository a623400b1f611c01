"""Matrices as tables of (i, j, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hadamard(a: DataFrame, b: DataFrame, f: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """f of the products of entries that both have."""
    both = a.select("i", "j", F.col("value").alias("_a")).join(b.select("i", "j", F.col("value").alias("_b")), ["i", "j"])
    return both.select("i", "j", f(F.col("_a") * F.col("_b")).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def to_rows(a: DataFrame) -> DataFrame:
    """(i, entries): each row's (j, value), by j."""
    return a.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("entries"))


def to_entries(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The entries that aren't zero of a table of vectors."""
    return df.select(F.col(id_col).alias("i"), F.posexplode(vec_col).alias("j", "value")).where("value <> 0")
