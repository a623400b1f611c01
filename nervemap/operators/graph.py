"""Connected components of an edge table: contraction in rounds, then one bounded task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nervemap.runtime import importable, materialize

#: Edges that one task finishes by itself (16 bytes each for numbers, some copies of it).
FINISH = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join what the links (a, b) join: each vertex that isn't the smallest of its component, and that smallest."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for ends in (x, y, label[x], label[y]):
            np.minimum.at(new, ends, low)
        while not np.array_equal(new, deeper := new[new]):
            new = deeper
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(names)))
    return names[own], names[label[own]]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)  # FINISH rows at most
    if held:
        table = pa.Table.from_batches(held)
        kind = table.schema.field("a").type
        v, p = forest(*(table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("a", "b")))
        yield pa.RecordBatch.from_arrays([pa.array(v, kind), pa.array(p, kind)], ["v", "p"])


def _pointed(parents: DataFrame) -> DataFrame:
    """Parents replaced by parents' parents until each vertex points to the end of its chain, which halves chains at each step."""
    while True:
        up = parents.select(F.col("v").alias("_u"), F.col("p").alias("_q"))
        further = materialize(parents.join(up, F.col("p") == F.col("_u")).select("v", F.col("_q").alias("p"), (F.col("p") != F.col("_q")).alias("moved")), "parents")
        parents = further.select("v", "p")
        if further.where("moved").isEmpty():
            return parents


def _contracted(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (vertex, where its chain of smallest neighbours ends), and the edges between those ends."""
    both = rest.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(rest.select(F.col("b").alias("v"), F.col("a").alias("w")))
    to = _pointed(materialize(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("p")), "parents"))
    ends = rest.join(to.withColumnsRenamed({"v": "a", "p": "pa"}), "a").join(to.withColumnsRenamed({"v": "b", "p": "pb"}), "b").where(F.col("pa") != F.col("pb"))
    return to, materialize(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")


def _followed(found: DataFrame | None, to: DataFrame) -> DataFrame:
    if found is None:
        return to.select(F.col("v").alias("vertex"), F.col("p").alias("component"))
    return found.join(to, F.col("component") == F.col("v"), "left").select("vertex", F.coalesce("p", "component").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, component) of every vertex that has an edge to another; component: its smallest vertex.

    In a round every vertex points to its smallest neighbour (or itself, if smaller), chains of pointers are followed to their ends, and
    edges are renamed; those that close on themselves go. What is left of a vertex after two rounds has taken in a neighbour at least, so
    rounds are at most twice the binary logarithm of the vertices, whatever their numbering, and the steps of a round the
    logarithm of its longest chain. As soon as FINISH edges or fewer are left, one task ends the matter. All else are joins and map-side
    combined minima; the driver sees a count a round. Edges with a null end are ignored.
    """
    spark = importable(edges.sparkSession)
    kind = edges.schema[src].dataType.simpleString()
    rest = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a") != F.col("b"))
    rest = materialize(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while (left := rest.count()) > FINISH:
        to, rest = _contracted(rest)
        found = materialize(_followed(found, to), "components")
    if left:
        last = materialize(rest.coalesce(1).mapInArrow(_finish, f"v {kind}, p {kind}"), "parents")
        roots = last.select("p").distinct().select(F.col("p").alias("v"), "p")
        found = materialize(_followed(found, last if found is not None else last.unionByName(roots)), "components")
    if found is None:
        return spark.createDataFrame([], f"vertex {kind}, component {kind}")
    return found
