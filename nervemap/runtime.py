"""Where intermediate tables are kept, and how rows are numbered without a single-task window."""

from __future__ import annotations

import atexit
import functools
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits that ``monotonically_increasing_id`` gives to the position within a partition.
_POSITION_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a folder of this machine is used, but only if the session itself
    runs on this machine alone.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("/tmp/checkpoints")
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, when the driver's Python ends or before."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder then stays with the cluster's clean-up
        pass


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The result has no lineage to recompute, is fixed for every later reader, and survives the loss of
    any executor. The folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/nervemap-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, or one made from it, such that no column of ``df`` and none of the others is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever they are called."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of rows that a task sorts or joins at once, about.
TASK_BYTES = 32 << 20
#: Partitions at most.
MOST_PARTITIONS = 4096


def dealt(df: DataFrame, rows: int, size: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows of ``size`` bytes, by the hashes of ``keys`` into partitions of ``TASK_BYTES`` at most, about.

    So what a task of the next window or join by these keys holds doesn't grow with the table. Small tables are left to Spark.
    """
    return dealt_into(df, rows * size // TASK_BYTES, *keys)


def dealt_into(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` by the hashes of ``keys`` into ``parts`` partitions, ``MOST_PARTITIONS`` at most, or the session's if those are more; two tables that are joined or grouped together get the same number.

    One part is left to Spark. More are not, even where the session has enough partitions: it merges them by their compressed bytes, of which rows that take much memory may have few, until
    a task holds them all.
    """
    parts = min(MOST_PARTITIONS, parts)
    return df.repartition(max(parts, partitions(df.sparkSession)), *keys) if parts > 1 else df


def ordered(df: DataFrame, *keys: str, name: str = "ordered") -> tuple[DataFrame, list[int]]:
    """``df`` range-partitioned and sorted by ``keys``, with columns ``_part`` and ``_pos``, and the rows
    before each partition.

    Row number = ``before[_part] + _pos``. Rows that agree in every key are told apart by where they
    stand in the input, so that any number of equal rows spreads over partitions. The driver gets one
    count a partition.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    n = partitions(spark)
    spread = df.withColumn("_tie", at).repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = materialize(
        spread.withColumn("_at", at).withColumns({"_part": F.shiftright("_at", _POSITION_BITS).cast("int"), "_pos": F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))}).drop("_at"),
        name,
    )
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    return placed, [*before, total]


def numbered(df: DataFrame, *keys: str, name: str = "numbered") -> tuple[DataFrame, int]:
    """``df`` with a gapless ``_row`` from 0 in the order of ``keys``, and the number of rows."""
    placed, before = ordered(df, *keys, name=name)
    if len(before) < 2:
        return placed.drop("_part", "_pos").withColumn("_row", F.lit(0).cast("long")), 0
    sums = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    start = sums.select("_part", F.coalesce(earlier, F.lit(0)).alias("_start"))
    out = placed.join(F.broadcast(start), "_part")  # one row a partition
    return out.withColumn("_row", F.col("_start") + F.col("_pos")).drop("_part", "_pos", "_start", "_n"), before[-1]


#: Share of rows from which a key is hot: there are fewer such keys than this, so they are few enough to be broadcast.
HOT = 4096


def hot_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row a key, by shuffle but for hot keys, whose rows stay where they are."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = materialize(counts.where(F.col("_n") * HOT > F.lit(total)).select(key), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(hot)  # fewer than HOT rows
    cold = rows.join(hot, key, "left_anti").join(table, key)
    return cold.unionByName(rows.join(F.broadcast(table.join(hot, key, "left_semi")), key))


#: Bytes of an Arrow batch to a Python worker, unless the session says otherwise than Spark's default of 64 MB: workers hold a batch several times.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), str(4 << 20)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this library where the driver found it, if that folder exists for them, and get their rows in small batches."""
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")
    name, usual, small = ARROW_BYTES
    if spark.conf.get(name, usual).rstrip("b") == usual:
        spark.conf.set(name, small)
    return spark


def _give_back() -> None:
    """Memory that a worker has freed goes back to the machine, where the C library can do that: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """``run``, a function of batches for ``mapInArrow``, that leaves no freed memory with the worker when its task ends."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


def trimmed_group(run: Callable) -> Callable:
    """The same for a function of one or two tables for ``applyInArrow``."""

    def told(*tables):
        try:
            return run(*tables)
        finally:
            _give_back()

    # Spark counts the arguments
    return (lambda table: told(table)) if len(inspect.signature(run).parameters) == 1 else (lambda left, right: told(left, right))
