"""Covers of numeric and vector columns by overlapping cubes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.functions.vectors import as_array
from nervemap.operators.intervals import Cube, closed_cover, open_cover, widened


#: Pieces of a dimension up to which their tests are written out, and so compiled.
UNROLLED = 64


def assemble(df: DataFrame, cols: Sequence[str]) -> Column:
    """Numbers and vectors of the columns, in order, as one array<double>. A null fails the query."""
    whole = F.concat(*(as_array(df, c) for c in cols))
    missing = whole.isNull() | F.exists(whole, lambda x: x.isNull())
    return F.when(missing, F.raise_error(F.lit("a column to be covered is null")).cast("array<double>")).otherwise(whole)


@dataclass
class Cover:
    """Parameters of a cover; ``fit`` finds the range of each dimension."""

    input_cols: Sequence[str]
    output_col: str = "cover_ids"
    num_splits: int = 10
    overlap_ratio: float = 0.1
    exploding: bool = False
    id_col: str = "id"
    closed: bool = False

    def __post_init__(self):
        self.input_cols = list(self.input_cols)
        if not self.input_cols:
            raise ValueError("no column is to be covered")
        if not self.num_splits > 0:
            raise ValueError("num_splits must be positive")
        if not self.overlap_ratio > 0:
            raise ValueError("overlap_ratio must be positive")

    def schema(self, of: T.StructType) -> T.StructType:
        """The schema of the result, checked without running anything. Exploded: the input, the id if it is new, and a number."""
        for c in self.input_cols:
            kind = of[c].dataType
            vector = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)
            if not (isinstance(kind, T.NumericType) or vector or "VectorUDT" in type(kind).__name__):
                raise TypeError(f"column {c} holds {kind.simpleString()}, neither a number nor a vector")
        if self.output_col in of.names:
            raise ValueError(f"column {self.output_col} exists")
        fields = list(of.fields)
        if self.exploding:
            if self.id_col not in of.names:
                fields.append(T.StructField(self.id_col, T.LongType(), False))
            return T.StructType([*fields, T.StructField(self.output_col, T.IntegerType(), False)])
        return T.StructType([*fields, T.StructField(self.output_col, T.ArrayType(T.IntegerType(), False))])

    def fit(self, df: DataFrame) -> CoverModel:
        self.schema(df.schema)
        parts = df.select(F.posexplode(assemble(df, self.input_cols)))
        scalar = all(isinstance(df.schema[c].dataType, T.NumericType) for c in self.input_cols)
        if scalar:  # one aggregate, no explode
            row = df.agg(*(f(F.col(c).cast("double")) for c in self.input_cols for f in (F.min, F.max, lambda x: F.count_if(x.isNull())))).first()
            low, high, nulls = row[0::3], row[1::3], row[2::3]
            if any(nulls):
                raise ValueError("a column to be covered is null")
        else:
            rows = parts.groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).orderBy("pos").collect()
            low, high = [r["low"] for r in rows], [r["high"] for r in rows]
        if not low or any(x is None for x in low):
            raise ValueError("there is nothing to cover")
        return CoverModel(self, [float(x) for x in low], [float(x) for x in high])

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(json.dumps(asdict(self)),)], "params string").coalesce(1).write.parquet(path)

    @staticmethod
    def load(path: str) -> Cover:
        return Cover(**json.loads(SparkSession.active().read.parquet(path).first()["params"]))


@dataclass
class CoverModel:
    """A cover with the least and greatest value of each dimension."""

    cover: Cover
    min: list[float] = field(default_factory=list)
    max: list[float] = field(default_factory=list)

    @property
    def num_cubes(self) -> int:
        return self.cover.num_splits ** len(self.min)

    def copy(self, **changes) -> CoverModel:
        return CoverModel(replace(self.cover, **changes), list(self.min), list(self.max))

    def cube_list(self) -> list[Cube]:
        make = closed_cover if self.cover.closed else open_cover
        return make(self.min, self.max, self.cover.num_splits, self.cover.overlap_ratio)

    def cubes(self, spark: SparkSession) -> DataFrame:
        """(cube_id, dim, lo, hi), by formula in the executors; the last dimension varies fastest."""
        n, d = self.cover.num_splits, len(self.min)
        half = self.cover.overlap_ratio
        sides = [widened(a, b, n, half) for a, b in zip(self.min, self.max, strict=True)]
        table = F.array(*(F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in s)) for s in sides))
        ids = spark.range(self.num_cubes).select(F.col("id").alias("cube_id"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("dim"))
        at = F.expr(f"cast((cube_id div cast(power({n}, {d} - 1 - dim) as bigint)) % {n} as int)")
        side = F.get(F.get(table, F.col("dim")), at)
        return ids.select("cube_id", "dim", side["lo"].alias("lo"), side["hi"].alias("hi"))

    def _pieces(self, x: Column, sides: list[tuple[float, float]]) -> Column:
        """Numbers of the pieces of one dimension that hold x. Both ends ascend, so they are a run: from as many as end before x to as many as begin."""
        n, closed = len(sides), self.cover.closed
        if n <= UNROLLED:
            count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
            first = count((F.lit(hi) < x) if closed else (F.lit(hi) <= x) for _, hi in sides)
            last = count((F.lit(lo) <= x) if closed else (F.lit(lo) < x) for lo, _ in sides) - 1
            here = F.when(first <= last, F.sequence(first, last))
        else:
            low, high = (F.array(*(F.lit(s[k]) for s in sides)) for k in (0, 1))
            inside = (lambda i: (x >= F.get(low, i)) & (x <= F.get(high, i))) if closed else (lambda i: (x > F.get(low, i)) & (x < F.get(high, i)))
            here = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), inside)
        return F.when(~F.isnan(x), F.coalesce(here, F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))

    def cover_ids(self, point: list[Column]) -> Column:
        """Numbers of all cubes that hold the point, ascending: per dimension the pieces that hold it, then their combinations."""
        n, ids = self.cover.num_splits, None
        for x, a, b in zip(point, self.min, self.max, strict=True):
            here = self._pieces(x, widened(a, b, n, self.cover.overlap_ratio))
            ids = here if ids is None else F.flatten(F.transform(ids, self._beside(here)))
        return ids

    def _beside(self, here: Column):
        return lambda i: F.transform(here, lambda j: i * self.cover.num_splits + j)

    def _point(self, df: DataFrame) -> list[Column]:
        """The coordinates: numeric columns as they are, or the elements of the assembled vector."""
        cols = self.cover.input_cols
        if all(isinstance(df.schema[c].dataType, T.NumericType) for c in cols):
            fail = F.raise_error(F.lit("a column to be covered is null")).cast("double")
            return [F.when(F.col(c).isNull(), fail).otherwise(F.col(c).cast("double")) for c in cols]
        whole = assemble(df, cols)
        return [F.get(whole, F.lit(d)) for d in range(len(self.min))]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the array of cube numbers, or, exploded, a row for each cube that holds a row; the id is made if it isn't there."""
        c = self.cover
        c.schema(df.schema)
        ids = self.cover_ids(self._point(df))
        if not c.exploding:
            return df.withColumn(c.output_col, ids)
        if c.id_col not in df.columns:
            df = df.withColumn(c.id_col, F.monotonically_increasing_id())
        return df.withColumn(c.output_col, F.explode(ids))

    def save(self, path: str) -> None:
        params = json.dumps(asdict(self.cover))
        SparkSession.active().createDataFrame([(params, self.min, self.max)], "params string, min array<double>, max array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(path: str) -> CoverModel:
        r = SparkSession.active().read.parquet(path).first()
        return CoverModel(Cover(**json.loads(r["params"])), list(r["min"]), list(r["max"]))
