"""Covers and Reeb diagrams as stages of ``pyspark.ml`` pipelines, which are saved and loaded like others."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from nervemap.operators.cover import Cover, CoverModel
from nervemap.operators.reeb import ReebDiagram, ReebDiagramModel


class _Settable(Params):
    """Values by name at once, None being none."""

    def set_params(self, **values):
        return self._set(**{k: v for k, v in values.items() if v is not None})

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class _CoverParams(_Settable, HasInputCols, HasOutputCol):
    numSplits = Param(Params._dummy(), "numSplits", "pieces of a dimension", TypeConverters.toInt)
    overlapRatio = Param(Params._dummy(), "overlapRatio", "share of its length that a piece is widened by", TypeConverters.toFloat)
    exploding = Param(Params._dummy(), "exploding", "whether a row is made for each cube", TypeConverters.toBoolean)
    closed = Param(Params._dummy(), "closed", "whether cubes hold their ends", TypeConverters.toBoolean)
    idCol = Param(Params._dummy(), "idCol", "id column of exploded rows", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(outputCol="cover_ids", numSplits=10, overlapRatio=0.1, exploding=False, closed=False, idCol="id")

    def cover(self) -> Cover:
        return Cover(*(self.value(n) for n in ("inputCols", "outputCol", "numSplits", "overlapRatio", "exploding", "idCol", "closed")))


class CoverStage(Estimator, _CoverParams, DefaultParamsReadable, DefaultParamsWritable):
    """``Cover`` as an estimator."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, numSplits=None, overlapRatio=None, exploding=None, closed=None, idCol=None):
        super().__init__()
        self._defaults()
        self.set_params(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CoverStageModel:
        found = self.cover().fit(dataset)
        return self._copyValues(CoverStageModel(low=found.min, high=found.max))


class CoverStageModel(Model, _CoverParams, DefaultParamsReadable, DefaultParamsWritable):
    """A cover with the range of each dimension, which are parameters and so saved with the others."""

    low = Param(Params._dummy(), "low", "least value of each dimension", TypeConverters.toListFloat)
    high = Param(Params._dummy(), "high", "greatest value of each dimension", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, low=None, high=None):
        super().__init__()
        self._defaults()
        self.set_params(**self._input_kwargs)

    def model(self) -> CoverModel:
        return CoverModel(self.cover(), list(self.value("low")), list(self.value("high")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model().transform(dataset)


#: Parameters of a Reeb diagram beside its columns: name here, name there, type.
_REEB = (
    ("k", "k", TypeConverters.toInt), ("linkThresholdRatio", "link_threshold_ratio", TypeConverters.toFloat), ("coreThresholdRatio", "core_threshold_ratio", TypeConverters.toFloat),
    ("measure", "measure", TypeConverters.toString), ("topTreeSize", "top_tree_size", TypeConverters.toInt), ("topTreeLeafSize", "top_tree_leaf_size", TypeConverters.toInt),
    ("subTreeLeafSize", "sub_tree_leaf_size", TypeConverters.toInt), ("numVPCandidates", "num_vp_candidates", TypeConverters.toInt), ("numVPSamples", "num_vp_samples", TypeConverters.toInt),
    ("bufferSize", "buffer_size", TypeConverters.toFloat), ("bufferSizeSamples", "buffer_size_samples", TypeConverters.toListInt), ("search", "search", TypeConverters.toString),
    ("idCol", "id_col", TypeConverters.toString), ("coverCol", "cover_col", TypeConverters.toString),
)


class _ReebParams(_Settable, HasFeaturesCol, HasOutputCol, HasSeed):
    def _defaults(self) -> None:
        plain = ReebDiagram()
        own = {name: getattr(plain, field) for name, field, _ in _REEB}
        self._setDefault(featuresCol=plain.features_col, outputCol=plain.output_col, seed=plain.seed, **{k: list(v) if isinstance(v, tuple) else v for k, v in own.items()})

    def diagram(self) -> ReebDiagram:
        values = {field: self.value(name) for name, field, _ in _REEB}
        values["buffer_size_samples"] = tuple(values["buffer_size_samples"])
        return ReebDiagram(features_col=self.value("featuresCol"), output_col=self.value("outputCol"), seed=self.value("seed"), **values)


for _name, _field, _kind in _REEB:
    setattr(_ReebParams, _name, Param(Params._dummy(), _name, f"{_field} of the diagram", _kind))


class ReebStage(Estimator, _ReebParams, DefaultParamsReadable, DefaultParamsWritable):
    """``ReebDiagram`` as an estimator; parameters by ``set_params`` or as arguments."""

    def __init__(self, **values):
        super().__init__()
        self._defaults()
        self.set_params(**values)

    def _fit(self, dataset: DataFrame) -> ReebStageModel:
        found = self.diagram().fit(dataset)
        return self._copyValues(ReebStageModel(found.nodes, numCubes=found.num_cubes, estimatedBuffer=found.buffer_size))


class ReebStageModel(Model, _ReebParams, MLReadable, MLWritable):
    """A fitted diagram: the number of cells, the buffer, and the node table of its trees, which is saved as a table."""

    numCubes = Param(Params._dummy(), "numCubes", "cells of the cover", TypeConverters.toInt)
    estimatedBuffer = Param(Params._dummy(), "estimatedBuffer", "within which leaves are looked into at once", TypeConverters.toFloat)

    def __init__(self, nodes: DataFrame | None = None, **values):
        super().__init__()
        self._defaults()
        self.nodes = nodes
        self.set_params(**values)

    def model(self) -> ReebDiagramModel:
        return ReebDiagramModel(self.diagram(), self.value("numCubes"), self.value("estimatedBuffer"), self.nodes)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model().transform(dataset)

    def write(self) -> MLWriter:
        return _ReebWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ReebReader()


class _ReebWriter(MLWriter):
    def __init__(self, stage: ReebStageModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, SparkSession.active())
        self.stage.nodes.write.parquet(f"{path.rstrip('/')}/nodes")


class _ReebReader(MLReader):
    def load(self, path: str) -> ReebStageModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = ReebStageModel(spark.read.parquet(f"{path.rstrip('/')}/nodes"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage
