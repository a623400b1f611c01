"""A fitted cover on a stream: it has no state, so a batch and a stream are treated alike."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nervemap.operators.cover import CoverModel


def cover_stream(model: CoverModel, stream: DataFrame) -> DataFrame:
    """The stream with cover numbers. Exploded rows need their id column in the stream."""
    if model.cover.exploding and model.cover.id_col not in stream.columns:
        raise ValueError("a stream needs an id column of its own")
    return model.transform(stream)
