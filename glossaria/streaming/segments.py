"""Segments and predictions of a stream of entities: the same expressions, as none needs state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glossaria.config import Config
from glossaria.operators.predictions import word_list_models
from glossaria.operators.segments import unpivot, with_metrics


def stream_predictions(stream: DataFrame, entity: str, child: str | None, fields: dict[str, str], words: dict[str, list[str]], cfg: Config) -> DataFrame:
    """Top-k labels of valid segments of a streaming frame, in append mode."""
    return word_list_models(with_metrics(unpivot(stream, entity, child, fields, cfg), cfg).filter("is_valid"), {"a": words}, cfg.top_k)
