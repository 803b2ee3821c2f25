"""All core queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaylake.queries import analysis, corpora, packets, scores

_MODULES = (analysis, corpora, packets, scores)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, path: str) -> DataFrame:
    """Success rates with intervals by method and model."""
    return analysis.rate_rollup_wilson(spark, path)
