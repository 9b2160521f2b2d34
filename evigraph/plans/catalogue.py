"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.plans import api, events, nested, parsing, resolution, retrieval, text

_PARTS = [nested, text, retrieval, resolution, events, parsing, api]


def queries() -> dict:
    return {k: v for p in _PARTS for k, v in p.queries().items()}


def oracle_sql() -> dict:
    return {k: v for p in _PARTS for k, v in p.oracle_sql().items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Papers to typed claims to evidence coverage by source and type."""
    return resolution.evidence_coverage(spark, d)
