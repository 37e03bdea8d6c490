"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gapline.plans import contract_queries, core_queries, further_queries, more_queries, phase_queries, primitive_queries, replay_queries, report_queries, representation_queries, study_queries

MODULES = (core_queries, study_queries, more_queries, primitive_queries, replay_queries, phase_queries, contract_queries, representation_queries, report_queries, further_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return study_queries.flagship(spark, folder)
