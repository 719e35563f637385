"""The core queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.plans import assess, complete, retrieval, upkeep, writes  # noqa: F401 - they register their queries
from memlake.plans.base import ORACLE as CORE_ORACLE
from memlake.plans.base import QUERIES as CORE_QUERIES

__all__ = ["CORE_ORACLE", "CORE_QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CORE_QUERIES["semantic_topk"](spark, sf_dir)
