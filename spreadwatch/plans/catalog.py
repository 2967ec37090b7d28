"""Every registered query of the core library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spreadwatch.plans import basics, research, windows  # noqa: F401  they register their queries
from spreadwatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored spread of the flagship pair."""
    return QUERIES["wn_rolling_z"](spark, sf_dir)
