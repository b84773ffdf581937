"""Registered queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.plans import queries_blocks, queries_chapters, queries_tasks  # noqa: F401
from pageloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all documents: lines as blocks, rules in place of a model, chapters by rules."""
    return QUERIES["extract_questions"](spark, sf_dir)
