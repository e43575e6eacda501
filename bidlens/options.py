"""Limits that a session can set."""

from __future__ import annotations

from pyspark.sql import SparkSession


def int_option(spark: SparkSession, name: str, default: int) -> int:
    """The session's setting as a whole number; the default where it is unset, blank or no number."""
    try:
        return int(spark.conf.get(name, None) or default)
    except ValueError:
        return default
