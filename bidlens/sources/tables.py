"""Relational scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For much work on each row: rows are dealt out anew only where they come in fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def _sha256(rows: DataFrame) -> Column:
    """SHA-256 of a row: equal for rows that distinct() takes as equal, and never null, as a join would work out a null's filter besides."""

    def said(field: Y.StructField) -> Column:
        value, kind = F.col(field.name), field.dataType
        if isinstance(kind, (Y.StructType, Y.ArrayType, Y.MapType)):
            value = F.to_json(F.struct(value))
        elif isinstance(kind, (Y.FloatType, Y.DoubleType)):
            value = F.when(value == 0, F.lit(0).cast(kind)).otherwise(value)  # there is a zero below zero, too
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.coalesce(F.unhex(F.sha2(F.concat(*[said(field) for field in rows.schema]), 256)), F.lit(bytearray()))


def once(rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make() of rows by key, worked out once for all rows that differ in their key alone, as copies of a text do.

    make() gets the distinct rows without the key, and a column `of` instead that it must keep: their
    SHA-256, by which the results are joined back. It gives any number of rows for each of its own; what unfolds
    lists belongs there, too, where it is done once a text and not once a row.
    """
    said = [c for c in rows.columns if c != key]
    mark = _sha256(rows.select(*said))
    # A task takes up to a second to get make()'s long expressions ready, so there are no more tasks than keep all cores busy.
    session = rows.sparkSession
    parts = min(int(session.conf.get("spark.sql.shuffle.partitions")), max(24, 3 * session.sparkContext.defaultParallelism))
    each = rows.select(*said).distinct().withColumn("of", mark).repartition(parts, "of")
    return rows.select(key, mark.alias("of")).join(make(each), "of").drop("of")
