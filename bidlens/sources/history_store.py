"""The analysis history as Parquet by month: append (K1), delete by rewriting touched months only (K2), JSON rows (K3), failure report (K4)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletions are joined by these columns, as far as they name them.
KEYS = ("user_id", "id")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path that driver and executors share; a temporary folder only where Spark runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="bidlens-")
    return f"{base.rstrip('/')}/bidlens-{label}-{uuid.uuid4().hex}"


def _by_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("created_at", "yyyy-MM"))


def append(df: DataFrame, path: str) -> None:
    """K1: rows with created_at go to the folder of their month; a missing return is stored as 0. Rows of one month are brought together, so that a month isn't many small files."""
    stored = df.withColumn("roi", F.coalesce("roi", F.lit(0.0))) if "roi" in df.columns else df
    _by_month(stored).repartition("month").write.mode("append").partitionBy("month").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history; a filter on month reads that month's folder only."""
    return spark.read.option("basePath", path).schema(spark.read.parquet(path).schema).parquet(path).withColumn("month", F.col("month").cast("string"))


def delete(spark: SparkSession, path: str, doomed: DataFrame) -> DataFrame:
    """K2: delete the rows that `doomed` names by user_id, id or both; one row per touched month: month, n_before, n_removed.

    Only months that hold such a row are rewritten, each in one step: a reader sees a month as it was
    or as it is. A month that loses all its rows goes as a folder. Null keys name nothing, and repeated ones once.
    """
    keys = [name for name in KEYS if name in doomed.columns]
    named = doomed.select(*keys).dropna().distinct().withColumn("_doomed", F.lit(True))
    marked = read(spark, path).join(named, keys, "left").withColumn("_doomed", F.col("_doomed").isNotNull())
    counts = marked.groupBy("month").agg(F.count(F.lit(1)).alias("n_before"), F.count_if("_doomed").alias("n_removed")).filter("n_removed > 0")
    touched = counts.orderBy("month").collect()  # one row a month
    rewritten = [row["month"] for row in touched if row["n_removed"] < row["n_before"]]
    if rewritten:
        kept = read(spark, path).filter(F.col("month").isin(rewritten)).join(named, keys, "left_anti")
        kept.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for row in touched:
        if row["n_removed"] == row["n_before"]:
            folder = hadoop(f"{path}/month={row['month']}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.createDataFrame(touched, counts.schema)


def as_json(columns: dict[str, Column]) -> Column:
    """K3: one JSON object; missing values stay as nulls."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in columns.items()]), {"ignoreNullFields": "false"})


def failures(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """K4: of rows k, mode, truth_* and found_* those that fail, with the failed checks and a JSON row of both sides.

    A price may be off by `tolerance`; terms and flags must be equal, and what is missing is wrong.
    """
    facts = [name.removeprefix("truth_") for name in df.columns if name.startswith("truth_")]

    def passes(fact: str) -> Column:
        found, truth = F.col(f"found_{fact}"), F.col(f"truth_{fact}")
        return F.coalesce(F.abs(found - truth) <= truth * tolerance if fact == "nmck" else found == truth, F.lit(False))

    failed = F.array_compact(F.array(*[F.when(~passes(fact), fact) for fact in facts]))
    side = lambda prefix: F.struct(*[F.col(f"{prefix}_{fact}").alias(fact) for fact in facts])
    told = as_json({"k": F.col("k"), "mode": F.col("mode"), "truth": side("truth"), "extracted": side("found")})
    return df.withColumn("failed", failed).filter(F.size("failed") > 0).select("k", "mode", F.array_join("failed", "|").alias("failed"), told.alias("report"))


def write_failures(report: DataFrame, path: str) -> None:
    """K4: the report as JSON lines."""
    report.write.mode("overwrite").json(path)
