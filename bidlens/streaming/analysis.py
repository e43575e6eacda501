"""The batch analysis over a stream of tenders, and its sink (K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidlens.plans.analyze import analyze


def append_analyses(df: DataFrame, path: str) -> None:
    """K1: append by variant; a missing return is stored as 0."""
    df.withColumn("roi_percent", F.coalesce("roi_percent", F.lit(0.0))).write.mode("append").partitionBy("variant").parquet(path)


def analyze_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, variant: str = "basic") -> StreamingQuery:
    """Analyse files as they arrive; each batch runs the same projection chain as a table would."""
    stream = spark.readStream.schema(schema).parquet(source)
    return analyze(stream, variant).writeStream.foreachBatch(lambda batch, n: append_analyses(batch, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_user(history: DataFrame, user_id: int) -> tuple[DataFrame, int]:
    """K2: the history without one user's rows, and how many those were."""
    return history.filter(~F.col("user_id").eqNullSafe(F.lit(user_id))), history.filter(F.col("user_id") == user_id).count()
