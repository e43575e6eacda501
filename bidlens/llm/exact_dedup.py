"""Exact deduplication by stateful streaming over text digests.

Texts go into a content store, one folder a call. A stream reads the digests of new rows from it and
feeds keyed state, which lives in RocksDB (disk-backed), has no watermark and so never expires. For every
digest the state retains the smallest stable identifier, the place of that row in the store (content
locator) and the number of rows; keep_id and group_size come from it. On a hit (a digest seen before)
the full bytes at the locator are read and compared. With a state path of its own, all of it outlasts
the call, and later calls find copies of earlier texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import broadcast_if_small, free_name, last_stored, materialize, numbered, salted_join, shared_path

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition reserves 4 MB for its manifest
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else each partition's store stays in its executor's memory
}


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized_text(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _run_stream(content: DataFrame, state_path: str, call: str, files_per_batch: int) -> DataFrame:
    """Feed what is new in the content store through the keyed state; stored rows digest, first, group_size as this call left them."""
    spark = content.sparkSession
    updates = f"{state_path}/updates/{call}"
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        # The first by id, those without id last; equal ids by place.
        first = F.struct(F.col("id").isNull().alias("nameless"), "id", "call", "row")
        seen = (
            spark.readStream.schema(content.select("row", "id", "digest", "call").schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{state_path}/content")
            .groupBy("digest")
            .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        )
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_path}/checkpoint")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{updates}/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    changed = spark.createDataFrame([], seen.schema) if query.lastProgress is None else spark.read.option("basePath", updates).parquet(f"{updates}/batch=*")
    # A digest of several batches counts on, and its first row only ever becomes an earlier one.
    return materialize(changed.groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size")), "dedup-state")


def _verdicts(rows: DataFrame, digest: Callable[[Column], Column], state_path: str | None, files_per_batch: int, broadcast_rows: int) -> DataFrame:
    """Rows row, id, keep_id, group_size, text_sha256, stays of rows row, id, text; `stays` marks one row of each group."""
    spark = rows.sparkSession
    state_path = (state_path or shared_path(spark, "dedup")).rstrip("/")
    call = f"{time.time_ns():020d}"
    norm = normalized_text(F.col("text"))
    rows.select("row", "id", digest(norm).alias("digest"), norm.alias("norm")).write.parquet(f"{state_path}/content/call={call}")
    content = spark.read.option("basePath", f"{state_path}/content").schema(f"row long, id {rows.schema['id'].dataType.simpleString()}, digest string, norm string, call string").parquet(f"{state_path}/content")
    mine = content.filter(F.col("call") == call)
    known = _run_stream(content, state_path, call, files_per_batch)

    hit = materialize(known.filter("group_size > 1"), "dedup-hits")
    # Full bytes settle each hit: those of this call's rows, and those at the locators in earlier calls' folders.
    places = hit.filter(F.col("first.call") != call).select("digest", F.col("first.call").alias("call"), F.col("first.row").alias("row"))
    earlier = [row["call"] for row in places.select("call").distinct().collect()]
    bytes_of = mine.select("digest", "norm").join(broadcast_if_small(hit.select("digest"), broadcast_rows), "digest", "left_semi")
    if earlier:
        located = content.filter(F.col("call").isin(earlier)).join(broadcast_if_small(places, broadcast_rows), ["digest", "call", "row"], "left_semi")
        bytes_of = bytes_of.unionByName(located.select("digest", "norm"))
    # Copies collapse within every task before the shuffle, so a hot group stays small.
    texts = bytes_of.groupBy("digest", "norm").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clashing = materialize(texts.filter("texts > 1").select("digest"), "dedup-clashes")

    place = F.struct("call", "row")
    narrow = mine.select("row", "id", "digest", "call", *([] if digest is sha256_text else [F.sha2("norm", 256).alias("text_sha256")]))
    out = salted_join(narrow, hit, ["digest"], "group_size", "row", "left").withColumn("first", F.coalesce("first", F.struct(F.lit(False).alias("nameless"), "id", "call", "row")))
    if digest is sha256_text:
        out = out.withColumn("text_sha256", F.col("digest"))
    if not clashing.isEmpty():
        # Different texts under one digest: the rows of these alone, of all calls, are keyed by their whole text.
        first = F.struct(F.col("id").isNull().alias("nameless"), "id", "call", "row")
        apart = content.join(F.broadcast(clashing) if clashing.count() <= broadcast_rows else clashing, "digest", "left_semi")
        keyed = apart.groupBy("digest", "norm").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        split = apart.filter(F.col("call") == call).join(keyed, ["digest", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        columns = ["row", "id", "call", "digest", "first", "group_size", "text_sha256"]
        out = out.join(clashing, "digest", "left_anti").select(columns).unionByName(split.select(columns))
    return out.select("row", "id", F.col("first.id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", (place == F.struct("first.call", "first.row")).alias("stays"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_text,
    files_per_batch: int = 1000,
    broadcast_rows: int = 400_000,
    state_path: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; the row with the smallest id stays.
    Null and empty texts are equal to each other. Rows with a null id take part and are kept only
    where a whole group has no id. Repeated rows (same id and text) all count in group_size and
    are all kept, for they are one document. An empty table gives no rows; columns other than the
    two named are not read, so their names don't matter.

    With `state_path`, a folder all executors share, texts of earlier calls with that path count as
    well: a row is kept if none so far has an equal text and a smaller id, and group_size covers all
    calls up to this one. Rows of a call that failed half-way count as seen. Ids keep one type.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = _verdicts(rows, digest, state_path, files_per_batch, broadcast_rows)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_path: str | None = None) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest id (nulls last), the first of several.

    Rows are judged one by one: another row of the same id, or one without id, goes or stays by its own text.
    """
    number = free_name(docs, "row")
    every = numbered(docs, number, "numbered")
    rows = every.select(F.col(number).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # A state of this call alone goes once the rows to drop are stored.
    gone = last_stored(docs.sparkSession, lambda: materialize(_verdicts(rows, sha256_text, state_path, 1000, 400_000).filter("not stays").select(F.col("row").alias(number)), "dedup-gone"))
    return every.join(broadcast_if_small(gone, 1_000_000), number, "left_anti").drop(number)
