"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that make up a word once A-Z are lower-cased; everything else separates words.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A key is hot if it holds more than this share of all rows: so there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
#: Rows of a hot key are dealt out over so many parts.
SALTS = 32

_scopes = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table. Its rows are dealt out anew only where they come in fewer partitions than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; where none is named, a temporary one on one machine only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="bidlens-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/bidlens-{label}-{uuid.uuid4().hex}"
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write as Parquet to the shared folder and read it again."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Gathers the paths that this thread hands out until the scope ends, those of scopes within left out; nothing is deleted by it."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield _scopes.open[-1]
    finally:
        _scopes.open.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate data that nothing reads any more."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def last_stored(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, which is what it stored last; what it stored on its way is deleted, and so is all of it if make() fails."""
    with scope() as paths:
        try:
            out = make()
        except BaseException:
            discard(spark, paths)
            raise
    discard(spark, paths[:-1])
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1].extend(paths[-1:])
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """df with a number for each row, stored: a second scan or a retried task could number the rows otherwise."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), label)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, as locale and other scripts must not matter."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, limit: int) -> bool:
    """True if df has at most `limit` rows; the check itself reads no more than that from each partition."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only behind a counted size; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if small_enough(df, limit) else df


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], count: str, spread: str, how: str = "inner", most_rows: int = 1_000_000) -> DataFrame:
    """Join big with small, which is stored, has one row a key and says in `count` how many rows of big that key has.

    Up to `most_rows` rows, counted, small is broadcast. Beyond, both are shuffled, and rows of a hot key
    dealt out by the hash of their `spread` column, with small's row of that key repeated for each part, so
    no task gets them all. The list of hot keys that is then broadcast has at most 1 / HOT_SHARE rows, as
    each holds more than that share of the sum of `count`.
    """
    if small_enough(small, most_rows):
        return big.join(F.broadcast(small), keys, how)
    hot = F.col(count) > small.agg(F.sum(count)).first()[0] * HOT_SHARE
    dealt = big.join(F.broadcast(small.filter(hot).select(*keys, F.lit(SALTS).alias("_salts"))), keys, "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
