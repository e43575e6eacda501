"""Corpus preparation: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bidlens.llm.common import discard, materialize, scope, table
from bidlens.llm.decontamination import drop_contaminated
from bidlens.llm.exact_dedup import drop_exact_duplicates
from bidlens.llm.near_dedup import drop_near_duplicates
from bidlens.llm.packing import pack_documents
from bidlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that stayed, with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


_left = threading.local()


def _staged(nth: int, make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; as it begins, what the stage before it stored on its way in this thread goes, for its result has been written by then."""

    @functools.wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if nth and getattr(_left, "nth", None) == nth - 1:
            discard(spark, _left.paths)
        with scope() as paths:
            out = make(spark, docs, sf_dir)
        _left.nth, _left.paths = nth, paths
        return out

    return run_stage


STAGES = [(make.__name__, _staged(nth, make)) for nth, make in enumerate((toxicity, exact_dedup, near_dedup, decontamination, packing))]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope() as result:
            docs = materialize(stage(spark, docs, sf_dir), name)
        # Once a stage's result is stored, nothing reads that of the stage before it any more.
        discard(spark, before)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
