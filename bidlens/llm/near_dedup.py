"""Near-duplicate detection: ProbMinHash signatures of weighted word shingles, banding, exact verification.

Candidates meet in a band's bucket, where each member is compared with the most central member and
with its neighbour in the order of the next band. These links settle most classes with few pairs, but
not all of them. So an exact pass follows: a prefix-filter join of all texts on their rarest shingles
yields every pair that can reach the threshold and whose ends are not in one class yet; each is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.common import broadcast_if_small, free_name, last_stored, materialize, numbered, salted_join
from bidlens.llm.shingles import band_keys, prob_minhash, sequence_digests, shingle_counts, slices, word_hashes

REGISTERS, BAND_ROWS = 128, 4
#: Weights are counts up to this; more repetitions would pull probability Jaccard away from that of the sets.
MOST_WEIGHT = 2
#: Up to so many rows of one or two numbers are broadcast; beyond, both sides are shuffled.
WANTED_ROWS = 2_000_000
#: Shingles are put in order by how often their range of hashes occurs in one row of `SAMPLED`. Any order is exact; a rarest-first one is fast.
RANGES, SAMPLED = 1 << 20, 8
#: A bucket is put in order, and a shingle's list compared, in parts of about so many members.
PART_MEMBERS = 5000
#: Pairs are first looked at with 32-bit hashes, and those within this of the threshold are verified with 64-bit ones.
ROUGHLY = 0.01
#: Against rounding: bounds are loosened by so much, and what passes is verified.
SLACK = 1e-6


def _batches(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def _ranges(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(44)).astype(np.int64)


def commonness(rows: DataFrame, words: int = 5) -> np.ndarray:
    """How often each range of shingle hashes occurs in a sample of the texts."""
    texts = rows.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RANGES, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                counts += np.bincount(_ranges(shingle_counts(*word_hashes(part), words)[1]), minlength=RANGES)
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 100_000):
            yield _batches([pa.array(some[at : at + 100_000]), pa.array(counts[some[at : at + 100_000]])], ["range", "n"])

    rows = texts.select("text").mapInArrow(tally, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RANGES, np.int32)
    out[rows["range"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 2**31 - 1)
    return out


def rarest_shingles(text: np.ndarray, shingle: np.ndarray, texts: int, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's prefix begins and ends (texts + 1 numbers), and the prefixes' shingles, rarest first.

    Two sets of Jaccard similarity `threshold` have their first common shingle in both prefixes.
    """
    order = np.lexsort((shingle, common[_ranges(shingle)], text))
    n = np.bincount(text, minlength=texts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(n, n - np.ceil(threshold * n - SLACK).astype(np.int64) + 1)
    return np.append(0, np.cumsum(size)), shingle[order][place < np.repeat(size, n)]


def signatures(rows: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """Stored rows row, doc_id, low, high (digest of the word sequence), n (distinct shingles), bands, prefix of rows row, doc_id, text."""
    common = rows.sparkSession.sparkContext.broadcast(commonness(rows, words))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(2)):
                hashes, bounds = word_hashes(part)
                text, shingle, count = shingle_counts(hashes, bounds, words)
                keys = band_keys(prob_minhash(text, shingle, np.minimum(count, MOST_WEIGHT).astype(float), len(part), REGISTERS), BAND_ROWS)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                ends, rarest = rarest_shingles(text, shingle, len(part), common.value, threshold)
                digests = sequence_digests(part)
                yield _batches(
                    [
                        batch.column(0).slice(at, len(part)),
                        batch.column(1).slice(at, len(part)),
                        pa.array(np.ascontiguousarray(digests[:, 0])),
                        pa.array(np.ascontiguousarray(digests[:, 1])),
                        pa.array(np.bincount(text, minlength=len(part)).astype(np.int64)),
                        bands,
                        pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(rarest.view(np.int64))),
                    ],
                    ["row", "doc_id", "low", "high", "n", "bands", "prefix"],
                )
                at += len(part)

    return materialize(rows.select("row", "doc_id", "text").mapInArrow(sign, f"row long, doc_id {kind}, low long, high long, n long, bands array<long>, prefix array<long>"), "signatures")


def _shingle_sets(rows: DataFrame, wanted: DataFrame, words: int, bits: int) -> DataFrame:
    """Stored rows row, pairs, shingles (distinct, as hashes of 32 or 64 bits) of the wanted rows row, pairs."""
    whole = bits == 64
    base = rows.join(broadcast_if_small(wanted, WANTED_ROWS), "row").select("row", "pairs", "text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(2)):
                text, shingle, _ = shingle_counts(*word_hashes(part), words)
                ends = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
                yield _batches([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.ListArray.from_arrays(ends, pa.array(shingle.view(np.int64) if whole else (shingle >> np.uint64(32)).astype(np.uint32).view(np.int32)))], ["row", "pairs", "shingles"])
                at += len(part)

    return materialize(base.mapInArrow(collect, f"row long, pairs long, shingles array<{'long' if whole else 'int'}>"), "shingles")


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Rows a, b: pairs to verify, from the buckets of all bands."""
    cells = reps.select("row", "n", F.posexplode("bands").alias("band", "key"), "bands").select("row", "n", "key", F.element_at("bands", F.pmod(F.col("band") + 1, F.lit(REGISTERS // BAND_ROWS)) + 1).alias("next"))
    shared = materialize(cells.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    cells = materialize(salted_join(cells, shared, ["key"], "members", "row"), "cells")
    # The more company a text has over all its bands, the more central it is.
    central = cells.groupBy("row").agg(F.sum("members").alias("company"))
    ranked = cells.join(central, "row")
    leaders = materialize(ranked.groupBy("key").agg(F.max_by(F.struct("row", "n"), F.struct("company", "row")).alias("leader"), F.first("members").alias("size")), "leaders")
    to_leader = salted_join(cells, leaders, ["key"], "size", "row").select("row", "n", F.col("leader.row").alias("other"), F.col("leader.n").alias("other_n"))
    # Neighbours in the order of the next band; a large bucket is put in order in parts.
    part = F.pmod(F.col("next"), F.floor(F.col("members") / PART_MEMBERS) + 1)
    neighbour = F.lag(F.struct("row", "n")).over(Window.partitionBy("key", "part").orderBy("next", "row"))
    to_neighbour = cells.withColumn("part", part).withColumn("left", neighbour).filter("left is not null").select("row", "n", F.col("left.row").alias("other"), F.col("left.n").alias("other_n"))
    pairs = to_leader.unionByName(to_neighbour).filter("row != other")
    pairs = pairs.filter(F.least("n", "other_n") >= threshold * F.greatest("n", "other_n"))
    return pairs.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()


def _unsettled(reps: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Rows a, b: all pairs of different classes so far that can reach the threshold.

    If two sets are that similar, then after their first common shingle, at places i and j of the
    order, enough shingles are left in both for the overlap. A list in which one class leads is not
    paired within that class, so large classes cost no more than their members. The members of a long
    list are dealt out in parts, and each member outside the leading class is sent to all of them.
    """
    cells = reps.join(roots.withColumnRenamed("node", "row"), "row", "left").select("row", "n", F.coalesce("root", "row").alias("root"), F.posexplode("prefix").alias("place", "shingle"))
    split = cells.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("members"))
    split = materialize(split.filter("least != most").select("shingle", "members"), "split")
    cells = materialize(salted_join(cells, split, ["shingle"], "members", "row", most_rows=WANTED_ROWS), "lists")
    shares = cells.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("share"))
    lead = materialize(shares.groupBy("shingle").agg(F.max_by("root", F.struct("share", "root")).alias("lead"), F.sum("share").alias("size")), "leads")
    parts = F.floor(F.col("members") / PART_MEMBERS).cast("int")
    left = salted_join(cells, lead, ["shingle"], "size", "row").filter("root != lead").select("shingle", "lead", F.explode(F.sequence(F.lit(0), parts)).alias("part"), *[F.col(c).alias(f"a_{c}") for c in ("row", "n", "root", "place")])
    both = left.join(cells.withColumn("part", F.pmod(F.xxhash64("row"), parts + 1).cast("int")), ["shingle", "part"]).filter("a_root != root and (root = lead or a_row < row)")
    need = F.lit(threshold) * (F.col("n") + F.col("a_n")) - SLACK
    both = both.filter((F.least("n", "a_n") >= threshold * F.greatest("n", "a_n") - SLACK) & (F.least(F.col("n") - F.col("place"), F.col("a_n") - F.col("a_place")) * (1 + threshold) >= need))
    return both.select(F.least("row", "a_row").alias("a"), F.greatest("row", "a_row").alias("b")).distinct()


def _similar(rows: DataFrame, pairs: DataFrame, words: int, threshold: float, bits: int) -> DataFrame:
    """Stored rows a, b: the pairs, stored, whose sets of hashes are of at least that similarity."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("pairs")), "wanted")
    sets = _shingle_sets(rows, wanted, words, bits)
    side = lambda end: sets.select(F.col("row").alias(end), F.col("shingles").alias(f"s{end}"), F.col("pairs").alias(f"pairs_{end}"))
    found = salted_join(salted_join(pairs, side("b"), ["b"], "pairs_b", "a", most_rows=0), side("a"), ["a"], "pairs_a", "b", most_rows=0).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return materialize(found.filter(F.col("common") >= threshold * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"), "links")


def _links(rows: DataFrame, pairs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Stored rows a, b: the pairs, stored, of at least that similarity."""
    rough = last_stored(rows.sparkSession, lambda: _similar(rows, pairs, words, threshold - ROUGHLY, 32))
    return last_stored(rows.sparkSession, lambda: _similar(rows, rough, words, threshold, 64))


def components(edges: DataFrame) -> DataFrame:
    """Rows node, root: the smallest node of each connected component of edges a, b.

    Labels spread along the edges and are then looked up once more (label of the label), so the
    number of rounds grows with the logarithm of a component's width. Each round is stored.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count(F.lit(1)).alias("degree")), "labels")
    while True:
        ends = labels.select(F.col("node").alias("b"), "root", "degree")
        spread = salted_join(both, ends, ["b"], "degree", "a").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = materialize(labels.join(spread, "node").select("node", "degree", F.col("root").alias("was"), F.least("root", "near").alias("near")), "near")
        # The label of the label: one row for each label, however many nodes bear it.
        jump = nearer.groupBy("near").agg(F.count(F.lit(1)).alias("bearers")).join(labels.select(F.col("node").alias("near"), F.col("root").alias("far")), "near")
        after = materialize(salted_join(nearer, materialize(jump, "jumps"), ["near"], "bearers", "node").select("node", "degree", "was", F.least("near", "far").alias("root")), "labels")
        if after.filter("was != root").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root", "degree")


def classes(rows: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows row, doc_id, class_id, class_size, stays of stored rows row, doc_id, text.

    `stays` marks one row of each class: that of the smallest doc_id (nulls last), the first of several.
    """
    spark = rows.sparkSession
    signed = signatures(rows, words, threshold)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    worded = signed.filter("n > 0")
    # Equal word sequences: one row stands for all of them.
    copies = materialize(worded.groupBy("low", "high").agg(F.min("row").alias("rep"), F.min(first).alias("first"), F.count(F.lit(1)).alias("copies")), "copies")
    reps = signed.join(copies.select(F.col("rep").alias("row")), "row", "left_semi")
    # What a step stored on its way goes as soon as its result is stored, so that disks hold little at a time.
    pairs = last_stored(spark, lambda: materialize(_candidates(reps, threshold), "pairs"))
    edges = _links(rows, pairs, words, threshold)
    roots = last_stored(spark, lambda: components(edges))
    rest = last_stored(spark, lambda: materialize(_unsettled(reps, roots, threshold), "rest"))
    if not rest.isEmpty():
        more = _links(rows, rest, words, threshold)
        if not more.isEmpty():
            roots = last_stored(spark, lambda: components(edges.union(more)))
    placed = materialize(copies.join(roots, copies["rep"] == roots["node"], "left").select("low", "high", "first", "copies", F.coalesce("root", "rep").alias("root")), "placed")
    sizes = materialize(placed.groupBy("root").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")), "classes")
    known = materialize(salted_join(placed.drop("first"), sizes, ["root"], "texts", "low").select("low", "high", "copies", "best", "class_size"), "known")
    found = salted_join(worded, known, ["low", "high"], "copies", "row").select("row", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("stays"))
    alone = signed.filter("n = 0").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    Two texts are linked if the Jaccard similarity of their sets of `words`-word shingles is at least
    `threshold`; classes are the connected components, named by their smallest doc_id. Texts with the
    same words in the same order are one class without comparison. Null texts and texts without words
    are each a class of their own. Rows with a null id take part; a class of them alone has class_id
    null. Repeated rows are one class and all have its smallest id, so all are kept. An empty table
    gives no rows; columns other than the two named are not read.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row", "numbered")
    return classes(rows, words, threshold).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id (nulls last), the first of several.

    Rows are judged one by one: another row of the same id, or one without id, goes or stays by its own text.
    """
    number = free_name(docs, "row")
    every = numbered(docs, number, "numbered")
    rows = every.select(F.col(number).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = last_stored(docs.sparkSession, lambda: materialize(classes(rows, words, threshold).filter("not stays").select(F.col("row").alias(number)), "near-gone"))
    return every.join(broadcast_if_small(gone, WANTED_ROWS), number, "left_anti").drop(number)
