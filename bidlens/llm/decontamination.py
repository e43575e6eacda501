"""Benchmark decontamination over a distributed positional inverted index; DataFrame functions only.

An index term is a pair of neighbouring words (a lone word for one-word items), found by a 64-bit hash and
kept with its words, so that a match is one of words. The index stores the postings (row, position) of
those terms that the benchmark uses. Windows that items share are looked for once: the rarest term of
each, by posting count, proposes alignments; the offset-adjusted lists of the terms within the window's
reach are intersected with them, and runs of consecutive matches are the exact phrase occurrences.
Proximity matches start from the rarest terms of a whole item instead, enough of them that no item
with the required share of its terms in one place can do without all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.common import NON_WORD, broadcast_if_small, free_name, last_stored, lower_ascii, materialize, numbered, salted_join, small_enough

#: A vocabulary (8 bytes a term) and its alignments are broadcast up to so many rows, shuffled beyond.
VOCABULARY_ROWS = 1_000_000
#: An item is near a place of a document that has this share of its terms, each at most so many places off.
NEAR_SHARE, NEAR_SLOP = 0.7, 2
_TERM = ["term", "a", "b"]


def words(text: Column) -> Column:
    """Words in order; a null text has none."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(low, NON_WORD), "")


def _pairs(word_list: Column) -> Column:
    rest = F.greatest(F.size(word_list) - 1, F.lit(0))
    return F.zip_with(F.slice(word_list, 1, rest), F.slice(word_list, 2, rest), lambda a, b: F.struct(F.xxhash64(a, b).alias("term"), a.alias("a"), b.alias("b")))


def _lone(word_list: Column) -> Column:
    return F.transform(word_list, lambda w: F.struct(F.xxhash64(w).alias("term"), w.alias("a"), F.lit("").alias("b")))


def benchmark_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored rows item (one number for each row), item_id, w (its words), n, for items that have words."""
    base = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    return materialize(base.withColumn("n", F.size("w")).filter("n > 0"), "benchmark")


def benchmark_terms(items: DataFrame) -> DataFrame:
    """Stored rows item, n (words), terms (how many), j (place), term, a, b of benchmark_words()."""
    listed = F.when(F.col("n") > 1, _pairs(F.col("w"))).otherwise(_lone(F.col("w")))
    return materialize(items.select("item", "n", F.greatest(F.col("n") - 1, F.lit(1)).alias("terms"), F.posexplode(listed).alias("j", "t")).select("item", "n", "terms", "j", "t.*"), "terms")


def positional_index(docs: DataFrame, terms: DataFrame, number: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings row, doc_id, n_words, pos, term, a, b of the benchmark's terms; a null term closes each document.

    `number` names the column that numbers the rows, so repeated or null ids stay apart.
    """
    lone = not terms.filter("b = ''").isEmpty()
    base = docs.select(F.col(number).alias("row"), F.col(id_col).alias("doc_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    end = F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit("").alias("a"), F.lit("").alias("b")))
    listed = F.concat(_pairs(F.col("w")), *([_lone(F.col("w"))] if lone else []), end)
    every = base.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode(listed).alias("at", "t")).select("row", "doc_id", "n_words", "at", "t.*")
    vocabulary = terms.select("term").distinct()
    known = broadcast_if_small(vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit(None).cast("long"))), VOCABULARY_ROWS)
    kept = every.join(known, every["term"].eqNullSafe(known["term"]), "left_semi")
    place = F.when(F.col("b") == "", F.col("at") - F.greatest(F.col("n_words") - 1, F.lit(0))).otherwise(F.col("at"))
    return materialize(kept.select("row", "doc_id", "n_words", place.alias("pos"), *_TERM), "postings")


def _frequencies(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms with the number of their postings."""
    return terms.join(postings.groupBy(*_TERM).agg(F.count(F.lit(1)).alias("freq")), _TERM, "left").fillna(0, ["freq"])


def _of_terms(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings of the terms of anchors, which are stored rows with a freq; a frequent term's are dealt out."""
    if small_enough(anchors, VOCABULARY_ROWS):
        return postings.join(F.broadcast(anchors), _TERM)
    per_term = anchors.groupBy(*_TERM, "freq").agg(F.collect_list(F.struct(*[c for c in anchors.columns if c not in (*_TERM, "freq")])).alias("anchor"))
    return salted_join(postings, materialize(per_term, "anchor-terms"), _TERM, "freq", "row").withColumn("anchor", F.explode("anchor")).select(*postings.columns, "anchor.*", "freq")


def benchmark_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """Stored rows win (its words), item, item_id, j (where it starts in the item), span (its terms)."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    size = F.least(F.col("n"), F.lit(window))
    rows = items.select("item", "item_id", "w", "n", F.explode(starts).alias("j"))
    return materialize(rows.select(F.array_join(F.slice("w", F.col("j") + 1, size), " ").alias("win"), "item", "item_id", "j", F.greatest(size - 1, F.lit(1)).alias("span")), "windows")


def phrase_runs(postings: DataFrame, terms: DataFrame, windows: DataFrame, window: int = 10) -> DataFrame:
    """Stored rows row, item, first, last (document words first..last-1), j, j_last: runs of an item's terms that hold whole windows.

    Of the items that share a window one stands for all, so the runs are those of its surroundings there.
    """
    postings = postings.filter(F.col("term").isNotNull()).select("row", "pos", *_TERM)
    place = Window.partitionBy("item").orderBy("j")
    # A window needs every term, so its rarest one decides.
    rarest = {k: F.min(F.struct("freq", "j", *_TERM)).over(place.rowsBetween(0, k - 1)) for k in range(1, window)}
    counted = _frequencies(postings, terms)
    for k, column in rarest.items():
        counted = counted.withColumn(f"r{k}", column)
    chosen = windows.groupBy("win", "span").agg(F.min(F.struct("item", "j")).alias("c")).select("span", "c.*").join(counted, ["item", "j"])
    chosen = chosen.withColumn("r", F.coalesce(*[F.when(F.col("span") == k, F.col(f"r{k}")) for k in rarest])).filter("r.freq > 0")
    anchors = chosen.groupBy("item", F.col("r.j").alias("at"), *[F.col(f"r.{c}").alias(c) for c in ("freq", *_TERM)]).agg(F.min("j").alias("low"), F.max(F.col("j") + F.col("span") - 1).alias("high"))
    # Terms are looked for within the reach of the windows that an anchor proposes, each once an alignment.
    lines = _of_terms(postings, materialize(anchors, "anchors")).select("row", "item", (F.col("pos") - F.col("at")).alias("diagonal"), "low", "high")
    reach = lines.select("row", "item", "diagonal", F.explode(F.sequence("low", "high")).alias("j")).distinct()
    expected = reach.join(broadcast_if_small(terms, VOCABULARY_ROWS), ["item", "j"]).withColumn("pos", F.col("diagonal") + F.col("j"))
    matched = expected.join(postings, ["row", "pos", *_TERM])
    line = ["row", "item", "diagonal"]
    islands = matched.withColumn("island", F.col("j") - F.row_number().over(Window.partitionBy(*line).orderBy("j")))
    runs = islands.groupBy(*line, "island").agg(F.first("n").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("end"), F.min("j").alias("j"), F.max("j").alias("j_last"))
    least = F.greatest(F.least(F.col("n"), F.lit(window)) - 1, F.lit(1))
    whole = runs.filter(F.col("j_last") - F.col("j") + 1 >= least)
    return materialize(whole.select("row", "item", "first", (F.col("end") + F.when(F.col("n") > 1, 2).otherwise(1)).alias("last"), "j", (F.col("j_last") - least + 1).alias("j_last")), "runs")


def items_of_runs(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows row, item_id: all items that hold a window of a run, each once."""
    starts = runs.select("row", "item", F.explode(F.sequence("j", "j_last")).alias("j"))
    held = starts.join(broadcast_if_small(windows.select("item", "j", "win"), VOCABULARY_ROWS), ["item", "j"]).select("row", "win").distinct()
    return held.join(broadcast_if_small(windows.select("win", "item_id").distinct(), VOCABULARY_ROWS), "win").select("row", "item_id").distinct()


def proximity_matches(postings: DataFrame, terms: DataFrame, slop: int = NEAR_SLOP, share: float = NEAR_SHARE) -> DataFrame:
    """Rows row, item, n_near: items of which at least `share` of the terms stand in one place of a document.

    They stand in one place if the differences of their positions in document and item are within
    2 * slop of each other, so that a few inserted, lost or changed words don't hide a passage; n_near
    is the most terms of an item that do. Of every share + 1 terms one must be there, so a document is
    looked at if it has one of as many of the item's rarest terms.
    """
    postings = postings.filter(F.col("term").isNotNull()).select("row", "pos", *_TERM)
    need = F.ceil(F.col("terms") * share - 1e-9)
    nth = F.row_number().over(Window.partitionBy("item").orderBy("freq", "j"))
    anchors = _frequencies(postings, terms).withColumn("nth", nth).filter((F.col("nth") <= F.col("terms") - need + 1) & (F.col("freq") > 0)).select("item", "freq", *_TERM).distinct()
    asked = _of_terms(postings, materialize(anchors, "near-anchors")).select("row", "item").distinct()
    found = asked.join(postings, "row").join(broadcast_if_small(terms, VOCABULARY_ROWS), ["item", *_TERM]).select("row", "item", "terms", "j", (F.col("pos") - F.col("j")).cast("long").alias("diagonal"))
    here = Window.partitionBy("row", "item").orderBy("diagonal").rangeBetween(0, 2 * slop)
    best = found.withColumn("n_near", F.size(F.collect_set("j").over(here))).groupBy("row", "item", "terms").agg(F.max("n_near").alias("n_near"))
    return best.filter(F.col("n_near") >= need).select("row", "item", "n_near")


def _listed(found: DataFrame) -> DataFrame:
    """Rows row, found: the ids of its items as sorted strings."""
    return found.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("found"))


def _hits(runs: DataFrame) -> DataFrame:
    """Rows row, n_hit: words that runs cover, each once."""
    before = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.select("row", "first", "last").distinct()
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.coalesce(F.max("last").over(before), F.lit(0))))
    return spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256.

    A window is `window` consecutive item words; an item of fewer, but not none, is one window.
    Null and empty texts have no words and no hits. Repeated rows and null doc_ids give a row each.
    Items that share an id count once; an item without id marks words but isn't counted. Without
    documents there are no rows; without items nothing is contaminated. Other columns are not read.
    n_near counts the items with a proximity match, exact or not, and near_sha256 digests their ids as
    items_sha256 does those of exact ones; proximity alone contaminates nothing.
    """
    base = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    known = benchmark_words(base)
    terms, windows = benchmark_terms(known), benchmark_windows(known, window)
    numbers = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The documents are read once: every later step takes its row numbers from the stored postings.
    postings = positional_index(numbers, terms, "row", "doc_id", "text")
    rows = postings.filter(F.col("term").isNull()).select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    runs = phrase_runs(postings, terms, windows, window)
    near = proximity_matches(postings, terms).join(broadcast_if_small(known.select("item", "item_id"), VOCABULARY_ROWS), "item")
    exact, close = _listed(items_of_runs(runs, windows)), _listed(near).withColumnRenamed("found", "near")
    none = F.array().cast("array<string>")
    size = lambda name: F.size(F.coalesce(name, none)).cast("long")
    digest = lambda name: F.sha2(F.array_join(F.coalesce(name, none), ","), 256)
    return (
        rows.join(_hits(runs), "row", "left")
        .join(exact, "row", "left")
        .join(close, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            size("found").alias("n_items"),
            digest("found").alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            size("near").alias("n_near"),
            digest("near").alias("near_sha256"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without any benchmark window, with all their columns; rows are judged one by one, whatever their ids."""
    number = free_name(docs, "row")
    every = numbered(docs, number, "numbered")

    def hit() -> DataFrame:
        known = benchmark_words(items)
        terms = benchmark_terms(known)
        runs = phrase_runs(positional_index(every, terms, number, id_col, text_col), terms, benchmark_windows(known, window), window)
        return materialize(runs.select(F.col("row").alias(number)).distinct(), "contaminated")

    bad = last_stored(docs.sparkSession, hit)
    return every.join(broadcast_if_small(bad, VOCABULARY_ROWS), number, "left_anti").drop(number)
