"""Toxicity: logistic regression over hashed words, regularised by counterfactuals.

Each labelled text that names an identity group is written anew with other groups of the same kind, and
its features are taken again. The squared change of its score (as log-odds, which bounds that of the
probability) is part of the loss, so that naming a group moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.language_id import fold
from bidlens.llm.shingles import mix, shingle_counts, slices, word_hashes

BUCKETS = 1 << 18
#: 0 stands for whole words; inflected and compound forms share their beginnings.
PREFIXES = (0, 5, 7)
#: Identity terms in lower case by kind and language; within a kind any term can stand for any other.
IDENTITY_TERMS = {
    "religion": ["atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "muslim", "protestant", "sikh"],
    "religion_plural": ["atheists", "buddhists", "catholics", "christians", "hindus", "jews", "muslims", "protestants", "sikhs"],
    "gender": ["female", "male", "nonbinary", "transgender"],
    "gender_plural": ["girls", "boys", "men", "women"],
    "orientation": ["bisexual", "gay", "heterosexual", "lesbian", "straight"],
    "origin": ["african", "american", "arab", "asian", "black", "chinese", "european", "indian", "latino", "mexican", "white"],
    "status": ["citizens", "foreigners", "immigrants", "migrants", "refugees", "residents"],
    "de_religion": ["atheisten", "buddhisten", "christen", "juden", "katholiken", "muslime", "protestanten"],
    "de_gender": ["frauen", "männer", "mädchen", "jungen"],
    "de_orientation": ["bisexuelle", "heterosexuelle", "homosexuelle", "lesben", "schwule"],
    "de_origin": ["afrikaner", "amerikaner", "araber", "asiaten", "chinesen", "deutsche", "europäer", "inder", "türken"],
    "de_status": ["ausländer", "bürger", "einwanderer", "flüchtlinge", "migranten"],
    "fr_religion": ["athées", "bouddhistes", "catholiques", "chrétiens", "hindous", "juifs", "musulmans"],
    "fr_gender": ["femmes", "filles", "garçons", "hommes"],
    "fr_orientation": ["bisexuels", "gays", "hétérosexuels", "homosexuels", "lesbiennes"],
    "fr_origin": ["africains", "américains", "arabes", "asiatiques", "chinois", "européens", "français", "indiens"],
    "fr_status": ["citoyens", "étrangers", "immigrés", "migrants", "réfugiés"],
    "es_religion": ["ateos", "budistas", "católicos", "cristianos", "hindúes", "judíos", "musulmanes"],
    "es_gender": ["chicas", "chicos", "hombres", "mujeres"],
    "es_orientation": ["bisexuales", "gays", "heterosexuales", "homosexuales", "lesbianas"],
    "es_origin": ["africanos", "americanos", "árabes", "asiáticos", "chinos", "españoles", "europeos", "indios"],
    "es_status": ["ciudadanos", "extranjeros", "inmigrantes", "migrantes", "refugiados"],
}
#: A word as the features see it: bytes from 0x80 up belong to words.
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SCHEMA = "label int, buckets array<int>, swaps int, swap array<int>, changed array<int>"
_MODEL = tuple[np.ndarray, float]


def features(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers (ascending) and buckets of the distinct words and word beginnings (in bytes)."""
    found = [shingle_counts(*word_hashes(part, prefix), 1)[:2] for prefix in PREFIXES]
    text = np.concatenate([t for t, _ in found])
    key = np.concatenate([mix(w + np.uint64(prefix)) >> np.uint64(46) for (_, w), prefix in zip(found, PREFIXES, strict=True)])
    order = np.argsort(text, kind="stable")
    return text[order], key[order].astype(np.int64)


def swapped(text: str) -> Iterator[str]:
    """The text with its identity terms of one kind replaced by others, for each kind it names and each turn of that kind's list.

    All terms of the kind turn together, so that what the text says of two groups stays said of two. There
    are at most as many results as there are terms in the lists, however long the text.
    """
    words = {word.lower() for word in _WORD.findall(text)}
    for terms in IDENTITY_TERMS.values():
        place = {term: k for k, term in enumerate(terms)}
        if words.isdisjoint(place):
            continue
        for turn in range(1, len(terms)):
            yield _WORD.sub(lambda m: terms[(k + turn) % len(terms)] if (k := place.get(m[0].lower())) is not None else m[0], text)  # noqa: B023


def learnable(labels: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """What is learned from labelled texts: label, buckets, number of swaps, and for each bucket that a swap changes
    which swap it is and the bucket, as it is if the swap brings it and inverted (~) if the swap takes it away."""
    text, bucket = features(texts)
    ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    swaps, swap, changed, sizes = [], [], [], [0]
    for row, value in enumerate(texts.to_pylist()):
        own, n = bucket[ends[row] : ends[row + 1]], 0
        for other in swapped(value or ""):
            new = features(pa.array([other]))[1]
            changes = np.concatenate([np.setdiff1d(new, own), ~np.setdiff1d(own, new)])
            swap.append(np.full(len(changes), n, np.int32))
            changed.append(changes.astype(np.int32))
            n += 1
        swaps.append(n)
        sizes.append(sizes[-1] + sum(map(len, changed[len(changed) - n :])))
    flat = lambda parts: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
    buckets = pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32)))
    return pa.RecordBatch.from_arrays([labels, buckets, pa.array(swaps, pa.int32()), flat(swap), flat(changed)], ["label", "buckets", "swaps", "swap", "changed"])


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str, text_col: str, label_col: str, label_id_col: str) -> pa.Table:
    """learnable() of at most `most_rows` labelled texts, those of smallest hashed id, so that the choice is even and repeatable.

    The driver gets at most so many lists, each of distinct buckets, of which there are BUCKETS.
    """
    known = labels.filter(F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                yield learnable(batch.column(0).slice(at, len(part)), part)
                at += len(part)

    return texts.mapInArrow(extract, _SCHEMA).toArrow()


def fit(rows: pa.Table, ridge: float = 0.01, fairness: float = 1.0, least_texts: int = 4, least_chi_square: float = 3.0, rounds: int = 200) -> _MODEL:
    """Weights by bucket and an intercept, by accelerated gradient descent on the mean loss.

    `ridge` is the penalty on squared weights per 1000 texts; `fairness` that on squared changes of the
    score of a text when its terms are swapped, averaged over the swaps of each text. Words in fewer than `least_texts` texts,
    or whose chi-square against the label is below `least_chi_square`, get no weight. Without rows, or with one label only, the intercept alone is fitted.
    """
    label = rows["label"].to_numpy().astype(float)
    weights = np.zeros(BUCKETS)
    share = (label.sum() + 1) / (len(label) + 2)
    bias = float(np.log(share / (1 - share)))
    if not len(label) or label.min() == label.max():
        return weights.astype(np.float32), bias
    lists = rows["buckets"].combine_chunks()
    bucket = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(label), dtype=np.int32), lists.value_lengths().to_numpy())
    # A word's value in a text is its correlation with the label, so the ridge spares the words that tell most.
    spread = np.bincount(bucket, minlength=BUCKETS) / len(label)
    joint = np.bincount(bucket[label[row] == 1], minlength=BUCKETS) / len(label)
    rate = label.mean()
    value = np.abs(joint - spread * rate) / np.sqrt(np.maximum(spread * (1 - spread), 1e-9) * rate * (1 - rate))
    telling = (value**2 * len(label) >= least_chi_square) & (spread * len(label) >= least_texts)
    # What a swap changes is always fitted; a bucket in none of the texts has no weight, before a swap or after.
    changed = rows["changed"].combine_chunks().flatten().to_numpy()
    gained = changed >= 0
    touched = np.where(gained, changed, ~changed)
    telling[touched] |= spread[touched] > 0
    names = np.flatnonzero(telling)
    number = np.zeros(BUCKETS, np.int32)
    number[names] = np.arange(len(names))
    kept = telling[bucket]
    row, column = row[kept], number[bucket[kept]]
    del bucket, kept, lists
    spread, value = spread[names], value[names]
    cell = value[column].astype(np.float32)
    swaps = rows["swaps"].to_numpy()
    first = np.cumsum(swaps) - swaps
    swap = np.repeat(first, rows["changed"].combine_chunks().value_lengths().to_numpy()) + rows["swap"].combine_chunks().flatten().to_numpy()
    often = np.repeat(1 / np.maximum(swaps, 1), swaps) / len(label)
    known = telling[touched]
    swap, part = swap[known], number[touched[known]]
    shift = np.where(gained[known], 1.0, -1.0) * value[part]
    w, ahead, momentum = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 1.0
    w[-1] = ahead[-1] = bias
    size = np.sqrt((np.bincount(row, weights=cell**2, minlength=len(label)) + 1).mean())
    step = 1 / (0.25 * size + ridge / 1000 + 2 * fairness * float((often[swap] * shift**2).sum()))
    for _ in range(rounds):
        logit = np.bincount(row, weights=cell * ahead[column], minlength=len(label)) + ahead[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) / len(label)
        slope = np.append(value * np.bincount(column, weights=error[row], minlength=len(names)), error.sum())
        slope[:-1] += ridge / 1000 * ahead[:-1]
        if len(often):
            change = 2 * fairness * often * np.bincount(swap, weights=shift * ahead[part], minlength=len(often))
            slope[:-1] += np.bincount(part, weights=change[swap] * shift, minlength=len(names))
        after = ahead - step * slope
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = after + (momentum - 1) / faster * (after - w)
        w, momentum = after, faster
    weights[names] = w[:-1] * value
    return weights.astype(np.float32), float(w[-1])


def _logits(part: pa.Array, model: _MODEL) -> np.ndarray:
    weights, bias = model
    text, bucket = features(part)
    return np.bincount(text, weights=weights[bucket], minlength=len(part)) + bias


def _probability(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def score(docs: DataFrame, model: _MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, score. Only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(_probability(_logits(part, sent.value)))], ["doc_id", "score"])
                at += len(part)

    return base.mapInArrow(rate, f"doc_id {kind}, score double")


def assess(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    held: int = 0,
    most_rows: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    label_id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels of fold `held` are never learned from; `most_rows` bounds the labelled texts that are.
    Null and empty texts get the score of a text without words. Rows with a null id are scored,
    neither learned from nor held out. Repeated rows get a row each; a text with several labels counts
    as toxic if one says so. Without labels the score is that of the prior, 0.5.
    """
    rows = training_rows(docs, labels.filter(fold(label_id_col, folds) != held), most_rows, id_col, text_col, label_col, label_id_col)
    out = score(docs, fit(rows), id_col, text_col)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, threshold: float = 0.5, folds: int = 5, held: int = 0, most_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; no row's id plays a part in its score.

    Null and empty texts score as in assess(). `learn_from` holds the labelled texts (default: docs).
    """
    known = labels.filter(fold("doc_id", folds) != held)
    rows = training_rows(docs if learn_from is None else learn_from, known, most_rows, id_col, text_col, "toxic", "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows))

    @F.arrow_udf("double")
    def text_score(texts: pa.Array) -> pa.Array:
        found = [_logits(part, sent.value) for part in slices(texts)]
        return pa.array(_probability(np.concatenate(found)) if found else np.zeros(0))

    return docs.filter(text_score(F.col(text_col)) < threshold)
