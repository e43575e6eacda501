"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.shingles import mix, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The matrix sent to all tasks has BUCKETS x languages numbers; more languages than this are refused.
MOST_LANGUAGES = 500


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def ngram_buckets(part: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the text number of every n-gram and its bucket.

    Texts are lower-cased, anything but a letter counts as a blank, and an n-gram has a letter in it
    besides its first place; n-grams don't reach over the ends of a text.
    """
    texts = [text.lower() for text in part.to_pylist()]
    lengths = np.array([len(text) + 2 for text in texts])
    codes = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), lengths)
    for n in ORDERS:
        last = len(codes) - n + 1
        if last <= 0:
            continue
        key = np.full(last, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x100000001B3) + codes[k : k + last]
        middle = min(1, n - 1)
        held = letter[middle : middle + last] & (text[:last] == text[n - 1 : n - 1 + last])
        yield text[:last][held], (mix(key[held]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def ngram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows lang, bucket, n summed over all rows of docs; bucket -1 counts the texts."""
    base = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 1_000_000):
                names, which = np.unique(batch.column(0).slice(at, len(part)).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
                at += len(part)
                sums = np.zeros((len(names), BUCKETS + 1), np.int64)
                sums[:, BUCKETS] = np.bincount(which, minlength=len(names))
                for text, bucket in ngram_buckets(part):
                    sums[:, :BUCKETS] += np.bincount(which[text] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names, sums, strict=True):
                    counts[name] = counts[name] + row if name in counts else row
        for name, row in counts.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(np.where(some == BUCKETS, -1, some)), pa.array(row[some])], ["lang", "bucket", "n"])

    return base.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors, and the log-probability matrix (buckets x languages), from all rows with a language."""
    counts = ngram_counts(docs, lang_col, text_col).persist()
    try:
        priors = {row["lang"]: row["n"] for row in counts.filter("bucket = -1").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
        if len(priors) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        table = counts.filter("bucket >= 0").toArrow()
    finally:
        counts.unpersist()
    names = sorted(priors)
    number = {name: k for k, name in enumerate(names)}
    matrix = np.full((BUCKETS, len(names)), smoothing)
    if len(names):
        np.add.at(matrix, (table["bucket"].to_numpy(), [number[x] for x in table["lang"].to_pylist()]), table["n"].to_numpy())
    log_prior = np.log(np.array([priors[name] for name in names], dtype=float) / max(1, sum(priors.values())))
    return names, log_prior, np.log(matrix / matrix.sum(axis=0))


def _posteriors(part: pa.Array, log_prior: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best class of each text, its posterior, and whether the text has a letter."""
    scores, lettered = np.tile(log_prior, (len(part), 1)), np.zeros(len(part), bool)
    for text, bucket in ngram_buckets(part):
        if len(text):
            heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            scores[text[heads]] += np.add.reduceat(matrix[bucket], heads, axis=0)
            lettered[text[heads]] = True
    best = scores.argmax(axis=1)
    return best, 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1), lettered


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, lang_pred, score. Only the text is looked at."""
    names, log_prior, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast((pa.array([*names, "und"]), log_prior, matrix))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, log_prior, matrix = sent.value
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 1_000_000):
                best, value = np.full(len(part), len(labels) - 1), np.zeros(len(part))
                if len(log_prior):
                    top, posterior, lettered = _posteriors(part, log_prior, matrix)
                    best, value = np.where(lettered, top, best), np.where(lettered, posterior, value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), labels.take(pa.array(best)), pa.array(value)], ["doc_id", "lang_pred", "score"])
                at += len(part)

    return base.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Rows of fold `held` are never learned from. A null text, or one without letters, is `und` with
    score 0, and so is every text where nothing can be learned (no rows, no languages). Rows with a
    null id are predicted, neither learned from nor held out. Ties go to the language that sorts first.
    """
    model = fit(docs.filter(fold(id_col, folds) != held), lang_col, text_col)
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
