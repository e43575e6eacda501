"""Quality: gradient-boosted trees on histograms of document statistics.

Statistics come from the bytes of whole texts in numpy. Trees are grown level by level on binned
statistics and kept as flat arrays: a node's children follow from its number, so all trees are walked
for all texts at once, one step a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.language_id import fold
from bidlens.llm.shingles import _VALUE, PART, _offsets, _powers, mix, slices

#: So many consecutive words make a block; a text's worst block counts besides its means.
BLOCK = 32
BINS = 64

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_LETTER = _UPPER | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_DIGIT = (_BYTE >= 0x30) & (_BYTE <= 0x39)
_BLANK = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
_STOP = np.isin(_BYTE, [ord(c) for c in ".,;:'\"()-"])
_LOUD = np.isin(_BYTE, [ord(c) for c in "!?"])
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK | _STOP | _LOUD)
_CLASSES = (_UPPER, _LETTER, _DIGIT, _BLANK, _STOP, _LOUD, _SYMBOL, _BYTE == 0x7C, _BYTE == 0x0A)

#: Sums over a text, in this order, after the counts of bytes of each class.
_SUMS = ("bytes", "words", "word_bytes", "word_squares", "short", "long", "shouted", "bare", "echoes", "distinct", "lines", "distinct_lines", "capital_lines", "ended_lines")
#: Largest values over the blocks of a text.
_WORST = ("upper", "loud", "symbol", "bar", "digit", "echo", "repeat", "bare")


class Forest(NamedTuple):
    """Trees of one depth as arrays: inner nodes 2^depth - 1 a tree, children of k at 2k+1 and 2k+2; leaves 2^depth."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float


def _distinct(group: np.ndarray, key: np.ndarray, groups: int) -> np.ndarray:
    """How many different keys each group has."""
    order = np.lexsort((key, group))
    group, key = group[order], key[order]
    new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))[: len(group)]
    return np.bincount(group[new], minlength=groups)


def _measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and worst blocks of each text in these bytes."""
    texts = len(offsets) - 1
    sums, worst = np.zeros((texts, len(_CLASSES) + len(_SUMS))), np.zeros((texts, len(_WORST)))
    if not len(data):
        return sums, worst
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    first[cuts] |= inside[cuts]
    classes = np.array([np.bincount(owner, weights=kind[data], minlength=texts) for kind in _CLASSES]).T
    sums[:, : len(_CLASSES)] = classes
    put = {name: len(_CLASSES) + k for k, name in enumerate(_SUMS)}
    sums[:, put["bytes"]] = np.diff(offsets)
    add = lambda name, who, what=None: sums.__setitem__((slice(None), put[name]), np.bincount(who, weights=what, minlength=texts))
    starts = np.flatnonzero(first)
    if len(starts):
        at = np.flatnonzero(inside)
        begin = np.flatnonzero(first[at])
        size = np.diff(np.append(begin, len(at)))
        place = np.arange(len(at)) - np.repeat(begin, size)
        word = mix(np.add.reduceat(_VALUE[data[at]] * _powers(int(size.max()))[place], begin) + size.astype(np.uint64))
        who = owner[starts]
        caps = np.add.reduceat(_UPPER[data[at]].astype(np.int64), begin)
        letters = np.add.reduceat(_LETTER[data[at]].astype(np.int64), begin)
        echo = np.append(False, (word[1:] == word[:-1]) & (who[1:] == who[:-1]))
        bare = letters == 0
        add("words", who)
        add("word_bytes", who, size)
        add("word_squares", who, size.astype(float) ** 2)
        add("short", who, size <= 3)
        add("long", who, size > 20)
        add("shouted", who, (caps > 1) & (caps == letters))
        add("bare", who, bare)
        add("echoes", who, echo)
        # Blocks: a text's words in order, BLOCK at a time; a block's bytes reach up to the next one's first word.
        nth = np.arange(len(starts)) - np.searchsorted(who, who)
        head = np.flatnonzero(nth % BLOCK == 0)
        block = np.cumsum(nth % BLOCK == 0) - 1
        mine = who[head]
        distinct = _distinct(block, word, len(head))
        add("distinct", mine, distinct)
        stop = np.minimum(np.append(starts[head][1:], len(data)), offsets[mine + 1])
        counts = np.diff(np.append(head, len(starts)))
        per_byte = [np.add.reduceat(kind[data].astype(np.int64), starts[head]) for kind in (_UPPER, _LOUD, _SYMBOL, _BYTE == 0x7C, _DIGIT)]
        share = [x / (stop - starts[head]) for x in per_byte]
        share += [np.add.reduceat(x.astype(np.int64), head) / counts for x in (echo,)]
        share += [1 - distinct / counts, np.add.reduceat(bare.astype(np.int64), head) / counts]
        whole = np.flatnonzero((counts >= BLOCK // 2) | (nth[head] == 0))  # a short last block says little
        for k, values in enumerate(share):
            np.maximum.at(worst[:, k], mine[whole], values[whole])
    # Lines: what stands between line feeds, if it isn't all blank.
    line = np.cumsum(data == 0x0A)
    edge = np.append(True, (line[1:] != line[:-1]) | (owner[1:] != owner[:-1]))
    heads = np.flatnonzero(edge)
    size = np.diff(np.append(heads, len(data)))
    kept = np.add.reduceat(inside.astype(np.int64), heads) > 0
    place = np.arange(len(data)) - np.repeat(heads, size)
    digest = np.add.reduceat(np.where(data == 0x0A, np.uint64(0), _VALUE[data] * _powers(int(size.max()))[np.maximum(place - (data[np.repeat(heads, size)] == 0x0A), 0)]), heads)[kept]
    who = owner[heads][kept]
    add("lines", who)
    sums[:, put["distinct_lines"]] = _distinct(who, digest, texts)
    full = np.flatnonzero(inside)
    opens, ends = full[np.searchsorted(full, heads[kept])] if len(who) else heads[:0], full[np.searchsorted(full, (heads + size)[kept]) - 1] if len(who) else heads[:0]
    add("capital_lines", who, _UPPER[data[opens]] | (data[opens] >= 0x80))
    add("ended_lines", who, np.isin(data[ends], [0x2E, 0x21, 0x3F]))
    return sums, worst


def _segments(data: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text in parts that end at blanks; where they end depends on the text alone."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PART)
        while end < len(data):
            blank = np.flatnonzero(_BLANK[data[end : end + PART]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(len(data), end + PART)
        yield data[at:end]
        at = end


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics per text (texts x features). A text over PART bytes is measured part by part."""
    column = column.fill_null("")
    offsets = _offsets(column)
    if offsets[-1] > offsets[0]:
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    else:
        data = np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes > PART)
    sums, worst = np.zeros((len(sizes), len(_CLASSES) + len(_SUMS))), np.zeros((len(sizes), len(_WORST)))
    edges = [-1, *long, len(sizes)]
    for before, after in zip(edges[:-1], edges[1:], strict=True):
        if after > before + 1:
            some = slice(before + 1, after)
            cut = offsets[before + 1 : after + 1]
            sums[some], worst[some] = _measure(data[cut[0] : cut[-1]], cut - cut[0])
    for k in long:
        for segment in _segments(data[offsets[k] : offsets[k + 1]]):
            more, peak = _measure(segment, np.array([0, len(segment)]))
            sums[k] += more[0]
            worst[k] = np.maximum(worst[k], peak[0])
    return _features(sums, worst)


def _features(sums: np.ndarray, worst: np.ndarray) -> np.ndarray:
    of = {name: sums[:, len(_CLASSES) + k] for k, name in enumerate(_SUMS)}
    per = lambda x, y: x / np.maximum(y, 1)
    words, lines, mean = of["words"], of["lines"], per(of["word_bytes"], of["words"])
    columns = [np.log1p(of["bytes"]), np.log1p(words), np.log1p(lines), mean, np.sqrt(np.maximum(per(of["word_squares"], words) - mean**2, 0)), per(words, lines)]
    columns += [per(sums[:, k], of["bytes"]) for k in range(len(_CLASSES))]
    columns += [per(of[name], words) for name in ("short", "long", "shouted", "bare", "echoes", "distinct")]
    columns += [per(of[name], lines) for name in ("distinct_lines", "capital_lines", "ended_lines")]
    return np.column_stack([*columns, worst])


def fit(x: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least_weight: float = 3.0) -> Forest:
    """Boosting of the logistic loss, each tree on first and second derivatives summed by bin.

    A split needs `least_weight` (sum of second derivatives) on both sides and a gain above 0. Without
    rows, or with one label only, the forest is the prior alone.
    """
    share = (label.sum() + 1) / (len(label) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if not len(label) or label.min() == label.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    features = x.shape[1]
    edges = np.full((features, BINS - 1), np.inf)
    binned = np.zeros(x.shape, np.int64)
    for f in range(features):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts = cuts[cuts < x[:, f].max()]
        edges[f, : len(cuts)] = cuts
        binned[:, f] = np.searchsorted(cuts, x[:, f])  # bin b holds values in (cut[b-1], cut[b]]
    cell = binned + np.arange(features) * BINS
    margin = np.full(len(label), base)
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - label, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(label), np.int64)
        for level in range(depth):
            many, start = 2**level, 2**level - 1
            key = (cell + (node * features * BINS)[:, None]).ravel()
            g, h = (np.bincount(key, weights=np.repeat(w, features), minlength=many * features * BINS).reshape(many, features, BINS) for w in (slope, curve))
            left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            all_g, all_h = g.sum(2)[:, :1, None], h.sum(2)[:, :1, None]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least_weight) | (right_h < least_weight) | np.isinf(edges)[None]] = 0
            best = gain.reshape(many, -1).argmax(1)
            split = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            feature, bin_ = np.where(split, best // (BINS - 1), 0), np.where(split, best % (BINS - 1), BINS)
            out.feature[t, start : start + many] = feature
            out.threshold[t, start : start + many] = np.where(split, edges[feature, np.minimum(bin_, BINS - 2)], np.inf)
            node = 2 * node + (binned[np.arange(len(label)), feature[node]] > bin_[node])
        g, h = (np.bincount(node, weights=w, minlength=leaves) for w in (slope, curve))
        out.leaf[t] = -rate * g / (h + ridge)
        margin += out.leaf[t][node]
    return out


def probability(x: np.ndarray, forest: Forest) -> np.ndarray:
    """Scores of many texts: every tree is walked for every text at once, one level a step."""
    trees, inner = forest.feature.shape
    margin = np.full(len(x), forest.base)
    if trees and len(x):
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), np.int64)
        while node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, forest.feature[tree, node]] > forest.threshold[tree, node])
        margin += forest.leaf[tree, node - inner].sum(1)
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str, text_col: str, label_col: str, label_id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and label of at most `most_rows` labelled texts, those of smallest hashed id; the texts stay with the executors."""
    known = labels.filter(F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id_col).alias("id")).agg(F.min(F.col(label_col)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    # An id that several rows share counts once: rows learned from are bounded as the ids are.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(2)):
                x = statistics(part)
                rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in range(2)), rows], ["id", "label", "x"])
                at += len(part)

    kind = texts.schema["id"].dataType.simpleString()
    measured = texts.mapInArrow(measure, f"id {kind}, label int, x array<double>")
    rows = measured.groupBy("id").agg(F.min(F.struct("label", "x")).alias("one")).select("one.*").toArrow()
    width = len(_features(np.zeros((1, len(_CLASSES) + len(_SUMS))), np.zeros((1, len(_WORST))))[0])
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    label = rows["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, label))  # the order of arrival must not matter, not even by rounding
    return x[order], label[order]


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, score. Only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(probability(statistics(part), sent.value))], ["doc_id", "score"])
                at += len(part)

    return base.mapInArrow(rate, f"doc_id {kind}, score double")


def rate_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels of fold `held` are never learned from; `most_rows` bounds the labelled texts that are. Null
    and empty texts get the score of a text without words. Rows with a null id are scored, neither
    learned from nor held out. Repeated rows get a row each; a text with several labels counts as good
    only if all say so. Without labels the score is that of the prior, 0.5.
    """
    x, label = training_rows(docs, labels.filter(fold(label_id_col, folds) != held), most_rows, id_col, text_col, label_col, label_id_col)
    out = score(docs, fit(x, label), id_col, text_col)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
