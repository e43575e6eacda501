"""Words and word shingles of a batch of texts as 64-bit hashes, in numpy over the Arrow bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.arange(256, dtype=np.uint8)
_IS_WORD = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A))
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that are hashed at once.
PART = 1 << 20

_VALUE = mix((_LOWER + np.uint64(1)) * _MULTIPLIER)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array, most_bytes: int = 400_000) -> Iterator[pa.Array]:
    """Consecutive parts of a string column, each of about so many bytes, so that temporary arrays stay small."""
    column = column.fill_null("")
    sizes = np.diff(_offsets(column))
    part = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // most_bytes if len(sizes) else sizes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(column)], strict=True):
        if end > start:
            yield column.slice(start, end - start)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def word_hashes(column: pa.Array, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin and end (length + 1 numbers).

    With `prefix`, only so many first bytes of a word count, and how long it is doesn't.
    """
    offsets = _offsets(column)
    if len(offsets) < 2 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(data):
        # A very long text is read in parts that end between two words, for the arrays below are many times its bytes.
        end = min(len(data), at + PART)
        while end < len(data) and _IS_WORD[data[end - 1]] and _IS_WORD[data[end]]:
            between = np.flatnonzero(~_IS_WORD[data[end : end + PART]])
            end = end + int(between[0]) if len(between) else min(len(data), end + PART)
        found, heads = _part_hashes(data[at:end], offsets[(offsets >= at) & (offsets < end)] - at, prefix)
        hashes.append(found)
        starts.append(heads + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _part_hashes(data: np.ndarray, cuts: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in these bytes, where a text may begin at each of `cuts`, and where the words start."""
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    begin = np.flatnonzero(first[at])
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    powers = _powers(int(lengths.max()))
    if prefix:
        powers[prefix:] = 0
        lengths = np.minimum(lengths, prefix)
    return mix(np.add.reduceat(_VALUE[data[at]] * powers[place], begin) + lengths.astype(np.uint64)), starts


def sequence_digests(column: pa.Array) -> np.ndarray:
    """A 128-bit cryptographic digest of each text's whole sequence of words, as two numbers: equal for equal sequences only."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(column), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ")
    digests = b"".join(hashlib.blake2b(text.encode(), digest_size=16).digest() for text in plain.to_pylist())
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def shingle_counts(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text: text numbers (ascending), hashes (ascending in a text), counts.

    A text of fewer words, but not none, is one shingle.
    """
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(bounds[1:], counts)
    here = np.arange(len(words))
    total = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k, power in enumerate(_powers(size)):
        total += np.where(here + k < end, padded[k : k + len(words)], np.uint64(0)) * power
    whole = (here + size <= end) | ((here == np.repeat(bounds[:-1], counts)) & (np.repeat(counts, counts) < size))
    shingle, text = mix(total[whole]), text[whole]
    order = np.argsort(shingle, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    shingle, text = shingle[order], text[order]
    if not len(shingle):
        return text, shingle, np.zeros(0, np.int64)
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1]))
    starts = np.flatnonzero(new)
    return text[starts], shingle[starts], np.diff(np.append(starts, len(shingle)))


def prob_minhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int = 128) -> np.ndarray:
    """ProbMinHash signatures (texts x registers) of weighted shingles; `registers` is a power of two.

    Each shingle is a Poisson process of rate `weight`: its arrivals pick registers at random, and a
    register keeps the shingle that arrives first. Two texts agree in a register with the probability
    Jaccard similarity of their weights. A text's processes end early, at a time by which almost surely
    all registers have an arrival; any later one would change nothing. Where one is still empty, time
    goes on. A text without shingles has zeros.
    """
    out = np.zeros(texts * registers, np.uint64)
    first = np.full(texts * registers, np.inf)
    total = np.bincount(text, weights=weight, minlength=texts)
    limit = registers * (np.log(registers) + 3) / np.maximum(total, 1e-300)
    clock, nth, alive = np.zeros(len(text)), np.zeros(len(text), np.uint64), np.arange(len(text))
    block = 1
    while len(alive):
        steps = nth[alive, None] + np.arange(1, block + 1, dtype=np.uint64)
        draw = mix(mix(shingle[alive, None] + steps * _MULTIPLIER))
        gaps = -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[alive, None]
        times = clock[alive, None] + np.cumsum(gaps, axis=1)
        valid = times <= limit[text[alive], None]
        rows = np.nonzero(valid)[0]
        slot = text[alive][rows] * registers + (draw[valid] & np.uint64(registers - 1)).astype(np.int64)
        arrival = times[valid]
        np.minimum.at(first, slot, arrival)
        won = arrival == first[slot]
        out[slot[won]] = shingle[alive][rows[won]]
        # Those whose block ended in time go on from its end; the others rest at their last arrival in time.
        done = valid.sum(axis=1)
        clock[alive] = np.where(done > 0, times[np.arange(len(alive)), np.maximum(done - 1, 0)], clock[alive])
        nth[alive] += done.astype(np.uint64)
        alive = alive[done == block]
        if not len(alive):
            empty = np.isinf(first.reshape(texts, registers)).any(axis=1) & (total > 0)
            limit = np.where(empty, limit * 2, limit)
            alive = np.flatnonzero(empty[text])
        block = min(64, block * 2)
    return out.reshape(texts, registers)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` registers."""
    texts, registers = signatures.shape
    bands = signatures.reshape(texts, registers // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, registers // rows + 1, dtype=np.uint64) * _MULTIPLIER), bands.shape[:2]).copy()
    for k in range(rows):
        key = mix(key + bands[:, :, k])
    return key
