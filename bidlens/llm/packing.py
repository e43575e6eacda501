"""Best-fit packing of tokenised documents into sequences of a fixed length.

Only the histogram of piece lengths matters for a packing, and it has at most `capacity` entries
however many documents there are. Bin completion, a branch-and-bound search, runs on that histogram and
returns patterns with a multiplicity; documents then find their place by their rank among the pieces of
their length.
"""

from __future__ import annotations

import random
import re
import struct
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.common import materialize

#: The pretoken pattern of the word-level vocabulary, over lower-case text of the alphabet below.
_LATIN = "a-zªµºß-öø-ɏ"
_PRETOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9²³¹¼-¾]|[^\s0-9²³¹¼-¾{_LATIN}]+")
_ALPHABET = re.compile("[\t\n\r -~\xa0-ɏ‐-‧]*")
_CACHE_WORDS = 200_000

_encoders: dict[str, WordEncoder] = {}


def _pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder(dict):
    """Maps a word to its ids as little-endian bytes; an unseen one goes through the tokenizer's model once.

    The vocabulary's pretokens never hold white space, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.to_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, word: str) -> bytes:
        pretokens = _PRETOKEN.findall(word)
        letters = pretokens if word.isascii() else [self.to_letters(part)[0][0] for part in pretokens]
        ids = _pack_ids([token.id for part in letters for token in self.model.tokenize(part)])
        if len(self) < _CACHE_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the whole text. Alphabets whose pretokens aren't known here, and control strings, take the tokenizer's own path.

        What is looked at is the lower-case text, as some capitals of the alphabet have their lower case beyond it.
        """
        low = unicodedata.normalize("NFC", text).lower()
        if "<|" in text or not _ALPHABET.fullmatch(low):
            return _pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, low.split()))


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32. A null text has the end id only."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    end = _pack_ids([end_id])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            index, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    index.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return base.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Limit:
    """What a search may still do: fillings of more waste than `most_waste` are cut off, and so is all after `visits` steps."""

    most_waste: int
    visits: int


def dominated(filling: list[tuple[int, int]], waste: int, spare: int) -> bool:
    """Whether a spare length (a bit of `spare` each) could take the place of some of the filling's pieces.

    Then the filling with it is no worse here, and leaves smaller pieces for the other sequences. Sums
    of pieces are sets of bits, so all subsets are looked at together.
    """
    if spare & ((2 << waste) - 2):
        return True
    one = more = 0
    for size, count in filling:
        for _ in range(count):
            more |= (more | one) << size
            one |= 1 << size
    # A sum s gives way to lengths s..s+waste; a lone piece only to longer ones.
    for start, reach in ((more, waste), (one << 1, waste - 1)):
        if reach >= 0:
            smeared, width = start, 1
            while width <= reach:
                step = min(width, reach + 1 - width)
                smeared |= smeared << step
                width += step
            if smeared & spare:
                return True
    return False


def fillings(room: int, lengths: list[int], left: dict[int, int], limit: Limit) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Fillings of `room` as (length, count) pairs, with their waste, depth first from the largest length that fits.

    `lengths` ascends, `left` has so many pieces of each. A branch is cut where all that is left of its
    lengths together leaves more than the allowed waste; the limit may be tightened between two fillings.
    """
    below = list(accumulate(size * left[size] for size in lengths))
    taken: list[list[int]] = []
    i = bisect_right(lengths, room) - 1
    while True:
        while i >= 0 and room - below[i] <= limit.most_waste:
            count = min(left[lengths[i]], room // lengths[i])
            if count:
                taken.append([i, count])
                room -= lengths[i] * count
            i = bisect_right(lengths, room, 0, i) - 1
        if room <= limit.most_waste:
            yield [(lengths[at], count) for at, count in taken], room
        limit.visits -= 1
        if not taken or limit.visits <= 0:
            return
        i = taken[-1][0]
        room += lengths[i]
        taken[-1][1] -= 1
        if not taken[-1][1]:
            taken.pop()
        i = bisect_right(lengths, room, 0, i) - 1


def complete_bin(room: int, lengths: list[int], left: dict[int, int], visits: int = 4000) -> list[int]:
    """The filling of least waste: the best-fit one is the first incumbent, and only better ones are looked for after it."""
    best: list[tuple[int, int]] = []
    limit = Limit(room, visits)
    for filling, waste in fillings(room, lengths, left, limit):
        best, limit.most_waste = filling, waste - 1
        if not waste:
            break
    return [size for size, count in best for _ in range(count)]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """A number of sequences that no packing can undercut.

    For every length a: pieces over capacity - a stand alone, each other one over half the capacity
    has a sequence of its own too, and what is left beside these must take the pieces from a to the half.
    """
    n = np.zeros(capacity + 2, np.int64)
    for size, count in histogram.items():
        n[size] += max(0, count)
    counts, volumes = np.cumsum(n), np.cumsum(n * np.arange(len(n)))
    half = capacity // 2
    a = np.arange(1, half + 2)
    large = counts[capacity] - counts[half]
    beside = (counts[capacity - a] - counts[half]) * capacity - (volumes[capacity - a] - volumes[half])
    rest = volumes[half] - volumes[np.minimum(a - 1, half)]
    return int(max(-(-volumes[capacity] // capacity), (large + np.maximum(0, -((beside - rest) // capacity))).max()))


class _Pieces:
    """How many pieces of each length are left, and the ascending lengths of which there are any."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {size: n for size, n in histogram.items() if n > 0}
        self.lengths = sorted(self.left)
        self.volume = sum(size * n for size, n in self.left.items())

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for size, n in Counter(pattern).items():
            self.left[size] -= n * times
            if not self.left[size]:
                del self.left[size]
                self.lengths.remove(size)
        self.volume -= sum(pattern) * times

    def put_back(self, pattern: tuple[int, ...], times: int) -> None:
        for size, n in Counter(pattern).items():
            if size not in self.left:
                insort(self.lengths, size)
            self.left[size] = self.left.get(size, 0) + n * times
        self.volume += sum(pattern) * times

    def most_times(self, pattern: tuple[int, ...]) -> int:
        return min(self.left[size] // n for size, n in Counter(pattern).items())

    def beside_largest(self) -> tuple[int, dict[int, int]]:
        """The largest length, and what is left beside one piece of it."""
        top = self.lengths[-1]
        return top, self.left | {top: self.left[top] - 1}


def _completions(pieces: _Pieces, capacity: int, limit: Limit) -> Iterator[tuple[tuple[int, ...], int]]:
    """What to close next: the largest piece with its best filling as often as it goes, once, and then with every other undominated filling."""
    top, left = pieces.beside_largest()
    best = (top, *complete_bin(capacity - top, pieces.lengths, left))
    most = pieces.most_times(best)
    yield best, most
    if most > 1:
        yield best, 1
    own = Limit(limit.most_waste, limit.visits)
    for filling, waste in fillings(capacity - top, pieces.lengths, left, own):
        pattern = (top, *(size for size, count in filling for _ in range(count)))
        used = Counter(pattern[1:])
        spare = sum(1 << size for size in pieces.lengths if left[size] > used[size])
        if pattern != best and not dominated(filling, waste, spare):
            yield pattern, 1


def plan_bins(histogram: dict[int, int], capacity: int, branchings: int = 2000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences take each; every piece of the histogram is placed.

    Bin completion: the sequence of the largest piece left is closed with an undominated filling, the
    best-fit one first, and so on; the first plan found is the incumbent. If it needs more sequences than
    the lower bound, closed ones are opened again, the last first, and other fillings tried. A branch
    ends where its waste so far leaves no plan with fewer sequences than the incumbent. At the bound, or
    after `branchings` sequences closed anew, the incumbent stands; where it needs more than the bound,
    even_plan() and refilled() may still better it.
    """
    pieces = _Pieces(histogram)
    if not pieces.lengths:
        return []
    total, bound = pieces.volume, lower_bound(histogram, capacity)
    plan: list[tuple[tuple[int, ...], int]] = []
    best: list[tuple[tuple[int, ...], int]] = []
    least = closed = 0
    limit = Limit(capacity, branchings)
    open_choices = [_completions(pieces, capacity, limit)]
    while open_choices:
        # A plan with fewer sequences than the incumbent has at most this waste in all.
        room = (least - 1) * capacity - total if best else total * capacity
        limit.most_waste = min(capacity, room - (closed * capacity - (total - pieces.volume)))
        choice = next(open_choices[-1], None) if limit.most_waste >= 0 else None
        if choice is None or (best and limit.visits <= 0):
            open_choices.pop()
            if plan:
                pattern, times = plan.pop()
                pieces.put_back(pattern, times)
                closed -= times
            continue
        pieces.take(*choice)
        plan.append(choice)
        closed += choice[1]
        limit.visits -= bool(best)
        if pieces.lengths:
            open_choices.append(_completions(pieces, capacity, limit))
            continue
        if not best or closed < least:
            best, least = plan[:], closed
            if least <= bound:
                break
        pattern, times = plan.pop()
        pieces.put_back(pattern, times)
        closed -= times
    if least <= bound:
        return best
    return refilled(min(best, even_plan(histogram, capacity), key=_sequences), bound, capacity)


def _sequences(plan: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(times for _, times in plan)


def even_plan(histogram: dict[int, int], capacity: int, visits: int = 4000) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion that keeps what is left even: of the fillings of least waste around the largest piece, that whose
    scarcest length is most plentiful, half as often as it goes. Where most sequences can be full, as with lengths that
    pair or triple, taking the best fit as often as it goes uses up the lengths that others need."""
    pieces = _Pieces(histogram)
    plan: Counter[tuple[int, ...]] = Counter()
    while pieces.lengths:
        top, left = pieces.beside_largest()
        best, most, limit = [], -1, Limit(capacity, visits)
        for filling, waste in fillings(capacity - top, pieces.lengths, left, limit):
            plenty = min((left[size] // count for size, count in filling), default=left[top] + 1)
            if waste < limit.most_waste or plenty > most:
                best, most, limit.most_waste = filling, plenty, waste
        pattern = (top, *(size for size, count in best for _ in range(count)))
        times = max(1, pieces.most_times(pattern) // 2)
        pieces.take(pattern, times)
        plan[pattern] += times
    return list(plan.items())


def refilled(plan: list[tuple[tuple[int, ...], int]], bound: int, capacity: int, wasteful: int = 100, rounds: int = 60, most_failures: int = 6) -> list[tuple[tuple[int, ...], int]]:
    """The plan after sequences with waste were opened together with twice as many others and closed anew, where that saves some.

    So early choices are revised as well as late ones. About `wasteful` sequences of waste are opened a
    round, or as many equal multiples of them as their patterns stand for, so a round's work doesn't grow
    with the number of documents. Ends at the bound, after `rounds`, or after `most_failures` rounds in a row that saved none.
    """
    rng = random.Random(0)
    kept, failures = Counter(dict(plan)), 0
    for _ in range(rounds):
        if kept.total() <= bound or failures >= most_failures:
            break
        loose = {pattern: times for pattern, times in kept.items() if sum(pattern) < capacity}
        unit = 1
        while sum(times // (2 * unit) for times in loose.values()) >= wasteful:
            unit *= 2
        opened: Counter[tuple[int, ...]] = Counter()
        for patterns, wanted in ((list(loose), wasteful), ([p for p in kept if p not in loose], 2 * wasteful)):
            rng.shuffle(patterns)
            for pattern in patterns:
                if wanted > 0 and (times := min(wanted, kept[pattern] // unit)):
                    opened[pattern] = times
                    wanted -= times
        sizes: Counter[int] = Counter()
        for pattern, times in opened.items():
            for size in pattern:
                sizes[size] += times
        closed = even_plan(sizes, capacity)
        if _sequences(closed) >= opened.total():
            failures += 1
            continue
        failures = 0
        kept.subtract({pattern: times * unit for pattern, times in opened.items()})
        kept.update({pattern: times * unit for pattern, times in closed})
        kept = +kept
    return list(kept.items())


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: ascending first ranks, the sequence of that rank, and the offset in it."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, times in plan:
        offset = 0
        for size in pattern:
            found.setdefault(size, []).append((ranks.get(size, 0), first, offset))
            ranks[size] = ranks.get(size, 0) + times
            offset += size
        first += times
    return {size: tuple(np.array(column, dtype=np.int64) for column in zip(*rows, strict=True)) for size, rows in found.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset; no sequence exceeds `capacity` tokens.

    Null and empty texts are one end token. Repeated rows are packed once each, rows with a null id
    as well. Only documents longer than `capacity` are cut. An empty table gives no rows. Columns
    other than the two named are not read. What reaches the driver is the histogram of lengths, with
    at most `capacity` entries; the plan sent to the tasks has a few entries for each of those.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pack-pieces")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select("length", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-bases")
    histogram = {row["length"]: row["n"] for row in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_bins(histogram, capacity))

    # Ranks run within a length and a bucket, so a length that a third of all pieces share is spread over all buckets.
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = salted.withColumn("nth", F.row_number().over(within)).join(bases.drop("n"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                firsts, sequences, offsets = slots[int(size)]
                at = np.searchsorted(firsts, rank[rows], side="right") - 1
                sequence[rows] = sequences[at] + rank[rows] - firsts[at]
                offset[rows] = offsets[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
