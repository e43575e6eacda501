"""Text functions over columns: normalisation, trimming, positional search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: Unicode's, and the four information separators.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = _SPACES.replace("\n", "").replace("\r", "").replace(" ", "")
#: Carriage return, no-break space, narrow no-break space, tab, en and em dash, and what stands for them.
_ODD, _PLAIN = "\r\u00a0\u202f\t\u2013\u2014", "\n   --"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end (T-strip)."""
    return F.btrim(text, F.lit(_SPACES))


def normalize_text(text: Column) -> Column:
    """No NULs; one kind of line feed, space and dash; runs of blanks and of line feeds collapsed; stripped."""
    text = F.replace(F.replace(text, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    # All blanks become spaces first, so that the patterns after it are plain ones.
    text = F.translate(text, _BLANKS + "\r\u2013\u2014", " " * len(_BLANKS) + "\n--")
    return strip(F.regexp_replace(F.regexp_replace(text, " {2,}", " "), "\n{3,}", "\n\n"))


def normalize_light(text: Column) -> Column:
    """As T1 without collapsing blanks."""
    text = F.replace(F.replace(text, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.translate(text, _ODD, _PLAIN)


def normalize_for_search(text: Column) -> Column:
    """Lower case, ё as е, every run of white space one blank, stripped."""
    plain = F.translate(F.lower(text), "ё" + _SPACES.replace(" ", ""), "е" + " " * (len(_SPACES) - 1))
    return strip(F.regexp_replace(plain, " {2,}", " "))


def cap_text(text: Column, most: int = 120_000) -> Column:
    """T4: the first `most` code points of the normalised text."""
    return F.substring(normalize_text(text), 1, most)


def quoted(word: str) -> str:
    """A literal as a pattern, in any case."""
    return "(?iuU)" + "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in word)


#: Put around matches to part a text at them; splitting at one plain character needs no pattern.
_MARK, _OTHER = "\uffff", "\ufffe"


def _unmarked(text: Column) -> Column:
    """The text with another character of the same length where it holds the mark itself, so that offsets stay."""
    return F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)


def _apply(value: Column, body: str) -> Column:
    """A SQL lambda over one value. As text, long expressions are built in one step instead of one call for each node."""
    return F.get(F.call_function("transform", F.array(value), F.expr(body)), F.lit(0))


def _scan(values: str, combine: str, zero: str) -> str:
    """SQL of a running total of an integer array: for each value what stands before it, combined; `combine` is associative.

    An accumulator that grew with the array would be copied at each value. So the array is cut into about
    as many blocks as a block has values: within a block and over the blocks' totals the accumulators stay short.
    """
    before = lambda part: f"aggregate({part}, named_struct('last', {zero}, 'out', cast(array() AS array<int>)), (acc, y) -> named_struct('last', {combine.format('acc.last', 'y')}, 'out', array_append(acc.out, acc.last)))"
    size = "cast(greatest(1, ceil(sqrt(size(v)))) AS int)"
    blocks = f"transform(sequence(0, cast(greatest(0, floor((size(v) - 1) / {size})) AS int)), b -> {before(f'slice(v, b * {size} + 1, {size})')})"
    joined = f"flatten(zip_with(done, {before('transform(done, d -> d.last)')}.out, (d, head) -> transform(d.out, y -> {combine.format('head', 'y')})))"
    # One block will do for a short array, as most are.
    return f"transform(array({values}), v -> if(size(v) <= 32, {before('v')}.out, transform(array({blocks}), done -> {joined})[0]))[0]"


_SUM, _MAX = ("{} + {}", "0"), ("greatest({}, {})", "-1")


def running_sum(values: Column) -> Column:
    """For each number of an array of integers the sum of those before it."""
    return _apply(values.cast("array<int>"), f"x -> {_scan('x', *_SUM)}")


def running_max(values: Column) -> Column:
    """For each number of an array of integers from 0 on the largest of those before it; -1 for the first."""
    return _apply(values.cast("array<int>"), f"x -> {_scan('x', *_MAX)}")


_FOUND = f"""filter(zip_with(pieces, {_scan('transform(pieces, z -> length(z))', *_SUM)}, (piece, at) -> named_struct('start', at, 'end', at + length(piece), 'match', piece)), (m, i) -> i % 2 = 1)"""
_FIND_ALL = f"""x -> transform(array(split(x.m, '{_MARK}', -1)), pieces ->
  if(size(pieces) = 1, cast(array() AS array<struct<start:int,end:int,match:string>>), transform(array({_FOUND}), found -> if(contains(x.t, '{_MARK}'), transform(found, m -> named_struct('start', m.start, 'end', m.end, 'match', substring(x.t, m.start + 1, m.end - m.start))), found))[0]))[0]"""
_FIND_WORD = f"""x -> transform(array(split(x.t, x.p, -1)), pieces ->
  transform(array(transform(slice(pieces, 1, size(pieces) - 1), z -> length(z) + length(x.w))), gaps ->
    zip_with(gaps, {_scan('gaps', *_SUM)}, (gap, at) -> at + gap - length(x.w)))[0])[0]"""


def find_all(text: Column, pattern: str | Column) -> Column:
    """Positional search: array of (start, end, match), offsets from 0 in code points, end exclusive.

    One pass of the pattern marks the matches; parted at the marks, the text gives gaps and matches in
    turn, whose lengths add up to the offsets. The pattern may differ from row to row.
    """
    marked = F.regexp_replace(_unmarked(text), pattern, F.lit(f"{_MARK}$0{_MARK}") if isinstance(pattern, Column) else f"{_MARK}$0{_MARK}")
    return _apply(F.struct(text.alias("t"), marked.alias("m")), _FIND_ALL)


def find_word(low: Column, word: str | Column) -> Column:
    """Where a word stands in a lower-case text: array of offsets, without overlaps."""
    word = F.lit(word) if isinstance(word, str) else word
    # A quoted word as a pattern parts a text much faster than replacing it by a mark. An empty one stands nowhere.
    pattern = F.when(word == "", "(?!)").otherwise(F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return _apply(F.struct(low.alias("t"), word.alias("w"), pattern.alias("p")), _FIND_WORD)


def starts_of(text: Column, pattern: str) -> Column:
    """How much of the text stands before the first match; all of it if there is none."""
    return F.length(F.substring_index(F.regexp_replace(_unmarked(text), pattern, _MARK), _MARK, 1))


def count_hits(text: Column, words: list[str]) -> Column:
    """Occurrences of all words in a lower-case text, each without overlaps."""

    # One expression for all words: a copy for each would make plans as long as the word lists.
    count = lambda t: F.aggregate(F.array(*[F.lit(word) for word in words]), F.lit(0), lambda n, word: n + ((F.length(t) - F.length(F.replace(t, word, F.lit("")))) / F.length(word)).cast("int"))
    return let(text, count)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds one of the words."""
    return let(text, lambda t: F.exists(F.array(*[F.lit(word) for word in words]), lambda word: F.contains(t, word)))


def clip(text: Column, start: Column, end: Column, radius: int, most: int, mark: str) -> Column:
    """What stands within `radius` of a span, stripped and cut to `most` code points."""
    left = F.greatest(F.lit(0), start - radius)
    cut = lambda quote: F.concat(F.regexp_replace(F.left(quote, F.lit(most - len(mark))), r"(?U)\s+$", ""), F.lit(mark))
    return let(strip(F.substring(text, left + 1, F.least(F.length(text), end + radius) - left)), lambda q: F.when(F.length(q) <= most, q).otherwise(cut(q)))


def clip_centred(text: Column, start: Column, end: Column, radius: int = 180, most: int = 400) -> Column:
    """As clip(), but what is too long is cut anew, of `most` code points around the span."""
    near = lambda reach: strip(F.substring(text, F.greatest(F.lit(0), start - reach) + 1, F.least(F.length(text), end + reach) - F.greatest(F.lit(0), start - reach)))
    half = F.greatest(F.lit(0), F.floor((most - F.greatest(F.lit(1), end - start)) / 2).cast("int"))
    return let(near(F.lit(radius)), lambda q: F.when(F.length(q) <= most, q).otherwise(near(half)))


def clip_flat(text: Column, most: int = 320) -> Column:
    """White space collapsed, and with a mark at the end where it is cut."""
    flat = strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    return let(flat, lambda q: F.when(F.length(q) <= most, q).otherwise(F.concat(F.regexp_replace(F.left(q, F.lit(most - 1)), r"(?U)\s+$", ""), F.lit("…"))))


def cuts(text: Column, size: int, overlap: int) -> Column:
    """Overlapping chunks of fixed size; the one that reaches the end is the last."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(step)).cast("int"))
    numbers = F.when(F.length(text) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("chunk"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
