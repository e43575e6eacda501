"""Fill-in-middle: texts cut in three at units or code points, rearranged around sentinels, and restored.

A text is UTF-8 bytes, a cut counts code points. Between the two stands a sparse exception index: the
places of the multibyte characters alone, with the bytes they have beyond one. A binary search in it
turns a cut of one kind into the other; where a text is ASCII the index is empty and a cut stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.shingles import PART, _offsets, slices

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("token", "char")


class ExceptionIndex:
    """Places of the multibyte characters of some bytes, and how many bytes all up to each have beyond one."""

    def __init__(self, data: np.ndarray) -> None:
        # Wide arrays only for the exceptions, so read in parts: a mask of a part is small.
        found = [np.flatnonzero(data[at : at + PART] >= 0xC0) + at for at in range(0, len(data), PART)]
        self.byte = np.concatenate(found) if found else np.zeros(0, np.int64)
        lead = data[self.byte]
        self.excess = np.append(0, np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)))
        self.char = self.byte - self.excess[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before each byte cut, which stands between two characters."""
        return cut - self.excess[np.searchsorted(self.byte, cut)] if len(self.byte) else cut

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return cut + self.excess[np.searchsorted(self.char, cut)] if len(self.byte) else cut


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes: a token is blanks and what follows up to the next blank, or a text's last blanks."""
    found = []
    for at in range(0, len(data), PART):
        some = data[at : at + PART + 1]
        blank = (some == 0x20) | ((some >= 0x09) & (some <= 0x0D))
        found.append(np.flatnonzero(~blank[:-1] & blank[1:]) + at + 1)
    inner = np.concatenate([*found, np.zeros(0, np.int64)])
    return np.unique(np.concatenate([inner, offsets[1:][np.diff(offsets) > 0]]))


def draws(id_col: str, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of each id, from the SHA-256 of seed, colon and id (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _cut(texts: pa.Array, h: np.ndarray, unit: str, rate: int, spm: int) -> pa.RecordBatch:
    """Forms, lengths and outputs of some texts; h has the four numbers of each as a column."""
    offsets = _offsets(texts)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    index = ExceptionIndex(data)
    start = index.chars(offsets)
    if unit == "token":
        ends = token_ends(data, offsets)
        base = np.searchsorted(ends, offsets, side="right")
        n = np.diff(base)
    else:
        n = np.diff(start)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    cuts = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        if unit == "token":
            at = np.where(k > 0, ends[np.clip(base[:-1] + k - 1, 0, max(len(ends) - 1, 0))], offsets[:-1]) if len(ends) else offsets[:-1]
            cuts.append((at, index.chars(at)))
        else:
            cuts.append((index.bytes(start[:-1] + k), start[:-1] + k))
    (a, a_char), (b, b_char) = cuts
    raw = data.tobytes()
    p, s, m = (x.encode() for x in SENTINELS)
    forms, outputs = [], []
    for k in range(len(texts)):
        begin, end = int(offsets[k]), int(offsets[k + 1])
        if begin == end or h[2][k] % 100 >= rate or any(raw.find(x, begin, end) >= 0 for x in (p, s, m)):
            forms.append("plain")
            outputs.append(raw[begin:end])
            continue
        prefix, middle, suffix = raw[begin : a[k]], raw[a[k] : b[k]], raw[b[k] : end]
        forms.append("spm" if h[3][k] % 100 < spm else "psm")
        outputs.append(b"".join((s, suffix, p, prefix, m, middle) if forms[-1] == "spm" else (p, prefix, s, suffix, m, middle)))
    plain = np.array([form == "plain" for form in forms], bool)
    columns = [
        pa.array(n.astype(np.int64)),
        pa.array(forms, pa.string()),
        pa.array((a_char - start[:-1]).astype(np.int64), mask=plain),
        pa.array((b_char - a_char).astype(np.int64), mask=plain),
        pa.array(outputs, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token", rate: int = 50, spm: int = 80, seed: str = "42") -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    `unit` is token or char, n how many of them the whole text has. Of 100 texts about `rate` are
    rearranged, of 100 of those about `spm` suffix first; cuts and form follow from the id alone, so
    repeated rows get equal results. A null or empty text, and one that holds a sentinel, stays plain, as it
    is, with null lengths (null: output is empty). Rows with a null id share one draw. A text may be of any
    length: besides its bytes only its exceptions and the ends of its tokens are held.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *draws(id_col, seed))
    kind = base.schema["doc_id"].dataType.simpleString()

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                h = [batch.column(2 + k).slice(at, len(part)).to_numpy() for k in range(4)]
                made = _cut(part, h, unit, rate, spm)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *made.columns], ["doc_id", *made.schema.names])
                at += len(part)

    return base.mapInArrow(rearrange, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from output and form, by the places of the sentinels; the output itself where the form is plain."""
    p, s, m = SENTINELS
    orders = {"psm": (p, s, m), "spm": (s, p, m)}

    def segment(name: str, k: int) -> Column:
        # The pieces hold no sentinel, so its first place is the one that was put there.
        begin = F.locate(orders[name][k], output) + F.lit(len(orders[name][k]))
        end = F.locate(orders[name][k + 1], output) if k < 2 else F.char_length(output) + 1
        return F.substring(output, begin, end - begin)

    psm = F.concat(segment("psm", 0), segment("psm", 2), segment("psm", 1))
    spm = F.concat(segment("spm", 1), segment("spm", 2), segment("spm", 0))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """fill_in_middle()'s rows with the digests of output and restored text instead of the output."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
