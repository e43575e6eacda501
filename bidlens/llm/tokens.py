"""Token counts by offset-mapped attribution.

Each whole document is encoded once. Byte-level tokens are exact byte strings, so their lengths give
the span of every token; the spans are joined with those of the document's sections, and each token is
counted for exactly one section by a stated rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "majority")

_encoders: dict[str, tuple] = {}


def _encoder(path: str):
    """The encoder and the byte length of each token."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[path]


def section_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which sections begin: a document's start, and after each line feed that isn't its end."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.append(0, breaks[breaks < len(data)])


def attribute(token_ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, int]:
    """Tokens for each section, and how many crossed a boundary.

    `first` gives a token to the section of its first byte, `majority` to the one that holds most of
    its bytes (the earlier one of equals). Both intervals are sorted, so the join is a binary search.
    """
    begins = np.append(0, token_ends[:-1])
    owner = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, token_ends - 1, side="right") - 1
    crossing = np.flatnonzero(owner != last)
    if rule == "majority":
        bounds = np.append(starts, size)
        for k in crossing:
            parts = np.arange(owner[k], last[k] + 1)
            held = np.minimum(bounds[parts + 1], token_ends[k]) - np.maximum(bounds[parts], begins[k])
            owner[k] = parts[int(held.argmax())]
    return np.bincount(owner, minlength=len(starts)), len(crossing)


def token_counts(docs: DataFrame, vocabulary_path: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_sections, n_crossing, max_section_tokens, section_tokens.

    Sections are a document's lines, each with its line feed. section_tokens lists the tokens of each,
    in order, and sums to n_tokens. Null and empty texts have no section and no token. Repeated rows
    and null ids get a row each; an empty table gives none; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(vocabulary_path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                if not data:
                    rows.append((0, 0, 0, 0, []))
                    continue
                ends = np.cumsum(lengths[encoding.encode_ordinary(data.decode())])
                counts, crossing = attribute(ends, section_starts(data), len(data), rule)
                rows.append((len(ends), len(counts), crossing, int(counts.max()), counts.tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_tokens", "n_sections", "n_crossing", "max_section_tokens", "section_tokens"]
            )

    return base.mapInArrow(count, f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, max_section_tokens long, section_tokens array<long>")
