"""Chat formatting by columnar byte assembly.

Each batch of turns becomes one preallocated buffer: segment lengths give cumulative offsets, and the
bytes of headers and contents are scattered to their places in numpy. Control strings inside texts are
escaped reversibly: a backslash becomes two, `<|` becomes `<\\|`, so the two never meet in a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "<|", "<\\|")


def escape_role(column: pa.Array) -> pa.Array:
    """As escape(); a header is one line, so a line feed becomes a backslash and an n."""
    return pc.replace_substring(escape(column), "\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins and ends in the data (length + 1 offsets), and the data."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(batch: pa.RecordBatch, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about so many bytes of text, so that index arrays stay small; a larger row is a part of its own."""
    sizes = sum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
    before = np.cumsum(sizes) - sizes
    cuts = np.flatnonzero((np.diff(before // most_bytes) > 0) | (sizes[1:] > most_bytes) | (sizes[:-1] > most_bytes)) + 1
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def assemble(segments: list[pa.Array | str], rows: int) -> pa.Array:
    """Row by row the concatenation of all segments; a plain string stands for a column of it."""
    parts, lengths = [], np.zeros((len(segments), rows), np.int64)
    for k, segment in enumerate(segments):
        if isinstance(segment, str):
            data = np.frombuffer(segment.encode(), np.uint8)
            parts.append((None, data))
            lengths[k] = len(data)
        else:
            offsets, data = _bytes_of(segment)
            parts.append((offsets, data))
            lengths[k] = np.diff(offsets)
    ends = np.cumsum(lengths.T.ravel())
    begins = (ends - lengths.T.ravel()).reshape(rows, len(segments))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (offsets, data) in enumerate(parts):
        if offsets is None:
            out[begins[:, k, None] + np.arange(len(data))] = data
        elif rows == 1:
            out[begins[0, k] : begins[0, k] + lengths[k, 0]] = data[offsets[0] : offsets[1]]
        else:
            shift = np.repeat(begins[:, k] - offsets[:-1], lengths[k])
            source = np.arange(offsets[0], offsets[-1])
            out[source + shift] = data[offsets[0] : offsets[-1]]
    row_offsets = np.append(0, ends.reshape(rows, len(segments))[:, -1]) if rows else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(row_offsets.astype(np.int64)), pa.py_buffer(out)])


def format_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows conv_id, formatted, loss_start, loss_length: one a turn, in order, a conversation in one partition.

    The concatenation of a conversation's rows is its training text; the loss mask of each row is in
    code points of `formatted` (length 0: none). Turns are ordered by turn, then role, then text, nulls
    first; null roles and texts are empty. A conversation is streamed batch by batch, so that one of any
    length takes no more memory than a batch. Rows with a null conv_id are one conversation. Repeated
    rows are turns of their own. Other columns are not read.
    """
    kind = conversations.schema[id_col].dataType.simpleString()
    base = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            role, text = escape_role(batch.column(1)), escape(batch.column(2))
            learned = pc.equal(batch.column(1), LEARNED_ROLE)
            start = pc.add(pc.utf8_length(role), len(OPEN) + len(MIDDLE))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    assemble([OPEN, role, MIDDLE, text, CLOSE], batch.num_rows).cast(pa.string()),
                    start.cast(pa.int64()),
                    pc.if_else(learned, pc.utf8_length(text), 0).cast(pa.int64()),
                ],
                ["conv_id", "formatted", "loss_start", "loss_length"],
            )

    ordered = base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(build, f"conv_id {kind}, formatted string, loss_start long, loss_length long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from format_turns() alone.

    Turns are found by the template's marks in the output; digests run on from batch to batch.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        key, state = None, None

        def row(key, state):
            turns, whole, chars, loss, size = state
            return (key, turns, whole.hexdigest(), chars, loss.hexdigest(), size)

        def packed(done, id_type):
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *types], strict=True)], names)

        id_type = None
        for batch in batches:
            id_type, done = batch.schema.field(0).type, []
            for conv, text, start, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(row(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in _TURN.findall(text):
                    state[0] += 1
                    state[1].update(f"{unescape_role(role)}\n{unescape(content)}\n".encode())
                learned = unescape(text[start : start + length])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield packed(done, id_type)
        if state is not None:
            yield packed([row(key, state)], id_type)

    return formatted.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
