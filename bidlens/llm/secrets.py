"""Secret scans with a recursive decoding worklist.

A text is scanned as it stands; then the layers under it are unwrapped (percent and Unicode escapes,
base64, gzip and zlib), each scanned in turn and searched for further layers until nothing new comes up.
A layer seen before at the same place is not taken again, so cycles end. Every finding is mapped back to
code points of the outermost text: exactly through escapes, to the whole encoded run through base64.

What is sought is ASCII, so decoded bytes are read as Latin-1: no byte, valid or not, hides what stands
beside it. Compressed layers are unfolded and scanned piece by piece, whatever their size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: Unfolded data is scanned in pieces of about so many bytes, cut where no match and no encoded run can be.
PIECE = 1 << 20
#: Where there is no such place in this many bytes, pieces overlap instead.
LONGEST_RUN, OVERLAP = 1 << 26, 1 << 16
#: So many compressed layers unfold one through the other at a time.
CHAINED = 50


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_ASSIGN = re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are sought from their first character on only: a look-behind spares the ends of runs that are too short.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")

_ESCAPE_HEAD = re.compile(r"[%\\]")
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of one length or so that are nothing but base64, and the last one.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}[\x20\t]*\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
_BLANK = re.compile(r"\s+")
_URL_SAFE = str.maketrans("-_", "+/")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_WIDE = re.compile(r"(?:[\t\n\r\x20-\x7e]\x00){8,}[\t\n\r\x20-\x7e]?")
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.=:%\\\"' \t\r\n\x00"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that hold, with code point offsets, end exclusive."""
    found: list[Span] = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    # A run of hex digits ends only where no digit follows, so runs of 24 or more are the matches that hold.
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A decoded text under a path of encodings; `outer` maps a span of it to one of the outermost text."""

    def __init__(self, text: str, path: str, outer: Callable[[int, int], tuple[int, int]]):
        self.text, self.path, self.outer = text, path, outer

    def under(self, text: str, name: str, outer: Callable[[int, int], tuple[int, int]]) -> Layer:
        return Layer(text, f"{self.path}.{name}" if self.path else name, outer)


def _reduced(tail: list[tuple[str, int, int]]) -> str | None:
    """Decode the escape that ends the list, if one does; the kind of it."""
    size, kind = 0, "unicode"
    if len(tail) > 2 and tail[-1][0] in _HEX_DIGITS and tail[-2][0] in _HEX_DIGITS:
        if tail[-3][0] == "%":
            size, kind = 3, "url"
        elif len(tail) > 3 and tail[-3][0] == "x" and tail[-4][0] == "\\":
            size = 4
        elif len(tail) > 5 and tail[-5][0] == "u" and tail[-6][0] == "\\" and tail[-3][0] in _HEX_DIGITS and tail[-4][0] in _HEX_DIGITS:
            size = 6
    if not size:
        return None
    code = int("".join(c for c, _, _ in tail[-(4 if size == 6 else 2) :]), 16)
    begin, end = tail[-size][1], tail[-1][2]
    del tail[-size:]
    if 0xDC00 <= code < 0xE000 and tail and "\ud800" <= tail[-1][0] < "\udc00":
        high, begin, _ = tail.pop()
        code = 0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00
    tail.append((chr(code), begin, end))
    return kind


def _unfinished(tail: list[tuple[str, int, int]]) -> bool:
    """Whether the list ends in what may become an escape."""
    last = "".join(c for c, _, _ in tail[-5:])
    if "\ud800" <= last[-1] < "\udc00":
        return True  # the half of a pair
    at = max(last.rfind("%"), last.rfind("\\"))
    if at < 0:
        return False
    begun = last[at:]
    digits = begun[1:] if begun[0] == "%" else begun[2:]
    return len(begun) == 1 or (_HEX_DIGITS.issuperset(digits) and (len(digits) < 2 if begun[0] == "%" or begun[1] == "x" else begun[1] == "u"))


def unescaped(text: str) -> tuple[str, str, Callable[[int, int], tuple[int, int]]] | None:
    """The text with every escape decoded until none is left, the kinds of escapes, and the map of spans to the text given.

    What decoding makes up may end an escape begun before it, so characters go on a stack, and whatever
    escape ends at its top is decoded at once: one pass, however deep escapes are nested. Only what may
    become an escape is walked through; what lies between is copied.
    """
    match = _ESCAPE_HEAD.search(text)
    kinds: set[str] = set()
    pieces: list[str] = []
    # Segments of the result: where each begins in it and in the text given, and where a decoded character ends there.
    heads: list[int] = []
    begins: list[int] = []
    ends: list[int] = []
    at = size = 0

    def copy(upto: int) -> None:
        nonlocal size
        if upto > at:
            pieces.append(text[at:upto])
            heads.append(size)
            begins.append(at)
            ends.append(-1)
            size += upto - at

    while match:
        i = match.start()
        copy(i)
        tail: list[tuple[str, int, int]] = []
        while i < len(text) and (not tail or _unfinished(tail)):
            tail.append((text[i], i, i + 1))
            i += 1
            while kind := _reduced(tail):
                kinds.add(kind)
        for char, begin, end in tail:
            pieces.append(char)
            heads.append(size)
            begins.append(begin)
            ends.append(end)
            size += 1
        at = i
        match = _ESCAPE_HEAD.search(text, at)
    if not kinds:
        return None
    copy(len(text))

    def outer(start: int, end: int) -> tuple[int, int]:
        first, last = bisect_right(heads, start) - 1, bisect_right(heads, end - 1) - 1
        return begins[first] + (start - heads[first] if ends[first] < 0 else 0), ends[last] if ends[last] >= 0 else begins[last] + end - heads[last]

    return "".join(pieces), "+".join(sorted(kinds, reverse=True)), outer


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The data of all gzip or zlib members in a row, in chunks; damage ends it, and what came before counts."""
    unpack = zlib.decompressobj(47)
    for data in chunks:
        while data:
            try:
                yield unpack.decompress(data, PIECE)
            except zlib.error:
                return
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(47)


def _spooled(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The same data from a file of its own (in memory up to PIECE bytes), free of what it came through."""
    with tempfile.SpooledTemporaryFile(PIECE) as held:
        for chunk in chunks:
            held.write(chunk)
        held.seek(0)
        while chunk := held.read(PIECE):
            yield chunk


def _unpacked(chunks: Iterator[bytes], name: str) -> tuple[Iterator[bytes], str]:
    """The chunks with every compression that they begin with taken off.

    Layers that unfold one through the other are kept apart by a file every so many. A layer whose head, size
    and all, came up before is the last: archives that hold themselves never end otherwise.
    """
    seen: set[bytes] = set()
    depth = 0
    while True:
        first = next((chunk for chunk in chunks if chunk), b"")
        head = hashlib.blake2b(first, digest_size=16).digest()
        chunks = chain([first], chunks)
        if not _PACKED.match(first) or head in seen:
            return chunks, f"{name}{'.deflate' * depth if depth < 4 else f'.deflate*{depth}'}"
        seen.add(head)
        depth += 1
        chunks = _inflated(chunks)
        if depth % CHAINED == 0:
            chunks = _spooled(chunks)
            # What the file is read from must be unfolded now, not below the next layers.
            chunks = chain([next(chunks, b"")], chunks)


def _in_pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) >= PIECE:
            cut = len(held.rstrip(_RUN_BYTES))
            if cut:
                yield held[:cut]
                held = held[cut:]
            elif len(held) >= LONGEST_RUN:
                yield held
                held = held[-OVERLAP:]
    if held:
        yield held


def _contents(run: str) -> Iterator[tuple[str, str]]:
    """What a run of base64 may hold, as (encodings, text). It may begin anywhere in the run, so all four alignments are tried."""
    letters = run.rstrip("=").translate(_URL_SAFE)
    for shift in range(4):
        part = letters[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        sources = [(iter([data]), "base64")]
        sources += [_unpacked(iter([data[m.start() :]]), "base64") for m in _PACKED.finditer(data)]
        for chunks, name in sources:
            for piece in _in_pieces(chunks):
                text = piece.decode("latin-1")
                yield name, text
                if "\x00" in text:
                    yield from ((f"{name}.wide", m[0].replace("\x00", "")) for m in _WIDE.finditer(text))


def _below(layer: Layer, seen: set[tuple[bytes, int, int]]) -> Iterator[Layer]:
    """The layers right under this one that were not seen at their place."""
    runs = ((m, m[0]) for m in _BASE64.finditer(layer.text))
    wrapped = ((m, _BLANK.sub("", m[0])) for m in (_WRAPPED.finditer(layer.text) if "\n" in layer.text else ()))
    for m, run in chain(runs, wrapped):
        place = layer.outer(m.start(), m.end())
        for name, text in _contents(run):
            key = (hashlib.blake2b(text.encode("latin-1"), digest_size=16).digest(), *place)
            if key not in seen:
                seen.add(key)
                yield layer.under(text, name, lambda start, end, place=place: place)
    if plain := unescaped(layer.text):
        text, name, inner = plain
        yield layer.under(text, name, lambda start, end: layer.outer(*inner(start, end)))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans, each sorted by start, then kind. An added kind names the layers: hex@base64.url."""
    base = sorted(base_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
    if "%" not in text and "\\" not in text and not _BASE64.search(text):
        return base, []
    known, added = set(base), set()
    seen: set[tuple[bytes, int, int]] = set()
    # The worklist is a stack of iterators, so that of a large layer one piece at a time is unfolded.
    work = [_below(Layer(text, "", lambda start, end: (start, end)), seen)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        for kind, start, end in base_spans(layer.text):
            span = layer.outer(start, end)
            if (kind, *span) not in known:
                known.add((kind, *span))
                added.add((f"{kind}@{layer.path}", *span))
        work.append(_below(layer, seen))
    return base, sorted(added, key=lambda s: (s[1], KINDS.index(s[0].split("@")[0]), s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, n_added, spans.

    Null and empty texts have no spans. Repeated rows and null ids get a row each, an empty table none;
    other columns are not read. `spans` holds base and added spans by start, then kind, base ones first.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found, added = scan(text.as_py() or "")
                every = sorted([(s, 0) for s in found] + [(s, 1) for s in added], key=lambda x: (x[0][1], KINDS.index(x[0][0].split("@")[0]), x[1], x[0][0], x[0][2]))
                counts = [sum(s[0] == k for s in found) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(found).encode()).hexdigest(), len(added), joined([s for s, _ in every])))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_added", "spans"])

    return base.mapInArrow(search, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, n_added long, spans string")
