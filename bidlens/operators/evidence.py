"""Evidence for facts: where a value stands in its text (R10), and passages on a subject within a budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.text import find_all, let, quoted, strip
from bidlens.operators.corpus import file_at

#: What stands between the digits of a number as it is written.
_BETWEEN = r"[\s .,]*"


def number_pattern(value: Column) -> Column:
    """A pattern of the ways to write a number: digits with separators between them, or a fraction with point or comma."""
    value = value.cast("double")
    fraction = F.replace(F.regexp_replace(value.cast("decimal(38,15)").cast("string"), "0+$", ""), F.lit("."), F.lit("[.,]"))
    digits = F.array_join(F.split(F.bround(value, 0).cast("decimal(38,0)").cast("string"), ""), _BETWEEN)
    whole = F.abs(value - F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))) <= 0.0001
    return F.concat(F.lit(r"(?U)\b"), F.when(whole, digits).otherwise(fraction), F.lit(r"\b"))


def value_evidence(text: Column, value: Column, words: list[str], marks: Column | None = None, radius: int = 160) -> Column:
    """(start, quote, file) of the first place of the value that has one of the words within `radius`; null if there is none.

    An interval join in a row: a word counts if it stands wholly between the ends of the place widened on
    both sides. The words are sought in lower case as they are spelled. Without words any place will do;
    `marks` are the file markers of the text. A null value has no place.
    """

    def found(x: Column) -> Column:
        low = F.lower(x["text"])
        spots = F.flatten(F.transform(F.array(*[F.lit(word) for word in words]), lambda w: F.when(F.contains(low, w), F.transform(find_all(low, F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), lambda m: F.struct(m["start"], m["end"]))).otherwise(F.array().cast("array<struct<start:int,end:int>>")))) if words else None
        places = find_all(x["text"], x["pattern"])
        if spots is None:
            return F.try_element_at(places, F.lit(1))
        near = lambda w: F.filter(places, lambda m: F.exists(w, lambda s: (s["start"] >= m["start"] - radius) & (s["end"] <= m["end"] + radius)))
        return F.try_element_at(let(spots, near), F.lit(1))

    def quote(x: Column) -> Column:
        left = F.greatest(F.lit(0), x["m"]["start"] - radius)
        cut = strip(F.substring(x["text"], left + 1, x["m"]["end"] + radius - left))
        file = file_at(x["marks"], x["m"]["start"]) if marks is not None else F.lit(None).cast("string")
        return F.when(x["m"].isNotNull(), F.struct(x["m"]["start"].alias("start"), cut.alias("quote"), file.alias("file")))

    parts = [text.alias("text"), number_pattern(value).alias("pattern")]
    kept = [text.alias("text"), *([marks.alias("marks")] if marks is not None else [])]
    return let(F.struct(*kept, let(F.struct(*parts), found).alias("m")), quote)


def passages(text: Column, words: list[str], marks: Column | None = None, most: int = 6, window: int = 180, most_chars: int = 1600) -> Column:
    """(pieces, stop): what stands around each word, in the order of the words and then of the text, each piece once.

    It ends with the piece that makes `most`, or that brings all pieces to `most_chars` code points with
    their file's line; `stop` says which (most_pieces, most_chars), or exhausted. Null for a null text. At most `most` pieces are
    held, and no text is cut after the end.
    """
    named = F.array(*[F.struct(F.lit(n).alias("nth"), F.lit(quoted(word)).alias("pattern")) for n, word in enumerate(words)])
    hits = lambda t: F.flatten(F.transform(named, lambda k: F.transform(find_all(t, k["pattern"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))))
    state = lambda pieces, seen, total, stop: F.struct(pieces.alias("pieces"), seen.alias("seen"), total.alias("total"), stop.alias("stop"))
    none = F.array().cast("array<string>")

    def gather(x: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            left = F.greatest(F.lit(0), m["start"] - window)
            snippet = strip(F.substring(x["text"], left + 1, m["end"] + window - left))
            return F.when(acc["stop"].isNotNull(), acc).otherwise(let(snippet, lambda s: F.when((s == "") | F.array_contains(acc["seen"], s), acc).otherwise(let(told(s, m), lambda piece: add(acc, s, piece)))))

        def told(s: Column, m: Column) -> Column:
            if marks is None:
                return s
            # A backslash and an n part the file from the piece, as in the prompts these are for.
            return let(file_at(x["marks"], m["start"]), lambda file: F.when(F.coalesce(file, F.lit("")) != "", F.concat(F.lit("[FILE: "), file, F.lit("]\\n"), s)).otherwise(s))

        def add(acc: Column, s: Column, piece: Column) -> Column:
            total = acc["total"] + F.length(piece)
            stop = F.when(F.size(acc["pieces"]) + 1 >= most, "most_pieces").when(total >= most_chars, "most_chars")
            return state(F.array_append(acc["pieces"], piece), F.array_append(acc["seen"], s), total, stop)

        begun = state(none, none, F.lit(0), F.lit(None).cast("string"))
        return F.aggregate(x["hits"], begun, step, lambda acc: F.struct(acc["pieces"].alias("pieces"), F.coalesce(acc["stop"], F.lit("exhausted")).alias("stop")))

    kept = [text.alias("text"), hits(text).alias("hits"), *([marks.alias("marks")] if marks is not None else [])]
    return let(F.struct(*kept), gather)
