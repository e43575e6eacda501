"""Fill-in-middle against a version by regular expressions over code points."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bidlens.llm import fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, output string, form string, n int, h1 int"


def by_hand(i, text, unit="token"):
    t = text or ""
    units = TOKEN.findall(t) if unit == "token" else list(t)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, t
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return i, len(units), "spm" if h[3] % 100 < 80 else "psm", len(p), len(m), out


def texts():
    rng = random.Random(3)
    pieces = ["a", "Zß", "€uro", "😀", "　", "\xa0", " ", "\n", "\t\x0b", "<P", ">", "<", "<S>", "\x00", "￿", "́"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randrange(12)))) for k in range(600)]
    rows += [(k, "<".join(rng.choices(["P>", "S>x", "M", "", "é "], k=6))) for k in range(600, 700)]
    rows += [(800 + k, "word é " * 60_000) for k in range(6)] + [(900 + k, "x" * 1_300_000 + "é ") for k in range(6)]
    return rows + [(None, "one two three"), (None, "one two three"), (None, None), (7, None), (7, "same id"), (7, "same id"), (8, "")]


@pytest.mark.parametrize("unit", ["token", "char"])
def test_forms_lengths_outputs_and_restored_texts(spark, unit):
    rows = texts()
    df = spark.createDataFrame([(i, t, "o", "f", 1, 2) for i, t in rows], SCHEMA).repartition(4)
    made = fim.fill_in_middle(df, unit=unit)
    key = lambda r: (str(r[0]), r[5], r[2])
    assert sorted(map(tuple, made.collect()), key=key) == sorted((by_hand(i, t, unit) for i, t in rows), key=key)
    back = made.select("doc_id", fim.restored(made["output"], made["form"]).alias("text")).collect()
    assert sorted(map(str, back)) == sorted(str(r) for r in df.selectExpr("doc_id", "coalesce(text, '') text").collect())


def test_query_columns_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c", "o", "f", 1, 2)], SCHEMA)
    got = fim.digests(fim.fill_in_middle(df)).first()
    want = by_hand(5, "a b c")
    assert (got.output_sha256, got.restored_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (want[5], "a b c"))
    assert fim.digests(fim.fill_in_middle(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, unit="line")


def test_exception_index_holds_multibyte_characters_only():
    text = "ab é€ c😀d" * 40
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.ExceptionIndex(data)
    assert len(index.byte) == 3 * 40
    chars = np.arange(len(text) + 1)
    cuts = np.array([len(text[:k].encode()) for k in chars])
    assert (index.bytes(chars) == cuts).all() and (index.chars(cuts) == chars).all()
    assert len(fim.ExceptionIndex(np.frombuffer(b"ascii only", np.uint8)).byte) == 0


def test_sliced_and_large_arrays():
    whole = pa.array(["skip", "é b", "", "c  "], pa.large_string()).slice(1)
    h = [np.array([1, 1, 1]), np.array([0, 0, 0]), np.array([0, 0, 0]), np.array([0, 0, 0])]
    made = fim._cut(whole, h, "token", 50, 80)
    assert made.column(0).to_pylist() == [2, 0, 2]
    assert made.column(4).to_pylist() == ["<S> b<P><M>é", "", "<S>  <P><M>c"]
