"""Page geometry: words to rows, rows to text, table detection, choice of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.text import let, strip


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters to an index from 0."""
    chars = F.filter(F.split(F.upper(F.regexp_extract(letters, "^[A-Za-z]*", 0)), ""), lambda c: c != "")
    return F.greatest(F.lit(0), F.aggregate(chars, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1)


def rows_of(words: Column, height: Column) -> Column:
    """Rows of (x0, x1, word); a word starts a row if its middle is off that of the row's first word."""
    tolerance = F.greatest(F.lit(2.0), height * 0.005)
    items = F.sort_array(F.transform(F.filter(words, lambda w: w["word"] != ""), lambda w: F.struct(((w["y0"] + w["y1"]) / 2).alias("y"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["word"].alias("word"))))
    state = lambda y, starts, nth: F.struct(y.alias("y"), starts.alias("starts"), nth.alias("nth"))

    def step(acc: Column, w: Column) -> Column:
        same = (F.size(acc["starts"]) > 0) & (F.abs(w["y"] - acc["y"]) <= tolerance)
        return F.when(same, state(acc["y"], acc["starts"], acc["nth"] + 1)).otherwise(state(w["y"], F.array_append(acc["starts"], acc["nth"]), acc["nth"] + 1))

    # An accumulator is copied with all it holds at each word, so it holds where rows start, not their words.
    begun = state(F.lit(None).cast("double"), F.array().cast("array<int>"), F.lit(0))
    cells = lambda part: F.sort_array(F.transform(part, lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["word"].alias("word"))))
    cut = lambda all_, starts: F.transform(starts, lambda at, n: cells(F.slice(all_, at + 1, F.coalesce(F.get(starts, n + 1), F.size(all_)) - at)))
    return let(items, lambda all_: let(F.aggregate(all_, begun, step, lambda acc: acc["starts"]), lambda starts: cut(all_, starts)))


def text_of(rows: Column, width: Column) -> Column:
    """Words joined by a blank, or by a tab over a wide gap."""
    gap = F.greatest(F.lit(8.0), width * 0.02)

    def line(cells: Column) -> Column:
        return F.array_join(
            F.transform(cells, lambda c, i: F.concat(F.when(i == 0, "").when(c["x0"] - F.get(cells, i - 1)["x1"] > gap, "\t").otherwise(" "), c["word"])), ""
        )

    return F.array_join(F.transform(rows, line), "\n")


def is_table(rows: Column, width: Column) -> Column:
    """The upper median of column counts is three, or two over at least six rows."""
    tolerance = F.greatest(F.lit(6.0), width * 0.015)

    def add(centres: Column, cell: Column) -> Column:
        near = F.array_position(F.transform(centres, lambda c: F.abs(cell["x0"] - c) <= tolerance), True).cast("int")
        moved = F.transform(centres, lambda c, i: F.when(i == near - 1, (c + cell["x0"]) / 2).otherwise(c))
        return F.when(near > 0, moved).otherwise(F.array_append(centres, cell["x0"]))

    counts = F.transform(F.filter(rows, lambda r: F.size(r) >= 3), lambda r: F.size(F.aggregate(r, F.array().cast("array<double>"), add)))
    kept = F.sort_array(F.filter(counts, lambda n: n >= 2))
    median = F.get(kept, (F.size(kept) / 2).cast("int"))
    return F.coalesce((F.size(rows) >= 3) & (F.size(kept) >= 3) & ((median >= 3) | ((median == 2) & (F.size(kept) >= 6))), F.lit(False))


def choose_text(plain: Column, by_rows: Column, table: Column) -> Column:
    """S16."""
    tabs = F.length(by_rows) - F.length(F.replace(by_rows, F.lit("\t"), F.lit("")))
    return F.when(strip(plain) == "", by_rows).when(strip(by_rows) == "", plain).when(table | (tabs >= 5) | (F.length(by_rows) > F.length(plain) * 1.1), by_rows).otherwise(plain)


def layout_words(docs: DataFrame, per_line: int = 8, lines: int = 50) -> DataFrame:
    """Words of documents set on pages, eight a line, the lines slightly uneven; every fifth document in columns."""
    words = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("i", "word"))
    per_page = per_line * lines
    at = F.col("i") % per_line
    x0 = F.when(F.col("doc_id") % 5 == 0, at * 75.0).otherwise(at * 60.0)
    y0 = F.floor(F.col("i") % per_page / per_line) * 14.0 + at % 2
    placed = words.select("doc_id", F.floor(F.col("i") / per_page).alias("page"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), F.col("word"))
    return placed.withColumn("x1", F.col("x0") + F.least(F.lit(58.0), F.length("word") * 6.0)).withColumn("y1", F.col("y0") + 10.0)


def layout_pages(docs: DataFrame, per_line: int = 8, lines: int = 50) -> DataFrame:
    """The words of layout_words() as one row a page, cut from each document's array: no word is a row of its own, and none is shuffled."""
    per_page = per_line * lines
    split = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("all"))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("all") - 1) / per_page).cast("int")))
    pages = split.select("doc_id", F.posexplode(F.transform(numbers, lambda n: F.slice("all", n * per_page + 1, per_page))).alias("page", "words"))
    step = F.when(F.col("doc_id") % 5 == 0, 75.0).otherwise(60.0)

    def place(word: Column, i: Column) -> Column:
        x0, y0 = i % per_line * step, F.floor(i / per_line) * 14.0 + i % per_line % 2
        return F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.lit(58.0), F.length(word) * 6.0)).alias("x1"), (y0 + 10.0).alias("y1"), word.alias("word"))

    return pages.select("doc_id", F.col("page").cast("long").alias("page"), F.transform("words", place).alias("words"))


def page_texts(words: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """One row a page: its row and table counts and the text chosen. A page's words are bounded by the page."""
    return texts_of_pages(words.groupBy("doc_id", "page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "word")).alias("words")), width, height)


def texts_of_pages(pages: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """page_texts() of pages whose words are an array."""
    rows = pages.withColumn("rows", rows_of(F.col("words"), F.lit(height)))
    plain = F.array_join(F.transform(F.sort_array(F.transform("words", lambda w: F.struct(w["y0"].alias("y"), w["x0"].alias("x"), w["word"].alias("w")))), lambda w: w["w"]), " ")
    made = rows.withColumn("plain", plain).withColumn("by_rows", text_of(F.col("rows"), F.lit(width))).withColumn("is_table", is_table(F.col("rows"), F.lit(width)))
    return made.select("doc_id", F.col("page").cast("long").alias("page"), F.size("rows").cast("long").alias("n_rows"), "is_table", F.sha2(choose_text(F.col("plain"), F.col("by_rows"), F.col("is_table")), 256).alias("text_sha256"))
