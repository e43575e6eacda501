"""Corpus assembly of file packages, file markers and the lookup from an offset to its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.text import any_of, count_hits, find_all, let, normalize_text, running_sum, strip
from bidlens.rules import ROLE_ANCHORS, ROLE_FILE_NAMES

#: Fixed value: the line that heads a package of files.
PACKAGE_HEADER = "TENDER PACKAGE (MULTI-FILE) - STRUCTURED CORPUS\n"
MARKERS = {"batch": r"(?md)^===== FILE\s+\d+/\d+:\s*(.+?)\s*=====$", "evidence": r"(?md)^===== FILE\s+(.+?)\s*=====$"}


def input_mode(n_files: Column, manual: Column) -> Column:
    """T8."""
    typed = F.coalesce(F.trim(manual) != "", F.lit(False))
    return F.when((n_files > 0) & typed, "attachments_plus_text").when(n_files > 0, "attachments").otherwise("manual_text")


def assemble(files: DataFrame, package: str, style: str = "batch", name: str = "name", text: str = "text", nth: str = "nth") -> DataFrame:
    """One row a package: its files in order under a header line each (T5 batch, T6 ranked, T7 evidence), normalised."""
    total = F.count(F.lit(1)).cast("string")
    parts = F.sort_array(F.collect_list(F.struct(nth, name, text)))
    extension = lambda n: F.concat(F.lit("."), F.lower(F.substring_index(n, ".", -1)))
    header = {
        "batch": lambda p, n: F.concat(F.lit("\n===== FILE "), p[nth].cast("string"), F.lit("/"), n, F.lit(": "), p[name], F.lit(" ("), extension(p[name]), F.lit(") =====\n\n"), p[text]),
        "ranked": lambda p, n: F.concat(F.lit("===== FILE "), p[nth].cast("string"), F.lit("/"), n, F.lit(": "), p[name], F.lit(" =====\n"), p[text], F.lit("\n\n")),
        "evidence": lambda p, n: F.concat(F.lit("===== FILE "), p[name], F.lit(" =====\n"), p[text], F.lit("\n")),
    }[style]
    grouped = files.groupBy(package).agg(total.alias("_total"), parts.alias("_parts"), F.count(F.lit(1)).alias("n_files"))
    joined = F.array_join(F.transform("_parts", lambda p: header(p, F.col("_total"))), "\n" if style == "batch" else "")
    # The files' texts are normalised already; between them T6 and T7 keep their own line feeds.
    return grouped.select(package, "n_files", (normalize_text(F.concat(F.lit(PACKAGE_HEADER + "\n"), joined)) if style == "batch" else joined).alias("corpus"))


MANUAL_HEADERS = {"ranked": "===== MANUAL_TEXT =====\n", "evidence": "===== FILE MANUAL_TEXT =====\n"}


def assemble_with_manual(files: DataFrame, manual: DataFrame, package: str, style: str) -> DataFrame:
    """One row a package of `manual` (package, manual): mode, corpus; a typed text comes after the files, under a header of its own."""
    both = manual.join(assemble(files, package, style), package, "left")
    typed = normalize_text(F.coalesce("manual", F.lit("")))
    block = F.when(typed != "", F.concat(F.lit(MANUAL_HEADERS[style]), typed, F.lit("\n"))).otherwise("")
    return both.select(package, input_mode(F.coalesce("n_files", F.lit(0)), F.col("manual")).alias("mode"), strip(F.concat(F.coalesce("corpus", F.lit("")), block)).alias("corpus"))


def markers(corpus: Column, style: str = "batch") -> Column:
    """Array of (pos, name) of the header lines."""
    found = find_all(corpus, MARKERS[style])
    return F.transform(found, lambda m: F.struct(m["start"].alias("pos"), F.regexp_extract(m["match"], MARKERS[style], 1).alias("name")))


def blocks(corpus: Column) -> Column:
    """Array of (start, file, text): what stands under each header line of a package, from its first character that is no line end; without headers the whole corpus, of no file."""

    def under(x: Column) -> Column:
        part = lambda m, i: F.substring(x["text"], m["end"] + 1, F.coalesce(F.get(x["found"], i + 1)["start"], F.lit(2**31 - 1)) - m["end"])
        name = lambda m: F.nullif(strip(F.regexp_extract(m["match"], MARKERS["batch"], 1)), F.lit(""))
        cut = lambda raw, m: let(F.regexp_replace(raw, r"^[\r\n]+", ""), lambda t: F.struct((m["end"] + F.length(raw) - F.length(t)).alias("start"), name(m).alias("file"), t.alias("text")))
        made = F.transform(x["found"], lambda m, i: let(part(m, i), lambda raw: cut(raw, m)))
        return F.when(F.size(x["found"]) > 0, made).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("file"), x["text"].alias("text"))))

    return let(F.struct(corpus.alias("text"), find_all(corpus, MARKERS["batch"]).alias("found")), under)


def block_file(parts: Column, offset: Column) -> Column:
    """T10 over blocks(): the file of the last block that starts at or before the offset."""
    return F.try_element_at(F.filter(parts, lambda b: b["start"] <= offset), F.lit(-1))["file"]


def file_at(marks: Column, offset: Column) -> Column:
    """T10, as-of lookup: the name of the last marker at or before the offset."""
    return F.try_element_at(F.filter(marks, lambda m: m["pos"] <= offset), F.lit(-1))["name"]


def lines(text: Column) -> Column:
    """Array of (offset, line)."""
    place = lambda rows: F.zip_with(rows, running_sum(F.transform(rows, lambda x: F.length(x) + 1)), lambda x, at: F.struct(at.alias("offset"), x.alias("line")))
    return let(F.split(text, "\n", -1), place)


def roles(text: Column, name: Column) -> dict[str, Column]:
    """Per role a score (anchor occurrences, and 2 if the file name says so) and the anchors found."""
    low = F.lower(text)
    out: dict[str, Column] = {}
    for role, anchors in ROLE_ANCHORS.items():
        out[f"{role}_score"] = F.when(any_of(low, anchors), count_hits(low, anchors)).otherwise(0) + F.when(F.lower(name).rlike(ROLE_FILE_NAMES[role]), 2).otherwise(0)
        out[f"{role}_anchors"] = F.array_join(F.filter(F.array(*[F.lit(a) for a in anchors]), lambda a: F.contains(low, a)), "|")
    return out
