"""Document sources (S1-S12, S18, S20): binary files to text, one row a file.

Python only opens archives and parses XML and CSV; decoding, layout and limits are column expressions.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.text import cap_text, strip
from bidlens.operators.layout import column_index

SUPPORTED = ("docx", "doc", "xlsx", "csv", "txt")
MOST_FILES, MOST_BYTES = 25, 15 * 1024 * 1024
MOST_ROWS, MOST_COLUMNS, MOST_CSV_ROWS = 300, 30, 1000


def _extension(name: Column) -> Column:
    return F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(""))


def scan_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, name, ext, size, content of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), _extension(name).alias("ext"), F.col("length").alias("size"), "content")


#: Members of a bundle by the code points that each may have, so that no bundle is much more than 64 MB.
BUNDLES = ((1 << 14, 1024), (1 << 18, 64), (None, 1))
#: Ends a member; parts its name from its text; stands before the digit that either, or itself, is spelled as.
_END, _PART, _ESCAPE = "\x1e", "\x1f", "\x1b"


def _spelled(text: Column) -> Column:
    odd = F.replace(F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_END), F.lit(_ESCAPE + "1")), F.lit(_PART), F.lit(_ESCAPE + "2"))
    return F.when(text.rlike("[\x1b\x1e\x1f]"), odd).otherwise(text)


def _read_back(text: Column) -> Column:
    plain = F.replace(F.replace(F.replace(text, F.lit(_ESCAPE + "2"), F.lit(_PART)), F.lit(_ESCAPE + "1"), F.lit(_END)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    return F.when(F.contains(text, F.lit(_ESCAPE)), plain).otherwise(text)


def write_bundles(rows: DataFrame, path: str, member: str = "member", body: str = "body") -> None:
    """Small files as members of few large ones: a file each would cost more to open than to read. `member` is a file's path in the bundle, `body` its text; null is empty."""
    rows = rows.select(member, F.coalesce(body, F.lit("")).alias(body))
    floor = -1
    for most, members in BUNDLES:
        here = rows.filter((F.length(body) > floor) & (F.length(body) <= most if most else F.lit(True)))
        lines = here.select(F.concat(_spelled(F.col(member)), F.lit(_PART), _spelled(F.col(body))).alias("value"))
        lines.write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", members).text(path)
        floor = most


def scan_bundles(spark: SparkSession, path: str) -> DataFrame:
    """As scan_folder(), for the members of the bundles under a folder; a member's path stands after that of its bundle."""
    found = scan_folder(spark, path).select("path", F.explode(F.split(F.col("content").cast("string"), _END, -1)).alias("said")).filter("said <> ''")
    parts = found.select(F.col("path").alias("bundle"), F.split("said", _PART, -1).alias("p"))
    files = parts.select(F.concat("bundle", F.lit("/"), _read_back(F.col("p")[0])).alias("path"), _read_back(F.col("p")[1]).cast("binary").alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), _extension(name).alias("ext"), F.length("content").cast("long").alias("size"), "content")


def check_packages(files: DataFrame, package: str, text: str | None = None) -> DataFrame:
    """One row a package: n_files, and in refused the reasons why it is refused, if any; with the column `text`, a package without any text is one."""
    refused = F.array_compact(
        F.array(
            F.when(F.count(F.lit(1)) > MOST_FILES, "too_many_files"),
            F.when(F.max("size") > MOST_BYTES, "file_too_large"),
            F.when(F.count_if(~F.col("ext").isin(*SUPPORTED, "pdf")) > 0, "unsupported_type"),
            *([F.when(F.coalesce(F.max(F.length(text)), F.lit(0)) == 0, "no_text")] if text else []),
        )
    )
    counted = [F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars")] if text else []
    return files.groupBy(package).agg(F.count(F.lit(1)).alias("n_files"), refused.alias("refused"), *counted)


def read_packages(files: DataFrame, package: str) -> DataFrame:
    """Package, n_files, refused, n_chars of files as scan_folder() gives them, with a column of their package."""
    return check_packages(document_texts(files, package, "size"), package, "text")


def strip_markup(xml: Column) -> Column:
    """S2's way out for broken XML: paragraph ends as line feeds, tags away, five entities decoded."""
    text = F.regexp_replace(F.replace(xml, F.lit("</w:p>"), F.lit("\n")), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def lossy_utf8(content: Column) -> Column:
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def _cyrillic(content: Column) -> Column:
    """windows-1251, read as Latin-1 and each upper character exchanged; the one byte it leaves open is dropped."""
    upper = {b: bytes([b]).decode("cp1251", "ignore") for b in range(128, 256)}
    known = [b for b, char in upper.items() if char]
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, known)) + "\x98", "".join(upper[b] for b in known))


def plain_text(content: Column) -> Column:
    """UTF-8 if valid, else windows-1251 if it could be, else what of it is UTF-8."""
    opened = F.hex(content).rlike("^(?:..)*?98")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(~opened, _cyrillic(content)).otherwise(lossy_utf8(content))


def doc_text(content: Column) -> Column:
    """S3: lossy UTF-8, or windows-1251 where that leaves under 100 code points."""
    text = lossy_utf8(content)
    return F.when(F.length(strip(text)) < 100, _cyrillic(content)).otherwise(text)


def _word_xml(content: Column) -> Column:
    def member(data: bytes) -> str | None:
        if data is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return archive.read("word/document.xml").decode("utf-8", "ignore")
        except (zipfile.BadZipFile, KeyError):
            return None

    @F.pandas_udf("string")
    def members(contents: pd.Series) -> pd.Series:
        return contents.map(member)

    return members(content)


def docx_text(content: Column) -> Column:
    """Runs of text, tabs and line ends in document order."""
    pieces = F.regexp_extract_all(_word_xml(content), F.lit(r"<w:t(?:\s[^>]*)?>[^<]*</w:t>|<w:(?:tab|br|cr|p)(?:\s[^>]*)?/?>"), F.lit(0))
    spelled = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("<w:tab")), "\t").when(F.startswith(p, F.lit("<w:t")), strip_markup(p)).otherwise("\n"))
    return F.array_join(spelled, "")


def _csv_rows(text: Column) -> Column:
    def rows(text: str) -> str:
        if not text:
            return ""
        try:
            dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
        except csv.Error:
            dialect = csv.excel
        lines = []
        for number, row in enumerate(csv.reader(io.StringIO(text), dialect)):
            if number >= MOST_CSV_ROWS:
                break
            cells = [cell.strip() for cell in row]
            if any(cells):
                lines.append(" | ".join(cells))
        return "\n".join(lines) or text

    @F.pandas_udf("string")
    def every(texts: pd.Series) -> pd.Series:
        return texts.map(rows)

    return every(text)


def csv_text(content: Column) -> Column:
    """Tabs are blanks before the delimiter is sought, so tab-separated files have none."""
    return _csv_rows(cap_text(plain_text(content), 240_000))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _workbook_cells(data: bytes) -> Iterator[tuple[int, str, int, str, str]]:
    """Cells that hold something: sheet number, sheet name, row number, reference, text."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        tree = lambda name: ElementTree.fromstring(archive.read(name)) if name in names else ElementTree.Element("none")
        shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in tree("xl/sharedStrings.xml").iter() if _local(item.tag) == "si"]
        targets = {rel.get("Id"): "xl/" + re.sub(r"^(?:/?xl/|/|(?:\.\./)+)", "", rel.get("Target", "").replace("\\", "/").strip()) for rel in tree("xl/_rels/workbook.xml.rels").iter() if rel.get("Target")}
        sheets = [(s.get("name", "").strip() or "Sheet", targets.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None))) for s in tree("xl/workbook.xml").iter() if _local(s.tag) == "sheet"]
        sheets = [s for s in sheets if s[1]] or [(re.sub(r".*/|\.xml$", "", n), n) for n in sorted(names) if n.startswith("xl/worksheets/") and n.endswith(".xml")]
        for sheet, (name, path) in enumerate(sheets):
            for row, node in enumerate(n for n in tree(path).iter() if _local(n.tag) == "row"):
                for cell in node:
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
                    else:
                        text = next((v.text or "" for v in cell if _local(v.tag) == "v"), "").strip()
                        if kind == "s":
                            text = shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
                    if text.strip():
                        yield sheet, name, row, cell.get("r", ""), text.strip()


def xlsx_texts(files: DataFrame) -> DataFrame:
    """Path, text of workbooks; rows dense up to their last cell, joined by bars under their sheet's header."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(path, *cell) for path, data in zip(batch["path"], batch["content"], strict=True) if zipfile.is_zipfile(io.BytesIO(data)) for cell in _workbook_cells(data)]
            yield pd.DataFrame(found, columns=["path", "sheet", "name", "row", "ref", "text"])

    placed = files.select("path", "content").mapInPandas(cells, "path string, sheet int, name string, row int, ref string, text string").withColumn("col", column_index(F.col("ref"))).filter(F.col("col") < MOST_COLUMNS)
    by_col = F.map_from_entries(F.array_agg(F.struct("col", "text")))
    rows = placed.dropDuplicates(["path", "sheet", "row", "col"]).groupBy("path", "sheet", "name", "row").agg(by_col.alias("cells"), F.max("col").alias("last"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at(F.col("cells"), i), F.lit(""))), " | ")
    sheets = rows.select("path", "sheet", "name", "row", line.alias("line")).groupBy("path", "sheet", "name").agg(F.slice(F.sort_array(F.collect_list(F.struct("row", "line"))), 1, MOST_ROWS)["line"].alias("lines"))
    body = F.concat(F.lit("[SHEET] "), F.col("name"), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n"))
    return sheets.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.struct("sheet", body.alias("body"))))["body"], "\n").alias("text"))


def document_texts(files: DataFrame, *kept: str) -> DataFrame:
    """Path, name, ext, text, error, and the columns to be kept; old spreadsheets and unknown types have an error and no text."""
    ext, content = F.col("ext"), F.col("content")
    # Python sees every row, whatever the branch; so it gets only the contents that are for it.
    of = lambda kind: F.when(ext == kind, content)
    simple = files.filter(ext != "xlsx").select(
        "path", "name", "ext", *kept,
        F.when(ext == "docx", docx_text(of("docx"))).when(ext == "doc", doc_text(content)).when(ext == "txt", plain_text(content)).when(ext == "csv", csv_text(of("csv"))).alias("raw"),
    )
    books = files.filter(ext == "xlsx")
    sheets = books.select("path", "name", "ext", *kept).join(xlsx_texts(books).withColumnRenamed("text", "raw"), "path", "left").select("path", "name", "ext", *kept, F.coalesce("raw", F.lit("")).alias("raw"))
    error = F.when(ext == "xls", "Legacy XLS is not supported").when(~ext.isin(*SUPPORTED), F.concat(F.lit("Unsupported type: "), ext))
    return simple.unionByName(sheets).select("path", "name", "ext", cap_text(F.col("raw")).alias("text"), error.alias("error"), *kept)


def valid_input(text: Column, cost: Column, margin: Column, provider: Column) -> Column:
    """What a typed request must be."""
    return F.coalesce((strip(text) != "") & F.length(text).between(50, 200_000) & (cost > 0) & margin.between(0, 100) & F.coalesce(F.length(provider) <= 32, F.lit(True)), F.lit(False))
