"""Uploaded item lists as grids of text cells.

A file is at most 25 MB, so one task can parse it whole; files are spread over the tasks. Workbooks (.xlsx) give
their first sheet as stored text: number formats are not applied. The binary .xls format is refused.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.sources.formats import BUILT_IN, formatted

MAX_BYTES = 25 * 1024 * 1024
ENDINGS = r"(?i)[.](csv|tsv|txt|xlsx)$"
DELIMITERS = ",\t|;"


class ParseError(ValueError):
    """An upload that cannot be taken."""


def delimiter(text: str) -> str:
    """The mark that cuts the first lines into most cells, all lines into equally many; a comma if none does."""
    head = list(csv.reader(io.StringIO(text[:65536], newline="")))[:11]
    lines = len(head) - (len(text) > 65536)
    best, cells = ",", 1
    for mark in DELIMITERS:
        widths = {len(r) for r in list(csv.reader(io.StringIO(text[:65536], newline=""), delimiter=mark))[:lines] if r}
        if len(widths) == 1 and (n := widths.pop()) > cells:
            best, cells = mark, n
    return best


def delimited_rows(content: bytes) -> Iterator[list[str]]:
    text = content.decode("utf-8-sig", errors="replace")
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text)):
        if row and row != [""]:
            yield row


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t) == "t")


def _styles(book: zipfile.ZipFile) -> list[str]:
    """The format code of each cell style."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.attrib["numFmtId"]): e.attrib["formatCode"] for e in root.iter() if _local(e) == "numFmt"}
    cells = next((e for e in root if _local(e) == "cellXfs"), [])
    return [(own | {k: v for k, v in BUILT_IN.items() if k not in own}).get(int(e.attrib.get("numFmtId", 0)), "General") for e in cells]


def _shown(value: str, style: str, from_1904: bool) -> str:
    """A stored number as its cell shows it."""
    try:
        return formatted(float(value), style, from_1904)
    except (ValueError, OverflowError):
        return value


def workbook_rows(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as its cells show them; cells that a row leaves out are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        parts = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter())
        sheet = next(e for e in parts if _local(e) == "sheet")
        from_1904 = any(_local(e) == "workbookPr" and e.attrib.get("date1904") in ("1", "true") for e in parts)
        styles = _styles(book)
        key = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
        target = next(e.attrib["Target"] for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if e.attrib["Id"] == key)
        shared = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as source:
            for _, row in ElementTree.iterparse(source):
                if _local(row) != "row":
                    continue
                cells: list[str] = []
                for c in (e for e in row if _local(e) == "c"):
                    column = 0
                    for letter in re.sub("[^A-Z]", "", c.attrib.get("r", "")):
                        column = column * 26 + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells))
                    value = next((e.text or "" for e in c if _local(e) == "v"), "")
                    kind = c.attrib.get("t")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = _text(c)
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    elif kind in (None, "n") and value:
                        place = int(c.attrib.get("s", 0))
                        value = _shown(value, styles[place] if place < len(styles) else "General", from_1904)
                    cells.append(value)
                row.clear()
                if any(cells):
                    yield cells


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_idx, cells) of all files below ``path`` (a folder, file or glob); empty lines are skipped.

    Raises ``ParseError`` for a file that is too large or of another kind, before any is read. An unreadable
    file fails the job with its name. A folder without files is an error of the reader.
    """
    files = spark.read.format("binaryFile").load(path)
    refused = files.filter((F.col("length") > MAX_BYTES) | ~F.col("path").rlike(ENDINGS)).select("path", "length").first()
    if refused:
        raise ParseError(f"{refused['path']}: " + ("the file is larger than 25 MB" if refused["length"] > MAX_BYTES else "use CSV, TSV, TXT or XLSX"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = list((workbook_rows if file.lower().endswith(".xlsx") else delimited_rows)(content))
                except (KeyError, IndexError, StopIteration, csv.Error, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    raise ParseError(f"{file}: the file could not be read") from error
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["file", "row_idx", "cells"])

    return files.select("path", "content").mapInArrow(run, "file string, row_idx long, cells array<string>")
