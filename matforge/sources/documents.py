"""Delimited documents for spreadsheets: guarded cells, CRLF lines, a byte order mark, one file per document."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from matforge.functions.dialect import Dialect
from matforge.runtime import materialise

BOM = "\ufeff"
#: Bytes of a part that are copied at once.
COPY_BYTES = 1 << 20
#: Columns of the exported files, and what joins several reasons in a cell.
MAPPING_HEADER = ("CPSE", "LEGACY_MATNR", "DESCRIPTION", "MEINS", "NEW_NMC_CODE", "ORIGINALLY_ISSUED_NMC_CODE", "MIGRATION_STATUS", "REVIEW_STATUS", "VERDICT", "CONFIDENCE", "SAFETY_RISK", "DECIDED_BY_STAGE", "VALIDATED_SUBSTITUTE_NMC_CODE", "MATCHED_NMC_CODE", "REVIEWED_BY", "REVIEWED_AT", "QUANTITY", "UNIT_PRICE", "REASONS")
SUBSTITUTION_HEADER = ("NMC_CODE_A", "NMC_CODE_B", "VERDICT", "SAFETY_RISK", "CONFIDENCE", "EVIDENCED_BY_CPSES", "CONFIRMED_BY", "CONFIRMED_AT", "AUDIT_SEQ", "REASONS")
ECONOMICS_HEADER = ("NMC_CODE", "LEGACY_CODES", "CPSES", "UOM", "COMBINED_QUANTITY", "MIN_UNIT_PRICE", "MAX_UNIT_PRICE", "WEIGHTED_AVG_UNIT_PRICE", "VALUE", "PRICE_HARMONISATION_SAVINGS", "PRICED_ROWS")


def text_cell(d: Dialect, value: str) -> str:
    """A text as a cell: what a spreadsheet would run as a formula gets an apostrophe before it."""
    safe = f"CASE WHEN {d.match(value, '^[-=+@' + chr(9) + chr(13) + ']')} THEN '''' || {value} ELSE {value} END"
    return f"coalesce(CASE WHEN {d.match(value, '[' + chr(34) + ',' + chr(10) + chr(13) + ']')} THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END, '')"


def number_cell(d: Dialect, value: str) -> str:
    """A number as a cell: all its digits, whole ones without a decimal point, no exponent below 10^26; numbers are not guarded."""
    plain = f"CAST(CAST(CAST({value} AS VARCHAR(40)) AS DECIMAL(38, 12)) AS VARCHAR(60))"
    return f"coalesce(CASE WHEN abs({value}) < 1e26 THEN {d.replace(d.replace(plain, '[.]0+$'), '([.][0-9]*[1-9])0+$', '$1')} ELSE CAST({value} AS VARCHAR(40)) END, '')"


def line(cells: list[str]) -> str:
    return " || ',' || ".join(f"({c})" for c in cells)


def write_documents(rows: DataFrame, path: str, bom: bool = True) -> DataFrame:
    """Write rows of (document, header, place, line) as ``path/document``; a manifest (document, lines, bytes).

    Lines are dealt by ranges of (document, place), so a document is sorted and spelt by many tasks; one then streams its parts
    into its file, holding ``COPY_BYTES`` at a time. Files are written under a temporary name and renamed, and parts lie in a folder that is
    deleted at the end, so a task that runs again leaves the same files.
    """
    spark = rows.sparkSession
    parts_path = f"{path.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    parts_fs, parts_root = _filesystem(parts_path)
    parts_fs.create_dir(parts_root, recursive=True)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(parts_path)
        place = TaskContext.get().partitionId()
        now, out, done = None, None, []
        for batch in batches:
            for document, header, text in zip(*(batch.column(c).to_pylist() for c in ("document", "header", "line")), strict=True):
                if out is None or document != now:
                    if out is not None:
                        out.close()
                    now = document
                    done.append([document, header, place, f"{place}-{len(done)}-{os.urandom(8).hex()}", 0])
                    out = where.open_output_stream(f"{base}/{done[-1][3]}")
                out.write(f"{text}\r\n".encode())
                done[-1][4] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["document", "header", "part", "file", "lines"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(path)
        _, parts = _filesystem(parts_path)
        now, out, temporary, lines, size, done = None, None, "", 0, 0, []

        def close() -> None:
            out.close()
            where.move(temporary, f"{base}/{now}")
            done.append((now, lines, size))

        for batch in batches:
            for document, header, file, own in zip(*(batch.column(c).to_pylist() for c in ("document", "header", "file", "lines")), strict=True):
                if out is None or document != now:
                    if out is not None:
                        close()
                    start = f"{BOM if bom else ''}{header}\r\n".encode()
                    now, lines, size, temporary = document, 0, len(start), f"{base}/.{document}.{os.getpid()}.{os.urandom(4).hex()}"
                    out = where.open_output_stream(temporary)
                    out.write(start)
                with where.open_input_stream(f"{parts}/{file}") as part:
                    while data := part.read(COPY_BYTES):
                        out.write(data)
                        size += len(data)
                lines += own
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), *(pa.array([x[k] for x in done], pa.int64()) for k in (1, 2))], ["document", "lines", "bytes"])

    dealt = rows.select("document", "header", "place", "line").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "document", "place").sortWithinPartitions("document", "place")
    parts = materialise(dealt.select("document", "header", "line").mapInArrow(spell, "document string, header string, part long, file string, lines long"), "parts")
    in_order = parts.repartition("document").sortWithinPartitions("document", "part")
    made = materialise(in_order.mapInArrow(join, "document string, lines long, bytes long"), "documents")
    parts_fs.delete_dir(parts_root)
    return made


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
