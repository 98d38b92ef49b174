"""XLSX workbooks as tables, many at a time: Spark reads the files and parts them among tasks, each of which reads the
zipped XML of its own as a stream, so neither the driver nor another library takes part.

A cell is the text that its file has for it: a number as written (dates are numbers), a shared or own string, 0 or 1 for a
truth value, null where it is missing, empty or an error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The parts of a workbook and the names in them.
BOOK, LINKS, SHARED = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# How an XLSX file begins, and how a file that only points to one in large-file storage does.
XLSX_START, POINTER_START = b"PK\x03\x04", b"version https://git-lfs.github.com/spec/"
ROWS_AT_ONCE = 1000


def checked_workbook(start: bytes, path: str) -> None:
    """ValueError unless a file that begins so is a workbook."""
    if start.startswith(POINTER_START):
        raise ValueError(f"{path} is a pointer to a file in large-file storage, not the workbook itself")
    if not start.startswith(XLSX_START):
        raise ValueError(f"{path} is {'empty' if not start else 'no XLSX workbook'}")


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a name in a part, each dropped when the next is asked for."""
    with book.open(part) as file:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(file, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if _plain(e.tag) == name:
                yield e
                e.clear()
                if parents:
                    parents[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    """The text of a string item: of its runs, but not of readings given beside them."""
    own = [_text(x) for x in e if _plain(x.tag) in ("r", "is")] + [x.text or "" for x in e if _plain(x.tag) == "t"]
    return "".join(own)


def sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part of a sheet by its name; None: of the first."""
    links = {e.get("Id"): e.get("Target", "") for e in _elements(book, LINKS, "Relationship")}
    sheets = [(e.get("name"), links.get(e.get(RELATION), "")) for e in _elements(book, BOOK, "sheet")]
    for name, target in sheets:
        if sheet in (None, name) and target:
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r}; there are {[name for name, _ in sheets]}")


def column_of(place: str) -> int:
    """The number, from 0, of the column that a cell's place (as BC12) names."""
    n = 0
    for letter in re.match("[A-Z]*", place.upper()).group():
        n = 26 * n + ord(letter) - ord("A") + 1
    return n - 1


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """Number, from 1, and cells of each row of a sheet that has any."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(e) for e in _elements(book, SHARED, "si")] if SHARED in book.namelist() else []
        number = 0
        for row in _elements(book, sheet_part(book, sheet), "row"):
            number = int(row.get("r") or number + 1)
            cells: list[str | None] = []
            for cell in (c for c in row if _plain(c.tag) == "c"):
                at = column_of(cell.get("r", ""))
                at = len(cells) if at < 0 else at
                cells.extend([None] * (at + 1 - len(cells)))
                kind = cell.get("t", "n")
                value = _text(cell) if kind == "inlineStr" else next((x.text for x in cell if _plain(x.tag) == "v"), None)
                if value is not None and kind == "s":
                    value = shared[int(value)]
                cells[at] = None if kind == "e" else value
            if any(c is not None for c in cells):
                yield number, cells


def sheet_rows(spark: SparkSession, paths: Sequence[str], sheet: str | None = None) -> DataFrame:
    """path, row (from 1) and cells (array of string) of the same sheet of every workbook. A file that is no workbook, or
    lacks the sheet, is an error when the table is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                checked_workbook(content[:256], path)
                held: list[tuple[int, list[str | None]]] = []
                for row in rows_of(content, sheet):
                    held.append(row)
                    if len(held) == ROWS_AT_ONCE:
                        yield _batch(path, held)
                        held = []
                yield _batch(path, held)

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(run, "path string, row long, cells array<string>")


def _batch(path: str, rows: list[tuple[int, list[str | None]]]) -> pa.RecordBatch:
    columns = [pa.array([path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["path", "row", "cells"])


def workbooks(spark: SparkSession, paths: Sequence[str], sheet: str | None = None, strings: Sequence[str] = ()) -> DataFrame:
    """The rows below the header (the first row) of every workbook, in columns by its names, and the file's path. Headers
    must be alike. Values are doubles, but for columns named in strings; a text among numbers is an error. Empty workbooks
    give no rows; empty cells are null. Column names may not repeat."""
    rows = sheet_rows(spark, paths, sheet)
    # the first row of each file; headers are alike, so a few distinct ones at most come to the driver
    first = rows.groupBy("path").agg(F.min_by("cells", "row").alias("cells"), F.min("row").alias("_header"))
    headers = [tuple((c or "").strip() for c in r["cells"]) for r in first.select("cells").distinct().limit(2).collect()]
    if not headers:
        raise ValueError("none of the workbooks has a row")
    if len(headers) > 1:
        raise ValueError(f"headers differ: {', '.join(headers[0])}; {', '.join(headers[1])}")
    names = list(headers[0])
    if len({n.lower() for n in names}) < len(names) or "path" in names:
        raise ValueError(f"column names repeat: {', '.join(names)}")
    unknown = sorted(set(strings) - set(names))
    if unknown:
        raise ValueError(f"no columns {', '.join(unknown)}")
    below = rows.join(F.broadcast(first.select("path", "_header")), "path").where(F.col("row") > F.col("_header"))  # a row a file
    value = lambda k, n: F.get("cells", F.lit(k)).cast("string" if n in strings else "double").alias(n)
    return below.select("path", *(value(k, n) for k, n in enumerate(names)))
