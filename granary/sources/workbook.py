"""Sheets of workbooks (Office Open XML), read in tasks without any other package.

Spark reads the files, so they may lie wherever it can read; each workbook is one task,
which goes through the sheet's rows as a stream and gives them in batches. Of a workbook
only its shared strings are held whole. A sheet has at most 1,048,576 rows, so many
sales come as many workbooks, and these are read side by side.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 10_000


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _events(book: zipfile.ZipFile, name: str, ends: tuple[str, ...]) -> Iterator[ElementTree.Element]:
    """Elements of the given names as they end; each is emptied after use, and so is what holds them."""
    with book.open(name) as f:
        path: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(element)
                continue
            path.pop()
            if _plain(element.tag) in ends:
                yield element
                element.clear()
                if path:
                    path[-1].remove(element)


def _text(element: ElementTree.Element) -> str:
    """Text of a string that may have runs; phonetic hints are not part of it."""
    return "".join(t.text or "" for part in element for t in ([part] if _plain(part.tag) == "t" else [x for x in part if _plain(x.tag) == "t"] if _plain(part.tag) == "r" else []))


def _place(book: zipfile.ZipFile, sheet: str) -> tuple[str, datetime]:
    """The part with a sheet's rows, and the day that dates count from."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    first = any(_plain(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root)
    for e in root.iter():
        if _plain(e.tag) == "sheet" and e.get("name") == sheet:
            target = targets[next(v for k, v in e.attrib.items() if _plain(k) == "id" and k.startswith("{"))]
            return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}"), datetime(1904, 1, 1) if first else datetime(1899, 12, 30)
    raise ValueError(f"the workbook has no sheet {sheet!r}")


def _column(reference: str) -> int:
    """Place of a cell's column, from 0: AB3 is 27."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _moment(serial: float, epoch: datetime) -> datetime:
    """The time that a number of days stands for; the calendar with 1900 has a day too many before its March."""
    early = epoch.year == 1899 and serial < 60
    return epoch + timedelta(days=early) + timedelta(milliseconds=round(serial * 86_400_000))


def _reader(kind: T.DataType, epoch: datetime) -> Callable[[str, str], object]:
    """(type of the cell, its text) -> a value of the column's type; null for errors and for what is none."""

    def read(cell: str, text: str):
        if cell == "e":
            return None
        if isinstance(kind, T.StringType):
            return ("TRUE" if text == "1" else "FALSE") if cell == "b" else text
        try:
            if isinstance(kind, T.TimestampNTZType):
                return datetime.fromisoformat(text.strip()).replace(tzinfo=None) if cell in ("d", "s", "str", "inlineStr") else _moment(float(text), epoch)
            if isinstance(kind, T.DateType):
                return date.fromisoformat(text.strip()[:10]) if cell in ("d", "s", "str", "inlineStr") else _moment(float(text), epoch).date()
            if isinstance(kind, T.IntegralType):
                return int(text) if re.fullmatch(r"\s*[+-]?\d+\s*", text) else int(x) if (x := float(text)).is_integer() else None
            return float(text)
        except (ValueError, OverflowError):
            return None

    return read


def rows(content: bytes, sheet: str, schema: T.StructType) -> Iterator[tuple]:
    """Rows of one sheet under its header row, columns by name. A column that is not there is an error; rows without any cell are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        place, epoch = _place(book, sheet)
        shared = [_text(e) for e in _events(book, "xl/sharedStrings.xml", ("si",))] if "xl/sharedStrings.xml" in book.namelist() else []
        readers, columns = [_reader(f.dataType, epoch) for f in schema], None
        for row in _events(book, place, ("row",)):
            cells: dict[int, tuple[str, str]] = {}
            at = -1
            for c in row:
                at = _column(c.get("r")) if c.get("r") else at + 1
                kind, value = c.get("t", "n"), next((e.text for e in c if _plain(e.tag) == "v"), None)
                if kind == "inlineStr":
                    value = next((_text(e) for e in c if _plain(e.tag) == "is"), None)
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                if value not in (None, ""):
                    cells[at] = kind, value
            if columns is None:
                names = {v: i for i, (_, v) in cells.items()}
                if missing := [f.name for f in schema if f.name not in names]:
                    raise ValueError(f"the sheet has no columns {', '.join(missing)}")
                columns = [names[f.name] for f in schema]
            elif cells:
                yield tuple(read(*cells[i]) if i in cells else None for i, read in zip(columns, readers, strict=True))


def sheets(spark: SparkSession, path: str, sheet: str, schema: T.StructType) -> DataFrame:
    """The sheet of that name of the workbook at ``path``, or of all workbooks that ``path`` matches."""
    target = to_arrow_schema(schema)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found, strict=True), target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column("content"):
                found: list[tuple] = []
                for row in rows(content.as_py(), sheet, schema):
                    found.append(row)
                    if len(found) == BATCH:
                        yield batch(found)
                        found = []
                if found:
                    yield batch(found)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
