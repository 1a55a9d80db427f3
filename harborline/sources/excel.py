"""Sheets of .xlsx workbooks, read with the standard library: a zip of XML parts, streamed.

A sheet is one stream, so one task reads it: rows as their XML ends, batch by batch, with the table of shared strings on the task's disk.
Neither the sheet nor that table is ever held whole, and no row passes the driver.

Cells become text, or null where they are empty: cached values of formulas, integers without ".0", booleans as True or False,
dates as the serial numbers that the file holds are turned to ISO text where the cell's style is a date format.
"""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from array import array
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from .stores import store_of

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show a date or time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _targets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS):
        target = links[s.get(_REL)]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        return [name for name, _ in _targets(book)]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iterfind("m:numFmts/m:numFmt", _NS) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _elements(part, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a part, each as it ends; what has been read is let go."""
    name, path = f"{{{_NS['m']}}}{tag}", []
    for event, e in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            path.append(e)
        else:
            path.pop()
            if e.tag == name:
                yield e
                if path:
                    path[-1].remove(e)


class _Shared:
    """Shared strings on disk, found by where they begin. The file has no name and goes with the task."""

    def __init__(self, book: zipfile.ZipFile):
        self.file, self.at = tempfile.TemporaryFile(), array("q", [0])
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for si in _elements(part, "si"):
                    self.at.append(self.at[-1] + self.file.write("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")).encode()))
        self.get = lru_cache(4096)(self._get)

    def _get(self, i: int) -> str:
        self.file.seek(self.at[i])
        return self.file.read(self.at[i + 1] - self.at[i]).decode()

    def close(self) -> None:
        self.file.close()


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(cell, shared: _Shared, dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iterfind("m:is//m:t", _NS))
    v = cell.find("m:v", _NS)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared.get(int(v.text))
    if kind == "b":
        return "True" if v.text.strip() == "1" else "False"
    if kind in ("str", "d", "e"):
        return v.text
    number = float(v.text)
    if int(cell.get("s", -1)) in dates:
        at = datetime(1899, 12, 30) + timedelta(days=number)
        at = (at + timedelta(microseconds=500_000)).replace(microsecond=0)
        return at.strftime("%Y-%m-%d %H:%M:%S")
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _target(book: zipfile.ZipFile, sheet: str | int) -> str:
    sheets = _targets(book)
    if isinstance(sheet, int):
        if not 0 <= sheet < len(sheets):
            raise ValueError(f"sheet {sheet} is out of range: the workbook has {len(sheets)}")
        return sheets[sheet][1]
    if sheet not in dict(sheets):
        raise ValueError(f"no sheet {sheet!r}; the workbook has {', '.join(n for n, _ in sheets)}")
    return dict(sheets)[sheet]


def _rows(file, sheet: str | int) -> Iterator[dict[int, str | None]]:
    """Cells of each row by number of column, in order."""
    with zipfile.ZipFile(file) as book:
        target, dates, shared = _target(book, sheet), _date_styles(book), _Shared(book)
        try:
            with book.open(target) as part:
                for row in _elements(part, "row"):
                    yield {_column(c.get("r")) if c.get("r") else i: _text(c, shared, dates) for i, c in enumerate(row.iterfind("m:c", _NS))}
        finally:
            shared.close()


def stream_sheet(file, sheet: str | int) -> tuple[list[str], Iterator[list[str | None]]]:
    """Header and rows of a sheet, by name or by number from 0. The first row is the header; rows without any value are skipped."""
    rows = _rows(file, sheet)
    head = {i: v for i, v in next(rows, {}).items() if v not in (None, "")}
    return list(head.values()), ([r.get(i) for i in head] for r in rows if any(v is not None for v in r.values()))


def read_sheet(data: bytes, sheet: str | int) -> tuple[list[str], list[dict[str, str | None]]]:
    names, rows = stream_sheet(io.BytesIO(data), sheet)
    return names, [dict(zip(names, r)) for r in rows]


def scan_sheet(spark: SparkSession, path: str, sheet: str | int, batch_rows: int = 4096) -> tuple[list[str], DataFrame]:
    """Names of a sheet's columns, and its rows as c0, c1, ... and _row, read in a task. Where pyarrow does not reach the store, Spark
    hands the task the file, which then has to fit in a row."""
    import pyarrow as pa

    try:
        store_of(path)
        source, opened = spark.range(1, numPartitions=1).select("id"), False
    except Exception:
        source, opened = spark.read.format("binaryFile").load(path).select("content"), True

    def files(parts):
        for batch in parts:
            for value in batch.column(0):
                if opened:
                    yield io.BytesIO(value.as_py())
                else:
                    store, at = store_of(path)
                    with store.open_input_file(at) as f:
                        yield f

    def header(parts):
        for f in files(parts):
            yield pa.RecordBatch.from_arrays([pa.array(stream_sheet(f, sheet)[0], pa.string())], names=["name"])

    names = [r["name"] for r in source.mapInArrow(header, "name string").collect()]
    columns = [f"c{i}" for i in range(len(names))]

    def body(parts):
        for f in files(parts):
            rows, done = stream_sheet(f, sheet)[1], 0
            while some := list(islice(rows, batch_rows)):
                cells = [pa.array(c, pa.string()) for c in zip(*some)]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(range(done + 1, done + len(some) + 1), pa.int64())], names=[*columns, "_row"])
                done += len(some)

    return names, source.mapInArrow(body, ", ".join([*(f"{c} string" for c in columns), "_row long"]))
