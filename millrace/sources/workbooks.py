"""Workbooks (xlsx): rows of sheets and lists of sheets, each file read in a task."""

from __future__ import annotations

import io
import re
import zipfile
from typing import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StepFailed, require

# Namespaces of the open workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SCHEMA = "file string, sheet int, name string, visible boolean, row int, cells array<string>"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, unmerge: bool) -> Iterator[tuple[int, str, bool, int, list[str | None]]]:
    """(sheet, name, visible, row, cells) of every row; a sheet without rows has one without cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
            target = targets[sheet.get(f"{REL}id")].lstrip("/")
            tree = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            grid: dict[int, dict[int, str | None]] = {}
            for cell in tree.iter(f"{MAIN}c"):
                kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                else:
                    text = value.text if value is not None else None
                    text = shared[int(text)] if kind == "s" and text is not None else text
                at = cell.get("r")
                grid.setdefault(int(re.search(r"\d+", at)[0]), {})[_column(at)] = text
            for merged in tree.iter(f"{MAIN}mergeCell") if unmerge else ():
                a, b = (merged.get("ref").split(":") * 2)[:2]
                (r1, c1), (r2, c2) = ((int(re.search(r"\d+", x)[0]), _column(x)) for x in (a, b))
                for r in range(r1, r2 + 1):
                    for c in range(c1, c2 + 1):
                        grid.setdefault(r, {})[c] = grid.get(r1, {}).get(c1)
            visible = sheet.get("state", "visible") == "visible"
            for r in sorted(grid):
                yield number, sheet.get("name"), visible, r, [grid[r].get(c) for c in range(max(grid[r]) + 1)]
            if not grid:
                yield number, sheet.get("name"), visible, 0, []


def _cells(spark: SparkSession, path: str | list[str], unmerge: bool = True) -> DataFrame:
    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [(name, *r) for r in sheet_rows(content.as_py(), unmerge)]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], ["file", "sheet", "name", "visible", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, _SCHEMA)


def list_sheets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _cells(spark, path).select("file", "sheet", "name", "visible").distinct()


def _names(heads: list[list[str | None]], first: int, mode: str, separator: str) -> list[str]:
    """Column names of a sheet from its header rows; "" for a column without one.  A repeated name gets the next free number."""
    names: list[str] = []
    for c in range(first, max(map(len, heads), default=0)):
        parts = [h[c].strip() for h in heads if c < len(h) and h[c] and h[c].strip()]
        name = "" if not parts else {"join": separator.join(dict.fromkeys(parts)), "first": parts[0], "last": parts[-1]}[mode]
        taken, i, distinct = {n.lower() for n in names}, 1, name
        while name and distinct.lower() in taken:
            distinct, i = f"{name}{i}", i + 1
        names.append(distinct)
    return names


def read_workbook(
    spark: SparkSession,
    path: str | list[str],
    sheet: str | int = 0,
    header_rows: list[int] = (1,),
    join_headers: str = " ",
    first_row: int | None = None,
    first_column: int = 1,
    unmerge: bool = True,
    trim: bool = True,
    header_mode: str = "join",
    file_column: str = "file",
    row_column: str = "row",
) -> DataFrame:
    """Rows of one sheet as texts; empty texts are null, rows without a text are left out.

    Each file goes by its own header, a column that it lacks is null.  header_mode: of a column's cells in several header
    rows, join all (equal ones once), or take the first or the last.  A file that lacks the sheet, or its header, gives
    no rows; if all do, that is an error.  A pass over the files finds the columns of all."""
    require(header_mode in ("join", "first", "last"), f"no such header mode: {header_mode}")
    start, first, heads = first_row or max(header_rows) + 1, first_column - 1, set(header_rows)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = [r for r in sheet_rows(content.as_py(), unmerge) if (r[1] == sheet if isinstance(sheet, str) else r[0] == sheet)]
                names = _names([r[4] for r in own if r[3] in heads], first, header_mode, join_headers)
                if not any(names):
                    continue
                made = [(0, names)]  # the header itself, for the columns of all files
                for _, _, _, number, cells in own:
                    values = [((c.strip() if trim else c) or None) if c is not None else None for c in cells]
                    if number >= start and any(v and v.strip() for v in values):
                        made.append((number, (values[first:] + [None] * len(names))[: len(names)]))
                columns = [pa.array([file] * len(made)), pa.array([n for n, _ in made], pa.int32()), pa.array([names] * len(made), pa.list_(pa.string())), pa.array([c for _, c in made], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "row", "names", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(rows, "file string, row int, names array<string>, cells array<string>")
    headers = found.where("row = 0").select("file", "names").groupBy("names").agg(F.min("file").alias("file")).collect()  # a row for each header that differs
    names: dict[str, str] = {}
    for header in sorted(headers, key=lambda h: h.file):
        for n in header["names"]:
            if n:
                names.setdefault(n.lower(), n)
    if not names:
        raise StepFailed(f"no sheet {sheet} with a header")
    at = lambda n: F.get("cells", (F.array_position(F.transform("names", F.lower), n) - 1).cast("int"))
    place = lambda n: F.when(F.array_contains(F.transform("names", F.lower), n), at(n))
    return found.where("row > 0").select(F.col("file").alias(file_column), F.col("row").alias(row_column), *[place(low).alias(n) for low, n in names.items()])
