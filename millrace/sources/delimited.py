"""Delimited text with typed columns and errors kept beside the data."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ERRORS, InvalidParameter, require, set_errors, with_errors
from ..operators.filters import remove_blank_rows, remove_rows_with_error

_ABSENT = "\u0001"  # no file has this as a cell, so that empty quoted cells stay apart from null


@dataclass(frozen=True)
class ReadColumn:
    """How a column is read: its source name, converter and what to do about nulls and failures.

    on_null / on_failure: keep, wrap (an error) or value (the given one)."""

    name: str
    converter: Callable[..., Column] | None = None
    source: str | None = None
    options: dict = field(default_factory=dict)
    on_null: str = "keep"
    null_value: object = None
    on_failure: str = "wrap"
    failure_value: object = None


def apply_columns(rows: DataFrame, columns: list[ReadColumn], keep_others: bool = False, step: str = "read") -> DataFrame:
    """rows with each column taken from its source, converted under its policies."""
    have = {c.lower(): c for c in rows.columns}
    out, failed = [], {}
    for c in columns:
        source = have.get((c.source or c.name).lower())
        if source is None:
            out.append(F.lit(None).cast("string").alias(c.name))
            continue
        old, kind = F.col(source), rows.schema[source].dataType.simpleString()
        if c.converter is None:
            new = old
        elif "of" in c.converter.__code__.co_varnames:
            new = c.converter(old, of=kind, **c.options)
        else:
            new = c.converter(old, **c.options)
        absent, wrong = old.isNull(), old.isNotNull() & new.isNull()
        if c.on_null == "value":
            new = F.when(absent, F.lit(c.null_value)).otherwise(new)
        if c.on_failure == "value":
            new = F.when(wrong, F.lit(c.failure_value)).otherwise(new)
        bad = (absent if c.on_null == "wrap" else F.lit(False)) | (wrong if c.on_failure == "wrap" and c.converter else F.lit(False))
        failed[c.name] = (bad, old)
        out.append(new.alias(c.name))
    rows = with_errors(rows)
    used = {(c.source or c.name).lower() for c in columns} | {c.name.lower() for c in columns}
    others = [c for c in rows.columns if c.lower() not in used and c != ERRORS] if keep_others else []
    return rows.select(*out, *others, set_errors(failed, "invalid value", step).alias(ERRORS))


#: A line that ends inside a quoted cell, if it does not begin inside one: the last quoted cell's quotes are all doubled.
_OPEN_AT_END = '(^|{0})"([^"]|"")*$'


def _leaves_open(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a line that begins inside a quoted cell, or at a cell's start, ends inside one.  A quote opens a cell only at its start."""
    i, opening = 0, delimiter + b'"'
    if not inside:
        if not line.startswith(b'"'):
            i = line.find(opening)
            if i < 0:
                return False
            i += len(delimiter)
        i += 1
    while True:
        i = line.find(b'"', i)
        while i >= 0 and line[i + 1 : i + 2] == b'"':
            i = line.find(b'"', i + 2)
        if i < 0:
            return True
        i = line.find(opening, i + 1)
        if i < 0:
            return False
        i += len(opening)


def _cells(record: str, delimiter: str, keep_quotes: bool) -> list[str | None]:
    """Cells of a record: nothing is null, a pair of quotes an empty text; doubled quotes in a quoted cell are one."""
    if '"' not in record:
        return [c or None for c in record.split(delimiter)]
    out: list[str | None] = []
    i, n = 0, len(record)
    while i <= n:
        if not record.startswith('"', i):
            k = record.find(delimiter, i)
            k = n if k < 0 else k
            out.append(record[i:k] or None)
        else:
            j = record.find('"', i + 1)
            while j >= 0 and record[j + 1 : j + 2] == '"':
                j = record.find('"', j + 2)
            j = n if j < 0 else j
            k = record.find(delimiter, j + 1)
            k = n if k < 0 else k
            cell = '"' + record[i + 1 : j].replace('""', '"') + record[j:k]
            out.append(cell[1:-1] if not keep_quotes and len(cell) > 1 and cell[-1] == '"' else cell)
        i = k + len(delimiter)
    return out


@dataclass(frozen=True)
class _Form:
    """How bytes become lines and texts.  wide: a line break has several bytes, so that a file is one piece."""

    sep: str
    encoding: str
    wide: bool

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
        """(file, block, lines) of each piece in a task, in order."""

        def lines() -> Iterator[tuple[tuple[str, int], bytes]]:
            for batch in batches:
                for line, file, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if not self.wide:
                        yield (file, block), line
                        continue
                    cut = line.decode(self.encoding).split(self.sep)
                    for part in cut if cut[-1] else cut[:-1]:
                        yield (file, block), part.encode()

        for (file, block), group in groupby(lines(), key=lambda x: x[0]):
            yield file, block, (line for _, line in group)

    def text(self, record: bytes) -> str:
        text = record.decode("utf-8" if self.wide else self.encoding)
        return text[:-1] if self.sep == "\n" and text.endswith("\r") else text


class _Lines:
    """The lines of files, in order within each block that Spark reads as a piece."""

    def __init__(self, spark: SparkSession, path: str | list[str], line_break: str | None, encoding: str, missing_ok: bool):
        wide = encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32"))
        self.form = form = _Form("\n" if line_break in (None, "\n", "\r\n") else line_break, encoding, wide)
        if form.wide:
            files = spark.read.format("binaryFile").option("ignoreMissingFiles", missing_ok).load(path)
            self.rows = files.select(F.col("content").alias("line"), F.col("path").alias("file"), F.lit(0).cast("long").alias("block"))
        else:
            texts = spark.read.option("lineSep", form.sep).option("ignoreMissingFiles", missing_ok).text(path)
            self.rows = texts.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def facts(self, delimiter: str, first: bool) -> list:
        """(file, its first line, whether a line ends inside a cell) of each file: a row a file."""
        text = F.col("line").cast("string")
        start = F.min_by("line", F.when(F.col("block") == 0, F.col("at"))) if first else F.lit(None).cast("binary")
        rows = self.rows.withColumn("at", F.monotonically_increasing_id())
        return rows.groupBy("file").agg(start.alias("first"), F.max(text.rlike(_OPEN_AT_END.format(re.escape(delimiter)))).alias("open")).collect()


def _first_cells(form: _Form, line: bytes | None, delimiter: str) -> list[str]:
    text = form.text(line or b"").removeprefix("\ufeff")
    return [(c or "").strip('"') for c in _cells(text, delimiter, False)]


@dataclass(frozen=True)
class _Piece:
    """How a piece of a file begins: inside a cell or not, and the number of the next record that starts in it."""

    inside: bool
    record: int
    last: bool


def _surveyed(lines: _Lines, delimiter: str, skip_lines: int, header: bool) -> tuple[dict[tuple[str, int], _Piece], dict[str, list[str]], bool]:
    """Where each piece begins, each file's header, and whether a record reaches over pieces.

    Each piece is gone through once for both ways it may begin, which gives for either how it ends
    and how many records start in it; these, a row a piece, are composed along each file."""
    mark, form = delimiter.encode(), lines.form

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, found in form.pieces(batches):
            states, starts, head, held = [False, True], [0, 0], None, []
            for i, line in enumerate(found):
                if block == 0 and i < skip_lines:
                    continue
                starts = [n + (not s) for n, s in zip(starts, states)]
                if b'"' in line:
                    states = [_leaves_open(line, s, mark) for s in states] if states[0] != states[1] else [_leaves_open(line, states[0], mark)] * 2
                if block == 0 and header and head is None:
                    held.append(line)
                    if not states[0]:
                        head = form.sep.encode().join(held)
            if head is None and held:
                head = form.sep.encode().join(held)
            columns = [[file], [block], [starts[0]], [starts[1]], [states[0]], [states[1]], [head]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "starts", "starts_inside", "open", "open_inside", "head"])

    schema = "file string, block long, starts long, starts_inside long, open boolean, open_inside boolean, head binary"
    rows = sorted(lines.rows.mapInArrow(piece, schema).collect(), key=lambda r: (r.file, r.block))  # a row a piece of a file, as the scan's own plan holds
    pieces, headers, over = {}, {}, False
    for file, group in groupby(rows, key=lambda r: r.file):
        inside, record, group = False, 0, list(group)
        for i, r in enumerate(group):
            pieces[file, r.block] = _Piece(inside, record, i == len(group) - 1)
            over = over or inside
            if r.head is not None:
                headers[file] = [(c or "").strip('"') for c in _cells(form.text(r.head).removeprefix("\ufeff"), delimiter, False)]
            record += r.starts_inside if inside else r.starts
            inside = r.open_inside if inside else r.open
    return pieces, headers, over


def _records(form: _Form, file: str, block: int, start: _Piece, found: Iterator[bytes], delimiter: bytes, skip_lines: int) -> Iterator[tuple[int, bytes, bool]]:
    """(number, bytes, whether it is whole) of a piece's records: what begins before it or ends behind it is a part."""
    sep, inside, number, part = form.sep.encode(), start.inside, start.record, start.inside
    held: list[bytes] = []
    for i, line in enumerate(found):
        if block == 0 and i < skip_lines:
            continue
        if not inside:
            number += 1
        held.append(line)
        if b'"' in line:
            inside = _leaves_open(line, inside, delimiter)
        if not inside:
            yield number - 1, sep.join(held), not part
            held, part = [], False
    if held:
        yield number - 1, sep.join(held), start.last and not part


def _by_pieces(lines: _Lines, pieces: dict, over: bool, places: dict[str, list[int]] | None, width: int, delimiter: str, skip_lines: int, keep_quotes: bool) -> DataFrame:
    """(file, row, cells) of every record, the header too; cells in the order of all columns.  Records that reach over pieces are put together."""
    form = lines.form
    mark, sep = delimiter.encode(), form.sep.encode()

    def arranged(file: str, number: int, record: bytes) -> list[str | None]:
        text = form.text(record)
        cells = _cells(text.removeprefix("\ufeff") if number == 0 else text, delimiter, keep_quotes)
        if places is None:
            return cells
        out: list[str | None] = [None] * width
        for at, cell in zip(places.get(file, ()), cells):
            if at >= 0:
                out[at] = cell
        return out

    def run(whole: bool):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for file, block, found in form.pieces(batches):
                chosen = (r for r in _records(form, file, block, pieces[file, block], found, mark, skip_lines) if r[2] == whole)
                while some := list(islice(chosen, 1000)):
                    columns = [pa.array([file] * len(some)), pa.array([n for n, _, _ in some], pa.int64())]
                    if whole:
                        columns.append(pa.array([arranged(file, n, r) for n, r, _ in some], pa.list_(pa.string())))
                        yield pa.RecordBatch.from_arrays(columns, ["file", "row", "cells"])
                    else:
                        columns += [pa.array([block] * len(some), pa.int64()), pa.array([r for _, r, _ in some], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["file", "row", "block", "part"])

        return read

    rows = lines.rows.mapInArrow(run(True), "file string, row long, cells array<string>")
    if not over:
        return rows
    parts = lines.rows.mapInArrow(run(False), "file string, row long, block long, part binary").groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, numbers, found = (batch.column(i).to_pylist() for i in range(3))
            cells = [arranged(f, n, sep.join(x["part"] for x in p)) for f, n, p in zip(files, numbers, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], ["file", "row", "cells"])

    return rows.union(parts.mapInArrow(joined, "file string, row long, cells array<string>"))


def cells_hold_breaks(spark: SparkSession, path: str | list[str], line_break: str | None, encoding: str, delimiter: str = ";") -> bool:
    """Whether a line may end inside a quoted cell."""
    return any(r.open for r in _Lines(spark, path, line_break, encoding, False).facts(delimiter, False))


def _same(names: list[str]) -> list[str]:
    return [n.lower() for n in names]


def _all_names(headers: dict[str, list[str]]) -> tuple[list[str], dict[str, list[int]]]:
    """The columns of all files, by first file, and where each file's cells go (-1: a cell without a name)."""
    at: dict[str, int] = {}
    names: list[str] = []
    places: dict[str, list[int]] = {}
    for file in sorted(headers):
        own = [n for n in _same(headers[file]) if n]
        if len(own) != len(set(own)):
            raise InvalidParameter(f"duplicate column in the header of {file}: {headers[file]}")
        for n in headers[file]:
            if n and n.lower() not in at:
                at[n.lower()] = len(names)
                names.append(n)
        places[file] = [at[n.lower()] if n else -1 for n in headers[file]]
    return names, places


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    columns: list[ReadColumn] | None = None,
    header: str = "has",
    names: list[str] | None = None,
    delimiter: str = ";",
    line_break: str | None = "\r\n",
    encoding: str = "utf-8",
    multi_line: bool | None = None,
    file_column: str | None = None,
    row_column: str | None = None,
    skip_lines: int = 0,
    keep_quotes: bool = False,
    keep_blank: bool = False,
    drop_errors: bool = False,
    missing_ok: bool = False,
) -> DataFrame:
    """Rows of delimited files: a quote opens a cell at its start only, quotes in it are doubled, cells may hold line
    breaks; an unquoted empty cell is null and a quoted one an empty text.  header: has, none or ignore (both with `names`).

    Each file's cells go by its own header; a column that a file lacks is null.  Cells beyond the header are dropped.
    Large files are split, whether cells hold line breaks or not; a pass over the lines looks for that if multi_line
    does not say.  skip_lines come before the header; keep_quotes keeps those around cells; row_column is a record's number in its file, from 0."""
    require(header in ("has", "none", "ignore"), f"no such header mode: {header}")
    lines = _Lines(spark, path, line_break, encoding, missing_ok)
    by_pieces = bool(skip_lines or keep_quotes or row_column or multi_line or lines.form.wide)
    headers: dict[str, list[str]] = {}
    if not by_pieces and (header == "has" or multi_line is None):
        facts = lines.facts(delimiter, header == "has")
        by_pieces = multi_line is None and any(r.open for r in facts)
        if header == "has":
            headers = {r.file: _first_cells(lines.form, r["first"], delimiter) for r in facts}
            by_pieces = by_pieces or len({tuple(h) for h in headers.values()}) > 1
    if by_pieces:
        pieces, headers, over = _surveyed(lines, delimiter, skip_lines, header == "has")
    places = None
    if header == "has":
        names, places = _all_names(headers)
    require(bool(names), "column names are needed")
    if by_pieces:
        parsed = _by_pieces(lines, pieces, over, places, len(names), delimiter, skip_lines, keep_quotes)
        first = 1 if header != "none" else 0
        extra = [F.col("file").alias(file_column)] if file_column else []
        extra += [(F.col("row") - first).alias(row_column)] if row_column else []
        rows = parsed.where(F.col("row") >= first).select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], *extra)
    else:
        kept = [n or f"__unnamed{i}" for i, n in enumerate(next(iter(headers.values())) if header == "has" else names)]
        rows = _split(spark, path, kept, header, delimiter, line_break, encoding, missing_ok)
        rows = rows.withColumn(file_column, F.col("_metadata.file_path")) if file_column else rows
        rows = rows.drop(*[n for n in kept if n.startswith("__unnamed")])
    places = [c for c in (file_column, row_column) if c]
    if columns is not None:
        rows = apply_columns(rows, columns + [ReadColumn(c) for c in places])
    rows = rows if keep_blank else remove_blank_rows(rows, ignoring=places)
    return remove_rows_with_error(rows) if drop_errors else rows


def _split(spark: SparkSession, path: str | list[str], kept: list[str], header: str, delimiter: str, line_break: str | None, encoding: str, missing_ok: bool) -> DataFrame:
    """All columns as texts, read by Spark's own reader, line by line."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in kept])
    reader = spark.read.schema(schema).option("sep", delimiter).option("quote", '"').option("escape", '"').option("header", header != "none")
    reader = reader.option("enforceSchema", True).option("emptyValue", "").option("nullValue", _ABSENT).option("encoding", encoding).option("multiLine", False)
    reader = reader.option("ignoreMissingFiles", missing_ok)
    if line_break:
        reader = reader.option("lineSep", line_break)
    return reader.csv(path)
