"""Delimited files with columns of their own for each partition, written by tasks and published when all have ended.

A data source writer: tasks write drafts into a folder that readers pass over and send what they have written; the
commit moves all of it to its place, an abort removes the folder.  A failed or repeated task leaves no file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..errors import RESERVED, require
from ..functions.text import delimited_text
from ..workspace import unused


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # (draft, place)
    rows: int = 0


def _local(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.delimiter, self.header = options["path"], options["delimiter"], options["header"] == "true"
        self.layouts: dict[str, list[list]] = json.loads(options["layouts"])
        self.default: list[list] | None = json.loads(options["default"])
        self.names: list[str] = json.loads(options["names"])
        self.run = options["run"]

    def cell(self, value: str | None) -> str:
        """Nothing for null; what holds the delimiter, a quote, a line break or blanks at an end, and an empty text, in quotes."""
        if value is None:
            return ""
        if value == "" or value != value.strip() or any(c in value for c in (self.delimiter, '"', "\n", "\r")):
            return '"' + value.replace('"', '""') + '"'
        return value

    def write(self, rows: Iterator[Row]) -> Written:
        """One file for each partition value that the task has; its rows come sorted by that, so that one file is open."""
        store, root = _local(self.path)
        out, message, current, mark = None, Written(), None, uuid.uuid4().hex
        at = {n: i + 1 for i, n in enumerate(self.names)}
        layout: list[int | None] = []
        store.create_dir(f"{root}/_drafts-{self.run}", recursive=True)
        try:
            for row in rows:
                key = row[0] if row[0] is not None else ""
                if out is None or key != current:
                    if out is not None:
                        out.close()
                    current = key
                    columns = self.layouts.get(key, self.default)
                    if columns is None:
                        raise ValueError(f"no columns are given for the partition {key!r}")
                    draft = f"{root}/_drafts-{self.run}/{mark}-{len(message.files)}.csv"
                    out = store.open_output_stream(draft)
                    message.files.append((draft, f"{root}/{quote(key, safe='') or '__empty'}/part-{mark}.csv"))
                    layout = [at[source] for _, source in columns]
                    if self.header:
                        out.write((self.delimiter.join(self.cell(title) for title, _ in columns) + "\r\n").encode())
                out.write((self.delimiter.join([self.cell(row[i]) for i in layout]) + "\r\n").encode())
                message.rows += 1
        finally:
            if out is not None:
                out.close()
        return message

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _local(self.path)
        for message in messages:
            for draft, place in message.files if message else ():
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                store.move(draft, place)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _local(self.path)
        if store.get_file_info(f"{root}/_drafts-{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_drafts-{self.run}")


class PartitionedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "partitioned_delimited"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


Layout = dict[str, str] | list[str]


def write_dynamic(df: DataFrame, path: str, partition: Column, layouts: dict[str, Layout], default: Layout | None = None, delimiter: str = ";", header: bool = True) -> DataFrame:
    """Delimited files below path, a folder for each value of `partition` (as text), each with its own columns; returns df.

    layouts: partition to its columns, title to source, in order; `default` for the others, without which another
    partition fails the write.  A null or empty partition goes to __empty.  Rows are sorted by partition in their task
    and not shuffled, so a partition that most rows have is written by many tasks."""
    named = lambda x: [[t, s] for t, s in (x if isinstance(x, dict) else {c: c for c in x}).items()]
    plain = {k: named(v) for k, v in layouts.items()}
    other = named(default) if default is not None else None
    used = list(dict.fromkeys(s for columns in [*plain.values(), *([other] if other else [])] for _, s in columns))
    unknown = [c for c in used if c not in df.columns or c in RESERVED]
    require(not unknown, f"no such columns: {unknown}")
    key = unused(df, "partition")
    texts = [delimited_text(F.col(c), df.schema[c].dataType.simpleString()).alias(c) for c in used]
    rows = df.select(F.coalesce(partition.cast("string"), F.lit("")).alias(key), *texts).sortWithinPartitions(key)
    df.sparkSession.dataSource.register(PartitionedFiles)
    options = {"path": path, "delimiter": delimiter, "header": str(header).lower(), "layouts": json.dumps(plain), "default": json.dumps(other), "names": json.dumps(used), "run": uuid.uuid4().hex}
    rows.write.format("partitioned_delimited").options(**options).mode("append").save()
    return df
