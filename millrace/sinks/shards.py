"""A database that executors reach without a server: SQLite files in the shared folder, each opened by one task at a time.

A table's rows are dealt over the files by the columns it is made with.  A task that loads fetches its file, does the
batches that the file's ledger has not, each in one transaction with its line, and publishes the file under the number of lines
it then has; readers take the highest.  Attempts of a task do the same batches in the same order, so of two files of one load the
one with more lines holds all that the other does.  One load of a folder runs at a time; a task holds one file on its own disk.
"""

from __future__ import annotations

import json
import shutil
import sqlite3
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..errors import require
from ..workspace import unused

#: How values of Spark's types are kept; times as microseconds, dates as days, decimals as texts.
KEPT = {"bigint": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
#: Rows handed on at a time.
ROWS = 10_000


def _kept_as(kind: DataType) -> str:
    name = kind.simpleString()
    if name in ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp"):
        return "bigint"
    if name in ("float", "double"):
        return "double"
    require(name in ("string", "binary") or name.startswith("decimal"), f"no column type for {name}")
    return "binary" if name == "binary" else "string"


def _kept(c: Column, kind: DataType) -> Column:
    name = kind.simpleString()
    c = c.cast(kind)
    if name in ("float", "double"):
        return F.when(F.isnan(c), F.raise_error(F.lit("not-a-number has no place in a database")).cast("double")).otherwise(c.cast("double"))
    return {"date": F.unix_date, "timestamp": F.unix_micros}.get(name, lambda x: x.cast(_kept_as(kind)))(c)


def _given_back(c: Column, kind: DataType) -> Column:
    return {"date": lambda x: F.date_from_unix_date(x.cast("int")), "timestamp": F.timestamp_micros}.get(kind.simpleString(), lambda x: x.cast(kind))(c)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(store: fs.FileSystem, source, path: str) -> None:
    """A file in its place as a whole, whoever else writes it."""
    parent = path.rsplit("/", 1)[0]
    draft = f"{parent}/{uuid.uuid4().hex}.draft"
    store.create_dir(parent, recursive=True)
    with store.open_output_stream(draft) as out:
        shutil.copyfileobj(source, out)
    store.move(draft, path)


def _published(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".db"))


def _fetched(store: fs.FileSystem, folder: str, local: str) -> sqlite3.Connection:
    for path in _published(store, folder)[-1:]:
        with store.open_input_stream(path) as source, open(local, "wb") as out:
            shutil.copyfileobj(source, out)
    return sqlite3.connect(local, isolation_level=None)


class _Shard:
    """One file while a task loads it: rows are staged in a file beside it, then go batch by batch."""

    def __init__(self, folder: str, number: int, columns: list[str]):
        self.number, self.columns = number, columns
        self.store, root = _opened(folder)
        self.folder = f"{root}/shard-{number:06d}"
        self.own = tempfile.TemporaryDirectory()
        self.db = _fetched(self.store, self.folder, f"{self.own.name}/file")
        self.db.execute("ATTACH ? AS given", [f"{self.own.name}/given"])
        self.db.execute(f"CREATE TABLE given.load_rows (load_batch INTEGER, {', '.join(f'c{i}' for i in range(len(columns)))})")
        self.db.execute("CREATE INDEX given.load_i ON load_rows (load_batch)")
        self.db.execute("CREATE TABLE IF NOT EXISTS load_ledger (load_id TEXT, batch INTEGER, row_count INTEGER, PRIMARY KEY (load_id, batch))")

    def stage(self, rows: pa.RecordBatch) -> None:
        self.db.execute("BEGIN")
        self.db.executemany(f"INSERT INTO given.load_rows VALUES ({', '.join('?' * len(rows.columns))})", zip(*(c.to_pylist() for c in rows.columns)))
        self.db.execute("COMMIT")

    def load(self, table: str, kinds: list[str], load_id: str, keys: list[str] | None, retries: int, wait: float, before_commit: Callable[[int], list[str]] | None) -> int:
        name, into, given = quoted(table), ", ".join(map(quoted, self.columns)), ", ".join(f"s.c{i}" for i in range(len(self.columns)))
        self.db.execute(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(kinds)})")
        statements = [f"INSERT INTO {name} ({into}) SELECT {given} FROM given.load_rows s WHERE s.load_batch = :n"]
        if keys:
            at = {c: f"s.c{i}" for i, c in enumerate(self.columns)}
            self.db.execute(f"CREATE INDEX IF NOT EXISTS {quoted('by ' + ' '.join([table, *keys]))} ON {name} ({', '.join(map(quoted, keys))})")
            same = " AND ".join(f"{at[k]} = {name}.{quoted(k)}" for k in keys)
            values = ", ".join(f"{quoted(c)} = {at[c]}" for c in self.columns if c not in keys)
            statements[0] += f" AND NOT EXISTS (SELECT 1 FROM {name} WHERE {same})"
            if values:
                statements.insert(0, f"UPDATE {name} SET {values} FROM given.load_rows s WHERE s.load_batch = :n AND {same}")
        statements.append("INSERT INTO load_ledger SELECT :load, :n, count(*) FROM given.load_rows s WHERE s.load_batch = :n")
        done = {n for (n,) in self.db.execute("SELECT batch FROM load_ledger WHERE load_id = ?", [load_id])}
        left = [n for (n,) in self.db.execute("SELECT DISTINCT load_batch FROM given.load_rows ORDER BY 1") if n not in done]
        try:
            for number in left:
                for turn in range(retries + 1):
                    try:
                        self.db.execute("BEGIN IMMEDIATE")
                        for sql in statements:
                            self.db.execute(sql, {"n": number, "load": load_id} if ":load" in sql else {"n": number})
                        for sql in before_commit(number) if before_commit else []:
                            self.db.execute(sql)
                        self.db.execute("COMMIT")
                        break
                    except Exception:
                        if self.db.in_transaction:
                            self.db.execute("ROLLBACK")
                        if turn == retries:
                            raise
                        time.sleep(wait * 2**turn)
        finally:
            if left:
                self._publish()
        return len(left)

    def _publish(self) -> None:
        """What has been committed, also where a later batch has failed.  The file before stays for those who read it."""
        (lines,) = self.db.execute("SELECT count(*) FROM load_ledger").fetchone()
        self.db.close()
        if lines:
            with open(f"{self.own.name}/file", "rb") as source:
                _put(self.store, source, f"{self.folder}/{lines:012d}.db")
            for path in _published(self.store, self.folder)[:-2]:
                self.store.delete_file(path)

    def close(self) -> None:
        self.db.close()
        self.own.cleanup()


class Shards:
    """A database of `shards` files in a folder that pyarrow opens.  by: the columns by which a table's rows are dealt;
    else its first load's keys, or all columns.  Rows are merged by keys that hold those columns."""

    def __init__(self, spark: SparkSession, folder: str, by: dict[str, list[str]] | None = None, shards: int | None = None):
        self.spark, self.folder, self.by = spark, folder, by or {}
        self.shards = self._noted("database", {"shards": shards or int(spark.conf.get("spark.sql.shuffle.partitions"))})["shards"]

    def _noted(self, name: str, first: dict | None = None) -> dict | None:
        """A note of the folder, made with `first` if it is not there."""
        store, root = _opened(self.folder)
        path = f"{root}/{name}.json"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            if first is None:
                return None
            _put(store, pa.BufferReader(json.dumps(first).encode()), path)
        with store.open_input_stream(path) as source:
            return json.loads(source.read())

    def exists(self, table: str) -> bool:
        return self._noted(f"tables/{quote(table.lower(), safe='')}") is not None

    def _schema(self, table: str, first: dict | None = None) -> tuple[StructType, list[str]]:
        noted = self._noted(f"tables/{quote(table.lower(), safe='')}", first)
        require(noted is not None, f"no table {table}")
        return StructType.fromJson(noted["schema"]), noted["by"]

    def read(self, table: str) -> DataFrame:
        schema, _ = self._schema(table)
        folder, kinds = self.folder, [_kept_as(f.dataType) for f in schema]
        columns = ", ".join(quoted(f.name) for f in schema)

        def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = _opened(folder)
            for number in (n for batch in it for n in batch.column(0).to_pylist()):
                with tempfile.TemporaryDirectory() as own:
                    db = _fetched(store, f"{root}/shard-{number:06d}", f"{own}/file")
                    try:
                        if db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND lower(name) = ?", [table.lower()]).fetchone():
                            found = db.execute(f"SELECT {columns} FROM {quoted(table)}")
                            while some := found.fetchmany(ROWS):
                                yield pa.RecordBatch.from_arrays([pa.array(v, ARROW[k]) for v, k in zip(zip(*some), kinds)], [f"c{i}" for i in range(len(kinds))])
                    finally:
                        db.close()

        found = self.spark.range(0, self.shards, 1, self.shards).mapInArrow(rows, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
        return found.select(*[_given_back(F.col(f"c{i}"), f.dataType).alias(f.name) for i, f in enumerate(schema)])

    def load(self, rows: DataFrame, table: str, load_id: str, keys: list[str] | None, batch_rows: int, retries: int, wait: float, types: dict[str, str] | None, before_commit: Callable[[int], list[str]] | None) -> int:
        """As `database.load`, whose rows are written by now.  Batches have numbers of their own in each file; of them, those count that have rows."""
        columns, folder = rows.columns, self.folder
        schema, by = self._schema(table, {"schema": rows.schema.jsonValue(), "by": self.by.get(table) or keys or columns})
        have = {f.name.lower(): f for f in schema}
        require(all(c.lower() in have for c in columns), f"{table} has not all of the columns {columns}")
        require(not keys or {c.lower() for c in by} <= {k.lower() for k in keys}, f"{table} is dealt by {by}, which are not all among the keys {keys}")
        require({c.lower() for c in by} <= {c.lower() for c in columns}, f"{table} is dealt by {by}, which the rows have not all")
        given = {k.lower(): v for k, v in (types or {}).items()}
        kinds = [f"{quoted(f.name)} {given.get(f.name.lower(), KEPT[_kept_as(f.dataType)])}" for f in schema]
        # in another load of this name the batches are the same, whatever batch_rows it is given
        each = self._noted(f"loads/{quote(load_id, safe='')}", {"each": max(1, -(-rows.count() // (self.shards * batch_rows)))})["each"]
        shard, batch = (unused(columns, x) for x in ("load_shard", "load_batch"))
        kept = rows.select(*[_kept(F.col(c), have[c.lower()].dataType).alias(c) for c in columns])
        kept = kept.withColumn(shard, F.pmod(F.xxhash64(*by), F.lit(self.shards)))
        kept = kept.withColumn(batch, F.col(shard) * each + F.pmod(F.xxhash64(F.lit("batch"), *(keys or columns)), F.lit(each)))
        kept = kept.select(shard, batch, *columns).repartition(self.shards, shard).sortWithinPartitions(shard, batch)

        def loading(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current: _Shard | None = None
            done = lambda: pa.RecordBatch.from_arrays([pa.array([current.load(table, kinds, load_id, keys, retries, wait, before_commit)], pa.int64())], ["batches"])
            try:
                for some in it:
                    numbers = some.column(0).to_numpy()
                    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                    for a, b in zip(cuts, cuts[1:]):
                        if a < b and (current is None or current.number != numbers[a]):
                            if current is not None:
                                yield done()
                                current.close()
                            current = _Shard(folder, int(numbers[a]), columns)
                        if a < b:
                            current.stage(pa.RecordBatch.from_arrays(some.columns[1:], names=some.schema.names[1:]).slice(a, b - a))
                if current is not None:
                    yield done()
            finally:
                if current is not None:
                    current.close()

        return kept.mapInArrow(loading, "batches long").agg(F.coalesce(F.sum("batches"), F.lit(0))).first()[0]
