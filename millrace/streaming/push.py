"""A push source with heartbeats: producers append segments to a spool, a stream reads, replays and commits them.

A segment is an Arrow file whose name says its number and rows; it appears whole, by a rename.  An offset is
the number of the next segment, the rows before it and the heartbeats so far, so that what a batch holds
can be told from its two offsets, and a restarted stream replays it alike.  When no row comes, a heartbeat does: its
row wakes whatever waits behind the source, as sinks that flush.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import TAG, require

HEARTBEAT, BEAT = "heartbeat", "__beat"
BEAT_TYPE = "struct<index:bigint,row_count:bigint,at_ms:bigint>"
_BEAT = pa.struct([("index", pa.int64()), ("row_count", pa.int64()), ("at_ms", pa.int64())])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Spool:
    """A folder of segments.  One producer at a time appends; a Spark job may write many segments at once."""

    def __init__(self, path: str):
        self.path = path
        self.files, self.root = _opened(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)

    def segments(self) -> dict[int, int]:
        """Rows of each segment by its number."""
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        names = [f.base_name.removesuffix(".arrow") for f in found if f.base_name.endswith(".arrow")]
        return {int(a): int(b) for a, b in (n.split("-") for n in names)}

    def write(self, number: int, batches: list[pa.RecordBatch], schema: pa.Schema) -> int:
        """Writes a segment; a number that is there already is not written again, so that a repeated task adds nothing."""
        rows = sum(b.num_rows for b in batches)
        self.files.create_dir(self.root, recursive=True)
        draft = f"{self.root}/_{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as out, pa.ipc.new_stream(out, schema) as writer:
            for batch in batches:
                writer.write_batch(batch)
        if number in self.segments():
            self.files.delete_file(draft)
        else:
            self.files.move(draft, f"{self.root}/{number:012d}-{rows}.arrow")
        return rows

    def push(self, rows: pa.Table, number: int | None = None) -> int:
        """Appends rows as a segment, the next one unless said; returns its number."""
        number = self.next_number() if number is None else number
        self.write(number, rows.to_batches(), rows.schema)
        return number

    def next_number(self) -> int:
        """The number behind all segments, those too that readers have removed."""
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        readers = [f.base_name.removesuffix(".json") for f in found if f.base_name.endswith(".json")]
        return max([n + 1 for n in self.segments()] + [self.place(r)["segment"] for r in readers], default=0)

    def read(self, number: int, rows: int) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_stream(f"{self.root}/{number:012d}-{rows}.arrow") as source, pa.ipc.open_stream(source) as reader:
            yield from reader

    def place(self, reader: str) -> dict | None:
        """The offset that a reader has committed last."""
        if self.files.get_file_info(f"{self.root}/{reader}.json").type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(f"{self.root}/{reader}.json") as source:
            return json.loads(source.read())

    def committed(self, reader: str, offset: dict) -> None:
        draft = f"{self.root}/_{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as out:
            out.write(json.dumps(offset).encode())
        self.files.move(draft, f"{self.root}/{reader}.json")

    def remove(self, before: int) -> None:
        for number, rows in self.segments().items():
            if number < before:
                self.files.delete_file(f"{self.root}/{number:012d}-{rows}.arrow")


def push_table(df: DataFrame, path: str, segments: int, first: int | None = None) -> None:
    """Rows of df as so many segments from `first`, the next number unless said: a task writes one whole.  Empty segments are written too, as a
    gap would end the stream there."""
    first = Spool(path).next_number() if first is None else first

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        number = first + TaskContext.get().partitionId()
        rows = Spool(path).write(number, held, held[0].schema if held else pa.schema([]))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows], pa.int64())], ["number", "rows"])

    df.repartition(segments).mapInArrow(write, "number long, rows long").write.format("noop").mode("overwrite").save()


class _Segment(InputPartition):
    def __init__(self, number: int, rows: int):
        self.number, self.rows = number, rows


class _Beats(InputPartition):
    def __init__(self, first: int, last: int, row_count: int, at_ms: int):
        self.first, self.last, self.row_count, self.at_ms = first, last, row_count, at_ms


class _Reader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.spool, self.beat_ms = Spool(options["path"]), int(options.get("heartbeatms", 0))
        self.most = int(options.get("maxsegments", 0))
        self.keep = options.get("keep", "false").lower() == "true"
        self.name, self.schema = options.get("reader", "reader"), schema
        self.at: dict | None = None  # where the last batch ended
        self.last_beat = time.monotonic()

    def initialOffset(self) -> dict:
        """Where a stream without a checkpoint begins: at the first segment that is there."""
        known = self.spool.segments()
        start = min(known) if known else (self.spool.place(self.name) or {"segment": 0})["segment"]
        return {"segment": start, "rows": 0, "beat": 0, "at_ms": 0}

    def latestOffset(self) -> dict:
        """The end of the segments that are there without a gap; a heartbeat more, if it is time for one and no row came."""
        known = self.spool.segments()
        # Spark asks without saying where it is: a restarted stream is where it committed last, or a batch on,
        # so that its first batch has no cap
        most = self.most if self.at else 0
        at = self.at or self.spool.place(self.name) or self.initialOffset()
        number, rows, beat, at_ms = at["segment"], at["rows"], at["beat"], at["at_ms"]
        while number in known and (not most or number - at["segment"] < most):
            rows += known[number]
            number += 1
        now = time.monotonic()
        if number > at["segment"]:
            self.last_beat = now
        elif self.beat_ms and (now - self.last_beat) * 1000 >= self.beat_ms:
            beat, self.last_beat, at_ms = beat + 1, now, int(time.time() * 1000)
        self.at = {"segment": number, "rows": rows, "beat": beat, "at_ms": at_ms}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = self.spool.segments()
        lost = [n for n in range(start["segment"], end["segment"]) if n not in known]
        if lost:
            raise FileNotFoundError(f"segments {lost[:5]} of {self.spool.path} are gone")
        out: list[InputPartition] = [_Segment(n, known[n]) for n in range(start["segment"], end["segment"])]
        if end["beat"] > start["beat"]:
            out.append(_Beats(start["beat"] + 1, end["beat"], end["rows"], end["at_ms"]))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if isinstance(partition, _Beats):
            n = partition.last - partition.first + 1
            beats = pa.array([{"index": i, "row_count": partition.row_count, "at_ms": partition.at_ms} for i in range(partition.first, partition.last + 1)], _BEAT)
            made = {TAG: pa.array([HEARTBEAT] * n), BEAT: beats}
            yield pa.RecordBatch.from_arrays([made.get(f.name, None) if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)
            return
        for batch in self.spool.read(partition.number, partition.rows):
            columns = [pa.nulls(batch.num_rows, f.type) if f.name in (TAG, BEAT) and f.name not in batch.schema.names else batch.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def commit(self, end: dict) -> None:
        self.spool.committed(self.name, end)
        if not self.keep:
            self.spool.remove(end["segment"])


class PushSource(DataSource):
    """format("push"): options path, heartbeatMs, maxSegments (of a batch, but for the
    first after a start), keep (segments stay after the
    commit) and reader (the name of a stream among several that keep the segments)."""

    @classmethod
    def name(cls) -> str:
        return "push"

    def schema(self) -> str:
        raise ValueError("a push source needs a schema")

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(schema, self.options)


def listen(spark: SparkSession, path: str, schema: T.StructType | str, heartbeat_ms: int = 1000, max_segments: int | None = None, keep: bool = False, reader: str = "reader") -> DataFrame:
    """Rows that are pushed to a spool, as a stream; between them heartbeat rows, tagged so, whose other columns are null.

    heartbeat_ms: the time without rows after which one comes, 0 for never."""
    spark.dataSource.register(PushSource)
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    require(not {TAG, BEAT} & set(fields.fieldNames()), f"{TAG} and {BEAT} are the source's own columns")
    whole = T.StructType([*fields.fields, T.StructField(TAG, T.StringType()), T.StructField(BEAT, T._parse_datatype_string(BEAT_TYPE))])
    source = spark.readStream.format("push").schema(whole).option("path", path).option("reader", reader).option("heartbeatMs", heartbeat_ms).option("keep", str(keep).lower())
    return (source.option("maxSegments", max_segments) if max_segments else source).load()


def is_heartbeat() -> F.Column:
    return F.coalesce(F.col(TAG) == HEARTBEAT, F.lit(False))


def without_heartbeats(stream: DataFrame) -> DataFrame:
    return stream.where(~is_heartbeat()).drop(TAG, BEAT)
