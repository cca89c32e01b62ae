"""State per key, with timers and time to live: numbers, first rows, sessions.

Numbers and first rows are kept by transformWithState, sessions by session windows; the state is in RocksDB, partitioned by key and saved with every batch.  What a
key holds is bounded: a number, a time, or its open sessions; timers and time to live let go of keys that are idle.
Rows of one key are gone through one after another, as they must be; keys are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import require, require_columns
from . import streams

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, idle_batches: bool = True):
    """Within it, streams that are started keep their state in RocksDB, which transformWithState asks for.

    idle_batches: whether batches without rows run, which event-time timers need to end; with time to live they would never end."""
    wanted = {_PROVIDER: _ROCKS, _IDLE: str(idle_batches).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def collect_available(stream: DataFrame, path: str, checkpoint: str, idle_batches: bool = True) -> DataFrame:
    """Runs a stream of this module over what there is, appends its rows to a table and returns that; idle_batches: False for `numbered` with a time to live."""
    with state_store(stream.sparkSession, idle_batches):
        return streams.collect_available(stream, "append", path, checkpoint)


AT = "__at_ms"


def _timed(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Rows with an event time, as milliseconds too, under a watermark."""
    rows = stream.where(F.col(event_time).isNotNull()).withColumn(event_time, F.col(event_time).cast("timestamp"))
    return rows.withColumn(AT, F.unix_millis(event_time)).withWatermark(event_time, delay)


class _Numbers(StatefulProcessor):
    def __init__(self, fields: list[str], order: str | None, first: int, ttl_ms: int | None):
        self.fields, self.order, self.first, self.ttl_ms = fields, order, first, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.last.get()[0] if self.last.exists() else self.first - 1
        make = Row(*self.fields, "n")
        # a number must not depend on how a batch was shuffled
        for row in sorted(rows, key=lambda r: (r[self.order] is not None, r[self.order])) if self.order else rows:
            n += 1
            yield make(*(row[f] for f in self.fields), n)
        self.last.update((n,))

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, keys: list[str], out: str, order: str | None = None, first: int = 1, ttl_ms: int | None = None) -> DataFrame:
    """Rows with consecutive numbers in their key, over all batches; within a batch by `order` (its rows of one key are sorted in memory).

    ttl_ms: a key that got no row for so long is forgotten and starts again."""
    require_columns(stream, *keys)
    schema = T.StructType([*stream.schema.fields, T.StructField("n", T.LongType())])
    processor = _Numbers(stream.columns, order, first, ttl_ms)
    made = stream.groupBy(*keys).transformWithState(processor, schema, "append", "processingTime" if ttl_ms else "none")
    return made.withColumnRenamed("n", out)


class _Firsts(StatefulProcessor):
    def __init__(self, fields: list[str], keep_ms: int):
        self.fields, self.keep_ms = fields, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = self.until.get()[0] if self.until.exists() else None
        make = Row(*self.fields)
        for row in sorted(rows, key=lambda r: r[AT]):
            at = row[AT]
            if until is None or at >= until:
                if until is not None:
                    self.handle.deleteTimer(until)
                until = at + self.keep_ms
                self.handle.registerTimer(until)
                yield make(*(row[f] for f in self.fields))
        if until is not None:
            self.until.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, keys: list[str], event_time: str, keep_ms: int, delay: str = "0 seconds") -> DataFrame:
    """The first row of each key; another of it passes once keep_ms of event time have gone by since the last that passed.

    A key is forgotten when the watermark has passed that time.  Rows without an event time have no place and are left out."""
    require_columns(stream, *keys, event_time)
    rows = _timed(stream, event_time, delay)
    return rows.groupBy(*keys).transformWithState(_Firsts(stream.columns, keep_ms), rows.drop(AT).schema, "append", "eventTime")


def sessions(stream: DataFrame, keys: list[str], event_time: str, gap_ms: int, value: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(keys, start_ms, last_ms, rows, total) of each session: rows of a key less than gap_ms apart, with the sum of `value`, null as zero.

    A session is emitted, and its state let go of, once the watermark has passed its last row by the gap; rows may come in
    any order within the delay, and may join sessions.  Rows without an event time are left out.

    Spark's session windows keep the open sessions, a few numbers each, and join them in the JVM."""
    require_columns(stream, *keys, event_time)
    require(gap_ms > 0, "sessions need a gap")
    at = F.col(event_time).cast("timestamp")
    rows = _timed(stream.withColumn(event_time, F.timestamp_millis(F.unix_millis(at))), event_time, delay)
    # a row at the very end of a window still joins it; times are whole milliseconds
    window = F.session_window(event_time, f"{gap_ms * 1000 - 1} microseconds").alias("__window")
    total = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    made = rows.groupBy(*keys, window).agg(F.min(AT).alias("start_ms"), F.max(AT).alias("last_ms"), F.count(F.lit(1)).alias("rows"), F.sum(total).alias("total"))
    return made.select(*keys, "start_ms", "last_ms", "rows", "total")
