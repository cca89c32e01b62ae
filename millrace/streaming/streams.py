"""Streaming variants: push sources, de-duplication, grouped state and sinks that flush on a trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..errors import require, require_columns
from ..operators.aggregate import Aggregate


def listen_files(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """New files below path as a stream of rows."""
    reader = spark.readStream.schema(schema).format(format).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def remove_duplicates(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First arrival of each key; with an event time, state older than the delay is dropped."""
    require_columns(stream, *keys)
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def aggregate(stream: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """Grouped state, for output modes complete and update."""
    return stream.groupBy(*keys).agg(*[a.column.alias(a.target) for a in aggregates])


def aggregate_windows(stream: DataFrame, event_time: str, width: str, aggregates: list[Aggregate], keys: list[str] = (), slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Aggregates by windows of event time, closed once the watermark has passed."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    out = stream.withWatermark(event_time, delay).groupBy(window.alias("w"), *keys).agg(*[a.column.alias(a.target) for a in aggregates])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[a.target for a in aggregates])


def aggregate_sessions(stream: DataFrame, event_time: str, gap: str, aggregates: list[Aggregate], keys: list[str], delay: str = "0 seconds") -> DataFrame:
    out = stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap).alias("w"), *keys).agg(*[a.column.alias(a.target) for a in aggregates])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[a.target for a in aggregates])


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, flush: str = "5 seconds", all_available: bool = False) -> StreamingQuery:
    """Each micro-batch to a sink; flushed every `flush`, or once over what there is."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if all_available else writer.trigger(processingTime=flush)).start()


def collect_available(stream: DataFrame, mode: str, path: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over what there is and returns its result as a table.

    append writes as it goes; complete keeps the last batch; update writes what each
    batch changed and keeps the last state of each of `keys`.  A repeated batch replaces its own files."""
    require(mode in ("append", "complete", "update"), f"no such output mode: {mode}")
    require(mode != "update" or bool(keys), "update needs keys")
    spark = stream.sparkSession
    schema = stream.schema
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(schema).parquet(path)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/__batch={number}" if mode == "update" else path)

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(schema).parquet(path)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("__batch", T.LongType())])).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.fieldNames()), "__batch").alias("__row")).select("__row.*")
