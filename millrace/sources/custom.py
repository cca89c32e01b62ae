"""Sources of one's own: rows made by a Python function, partition by partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def read_custom(spark: SparkSession, rows: Callable[[int], Iterable[tuple]], schema: str, partitions: int = 1, name: str = "custom_rows") -> DataFrame:
    """The rows that rows(0), rows(1), ... return, each called by a task of its own; the calls must not depend on one another.

    Registered as a data source of the session, so that SQL can read it too."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(partitions)]

        def read(self, partition):
            yield from rows(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
