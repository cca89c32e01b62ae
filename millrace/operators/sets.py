"""Sorting, merging and splitting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require


def sort(df: DataFrame, *order: Column | str, limit: int | None = None) -> DataFrame:
    """Rows in order; with a limit only the first, which Spark finds without a full sort."""
    require(bool(order), "a sort needs an order")
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def merge(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs; a column that one lacks is null there."""
    require(bool(frames), "nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_in_order(*frames: DataFrame, ordinal: str = "__input") -> DataFrame:
    """As merge, with the input's number in a column, so that their order can be told."""
    return merge(*[f.withColumn(ordinal, F.lit(i)) for i, f in enumerate(frames)])


def split(df: DataFrame, parts: int) -> DataFrame:
    """Rows dealt evenly to that many partitions; each row goes to one."""
    return df.repartition(parts)


def process_in_parallel(df: DataFrame, parts: int, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator over rows dealt evenly; F.spark_partition_id() tells the part."""
    return operator(split(df, parts))
