"""Grouped aggregation, group reduction, runs and removal of duplicates.

Aggregates follow one rule for nulls: sums, averages, least and greatest values
take a null as zero; counts of distinct or of conditions are null where there
is nothing to count; deviations and averages that ignore nulls are SQL's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import require, require_columns
from .ordering import run_ids

EARLIEST, LATEST = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


@dataclass(frozen=True)
class Aggregate:
    target: str
    column: Column


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _some(n: Column) -> Column:
    return F.nullif(n, F.lit(0)).cast("int")


def count(target: str = "count") -> Aggregate:
    return Aggregate(target, F.count(F.lit(1)).cast("int"))


def count_not_null(source: str, target: str | None = None) -> Aggregate:
    return Aggregate(target or source, _some(F.count(source)))


def count_null(source: str, target: str | None = None) -> Aggregate:
    return Aggregate(target or source, _some(F.count_if(F.col(source).isNull())))


def count_distinct(source: str, target: str | None = None) -> Aggregate:
    return Aggregate(target or source, _some(F.count_distinct(F.col(source))))


def total(source: str, target: str | None = None, kind: str = "double") -> Aggregate:
    """Sum, null as zero; kind int, long, double or a decimal type (int overflow fails)."""
    spark_kind = {"long": "bigint"}.get(kind, kind)
    return Aggregate(target or source, F.sum(_zero(source)).cast(spark_kind))


def average(source: str, target: str | None = None, kind: str = "double") -> Aggregate:
    """Average, nulls as zero and counted."""
    if kind.startswith("decimal"):
        return Aggregate(target or source, (F.sum(_zero(source)) / F.count(F.lit(1))).cast(kind))
    return Aggregate(target or source, F.avg(_zero(source)))


def average_ignoring_null(source: str, target: str | None = None) -> Aggregate:
    return Aggregate(target or source, F.avg(source))


def greatest(source: str, target: str | None = None) -> Aggregate:
    return Aggregate(target or source, F.max(_zero(source)))


def least(source: str, target: str | None = None) -> Aggregate:
    return Aggregate(target or source, F.min(_zero(source)))


def latest(source: str, target: str | None = None) -> Aggregate:
    return Aggregate(target or source, F.max(F.coalesce(F.col(source), F.lit(EARLIEST).cast("timestamp_ntz"))))


def earliest(source: str, target: str | None = None) -> Aggregate:
    return Aggregate(target or source, F.min(F.coalesce(F.col(source), F.lit(LATEST).cast("timestamp_ntz"))))


def deviation(source: str, target: str | None = None, population: bool = False) -> Aggregate:
    return Aggregate(target or source, (F.stddev_pop if population else F.stddev_samp)(source))


def custom(target: str, column: Column) -> Aggregate:
    """Any aggregate expression, a grouped Pandas UDF included."""
    return Aggregate(target, column)


def linear_regression(x: str, y: str, slope: str = "slope", intercept: str = "intercept", n: str = "n") -> list[Aggregate]:
    """Least squares of y on x.  A null in the group makes all three null; a single point or a vertical
    line has slope zero, a single point its own y as intercept."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    number, sx, sy = F.count(F.lit(1)).cast("double"), F.sum(a), F.sum(b)
    complete = F.count_if(F.col(x).isNull() | F.col(y).isNull()) == 0
    spread = number * F.sum(a * a) - sx * sx
    steep = F.when((number > 1) & (F.abs(spread) >= 1e-4), (number * F.sum(a * b) - sx * sy) / F.when(F.abs(spread) >= 1e-4, spread)).otherwise(0.0)
    return [
        Aggregate(slope, F.when(complete, steep)),
        Aggregate(intercept, F.when(complete, F.when(number == 1, sy).otherwise((sy - steep * sx) / number))),
        Aggregate(n, F.when(complete, F.count(F.lit(1)).cast("int"))),
    ]


def aggregate(df: DataFrame, keys: list[str], aggregates: list[Aggregate], fixed: dict[str, str] | list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Groups with their aggregates, and fixed columns (target to source) from each group's first row by `order`.

    Without keys there is one group, and none over no rows."""
    require(bool(aggregates) or bool(keys), "nothing to aggregate")
    require_columns(df, *keys, *(order or []))
    fixed = fixed if isinstance(fixed, dict) else {c: c for c in fixed or []}
    firsts = []
    if fixed:
        require(bool(order), "fixed columns need an order")
        picked = F.min_by(F.struct(*[F.col(s).alias(t) for t, s in fixed.items()]), F.struct(*order)).alias("__first")
        firsts = [picked]
    columns = [*firsts, *[a.column.alias(f"__a{i}") for i, a in enumerate(aggregates)]]
    out = df.groupBy(*keys).agg(*columns, F.count(F.lit(1)).alias("__n"))
    out = out if keys else out.where("__n > 0")
    names = [*keys, *[F.col(f"__first.{t}").alias(t) for t in fixed if t not in keys], *[F.col(f"__a{i}").alias(a.target) for i, a in enumerate(aggregates)]]
    return out.select(*names)


def aggregate_runs(df: DataFrame, keys: list[str], order: list[str], aggregates: list[Aggregate], partition_by: list[str] | None = None) -> DataFrame:
    """As aggregate, but a group is a run of adjacent rows with equal keys."""
    runs = run_ids(df, keys, order, partition_by)
    out = aggregate(runs, list(dict.fromkeys([*(partition_by or []), "__run", *keys])), aggregates)
    return out.drop("__run")


def aggregate_frames(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each group's rows through a Python function; a group must fit a task."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def reduce_groups(
    df: DataFrame,
    keys: list[str],
    order: list[Column] | list[str],
    where: Column | None = None,
    runs: list[str] | None = None,
    partition_by: list[str] | None = None,
    set: dict[str, Column] | None = None,
    keep_single: bool = False,
) -> DataFrame:
    """One row for each group: the first by `order` among those that meet `where`; a group without such a row goes.

    `set` alters the row: columns get the values of aggregates over the whole
    group.  With keep_single a group of one row stays as it is, whatever `where` and `set` say.
    With `runs` a group is a run of adjacent rows in that order.  The winner is
    found by a grouped minimum, so a large group is pre-aggregated."""
    columns = df.columns
    rows = run_ids(df, keys, runs, partition_by) if runs else df
    group = [*keys, "__run", *(partition_by or [])] if runs else keys
    if where is not None and not (set or keep_single):
        rows, where = rows.where(where), None
    chosen = where if where is not None else F.lit(True)
    if set or keep_single or all(isinstance(o, str) for o in order):
        require(all(isinstance(o, str) for o in order), "altered rows need an order of column names")
        single = F.count(F.lit(1)) == 1 if keep_single else F.lit(False)
        picked = F.min_by(F.struct(*columns), F.when(chosen, F.struct(*order)))
        first = F.when(single, F.min_by(F.struct(*columns), F.struct(*order))).otherwise(picked) if keep_single else picked
        made = [value.alias(f"__s{i}") for i, value in enumerate((set or {}).values())]
        out = rows.groupBy(*dict.fromkeys(group)).agg(first.alias("__row"), single.alias("__single"), *made).where("__row IS NOT NULL")
        altered = {c: i for i, c in enumerate(set or {})}
        keep = lambda c: F.col(f"__row.{c}") if c in columns else F.lit(None)
        return out.select(*[F.when(F.col("__single"), keep(c)).otherwise(F.col(f"__s{altered[c]}")).alias(c) if c in altered else keep(c).alias(c) for c in dict.fromkeys([*columns, *altered])])
    place = F.row_number().over(Window.partitionBy(*dict.fromkeys(group)).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").select(*columns)


def remove_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`; null is a key."""
    return reduce_groups(df, keys, order)


def record_count(df: DataFrame, where: Column | None = None) -> DataFrame:
    rows = df.where(where) if where is not None else df
    return rows.agg(F.count(F.lit(1)).alias("record_count"))


def max_value(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """The greatest value of a column and the number of rows."""
    rows = df.where(where) if where is not None else df
    return rows.agg(F.max(column).alias("max_value"), F.count(F.lit(1)).alias("record_count"))
