"""Work over one global order without pulling all rows into one task.

Rows are range-sorted and written, so that the order is fixed, with the number of each row's
range and its place in the order.  Rows of equal order values are cut among ranges as any
others are, so a value that most rows have takes several tasks.  A row a range, its summary,
gives what comes before each range; within a range ordinary windows do the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..errors import require, require_columns
from ..workspace import unused, written


def ranges_for(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class Ranged:
    """Written rows with two columns more: `range`, from 0, and `place`, which rises in the global order."""

    rows: DataFrame
    range: str
    place: str
    count: int

    def together(self, rows: DataFrame | None = None) -> DataFrame:
        """Each range in a task of its own."""
        return (self.rows if rows is None else rows).repartitionById(self.count, self.range)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(self.range).orderBy(self.place)

    def before(self, summaries: DataFrame, **values: Column) -> DataFrame:
        """summaries, a row a range, with values over the ranges before each; to be broadcast, as there are `count` rows at most."""
        earlier = Window.orderBy(self.range).rowsBetween(Window.unboundedPreceding, -1)
        return summaries.select(F.col(self.range), *[v.over(earlier).alias(n) for n, v in values.items()])


def ranged(df: DataFrame, order: list[str], ranges: int | None = None) -> Ranged:
    """df in one global order, nulls first; rows of equal values keep the order they are read in."""
    require(bool(order), "a global order needs order columns")
    require_columns(df, *order)
    count = ranges or ranges_for(df)
    number, place = unused(df, "__range"), unused(df, "__place")
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col(place)]
    rows = df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    rows = written(rows.withColumn(place, F.monotonically_increasing_id()), "ranged")
    return Ranged(rows.withColumn(number, F.shiftright(place, 33).cast("int")), number, place, count)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's number in the global order, from 0."""
    r = ranged(df, order)
    n = unused(df, "__n")
    counts = r.rows.groupBy(r.range).agg(F.count(F.lit(1)).alias(n))
    before = r.before(counts, **{n: F.sum(n)})
    own = F.col(r.place) - F.shiftleft(F.col(r.range).cast("long"), 33)
    return r.rows.join(F.broadcast(before), r.range).withColumn(r.place, own + F.coalesce(n, F.lit(0))).drop(r.range, n).select(*df.columns, F.col(r.place).alias(name))


def running_sum(df: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """df with the sum of value over all rows up to and including each, in global order."""
    own, total = unused(df, "__own"), unused(df, "__total")
    r = ranged(df.withColumn(own, value), order)
    before = r.before(r.rows.groupBy(r.range).agg(F.sum(own).alias(total)), **{total: F.sum(total)})
    rows = r.together().withColumn(own, F.sum(own).over(r.window.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(F.broadcast(before), r.range).withColumn(own, F.coalesce(own, F.lit(0)) + F.coalesce(total, F.lit(0)))
    return rows.select(*df.columns, F.col(own).alias(name))


def with_previous(df: DataFrame, values: dict[str, Column], order: list[str], skip_nulls: bool = False) -> DataFrame:
    """df with, for each name, the value of the row before (or the last non-null value before) in global order,
    and __first, true where there is none."""
    held = {n: f"__v_{n}" for n in values}
    rows = df.withColumns({held[n]: F.struct(v.alias("v")) if not skip_nulls else F.when(v.isNotNull(), F.struct(v.alias("v"))) for n, v in values.items()})
    r = ranged(rows, order)
    lasts = r.rows.groupBy(r.range).agg(*[F.max_by(h, F.when(F.col(h).isNotNull(), F.col(r.place))).alias(f"__carry_{n}") for n, h in held.items()])
    carried = r.before(lasts, **{f"__carry_{n}": F.last(f"__carry_{n}", ignorenulls=True) for n in values})
    w = r.window.rowsBetween(Window.unboundedPreceding, -1)
    rows = r.together().withColumns({f"__p_{n}": F.last(h, ignorenulls=True).over(w) for n, h in held.items()}).join(F.broadcast(carried), r.range)
    found = {n: F.coalesce(f"__p_{n}", f"__carry_{n}") for n in values}
    return rows.select(*df.columns, *[found[n]["v"].alias(n) for n in values], found[next(iter(values))].isNull().alias("__first"))


def run_ids(df: DataFrame, keys: list[str], order: list[str], partition_by: list[str] | None = None, name: str = "__run") -> DataFrame:
    """df with a number that is the same for adjacent rows of equal keys."""
    require_columns(df, *keys, *order, *(partition_by or []))
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
        changed = df.withColumn("__changed", F.when((F.row_number().over(w) > 1) & same, 0).otherwise(1))
        return changed.withColumn(name, F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")
    r = ranged(df, order)
    key, own = F.struct(*keys), unused(df, "__own")
    before = F.lag(key).over(r.window)
    # a range's first row starts no run of its own accord; whether it does is seen from the range before
    rows = r.together().withColumn(own, F.when(F.row_number().over(r.window) == 1, 0).when(key.eqNullSafe(before), 0).otherwise(1))
    rows = rows.withColumn(own, F.sum(own).over(r.window.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(r.range).agg(F.max(own).alias("__inner"), F.min_by(key, r.place).alias("__head"), F.max_by(key, r.place).alias("__tail"))
    line = Window.orderBy(r.range)
    ends = ends.withColumn("__new", F.when(F.lag("__tail").over(line).eqNullSafe(F.col("__head")) & (F.row_number().over(line) > 1), 0).otherwise(1))
    inner_before = F.coalesce(F.sum("__inner").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ends.select(r.range, (inner_before + F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0))).alias("__base"))  # a row a range
    return rows.join(F.broadcast(base), r.range).select(*df.columns, (F.col(own) + F.col("__base")).alias(name))
