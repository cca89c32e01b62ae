"""Row filters, validation and conditional application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ERRORS, TAG, fail_when, has_error, require_columns, set_errors, with_errors


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def apply_where(df: DataFrame, condition: Column, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator on the rows that meet the condition; the others pass through unchanged."""
    chosen = operator(df.where(_true(condition)))
    return chosen.unionByName(df.where(~_true(condition)), allowMissingColumns=True)


def set_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns of the rows that meet the condition get new values, all from the row as it was; the others stay.

    What changes values only needs one pass, unlike apply_where, which takes any operator and reads its input for either side."""
    met = _true(condition)
    return df.withColumns({c: F.when(met, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()})


def apply_where_tag(df: DataFrame, condition: Callable[[Column], Column], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return apply_where(df, condition(F.col(TAG)), operator)


def remove_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true go; null keeps the row."""
    return df.where(~_true(condition))


def remove_all_rows(df: DataFrame) -> DataFrame:
    return df.limit(0)


def remove_rows_with_error(df: DataFrame) -> DataFrame:
    return df.where(~has_error()) if ERRORS in df.columns else df


def remove_blank_rows(df: DataFrame, ignoring: list[str] = ()) -> DataFrame:
    """Rows whose every value is null or an empty text go; ignored columns do not count."""
    data = [c for c in df.columns if c not in (ERRORS, TAG, *ignoring)]
    some = F.lit(False)
    for c in data:
        some = some | _true((F.col(c).cast("string") != "") if df.schema[c].dataType.typeName() == "string" else F.col(c).isNotNull())
    return df.where(some)


def validate(df: DataFrame, column: str, test: Column, message: str, step: str = "validate") -> DataFrame:
    """Cells that fail the test become null, with the old value as an error."""
    require_columns(df, column)
    df = with_errors(df)
    bad = ~_true(test)
    return df.withColumns({ERRORS: set_errors({column: (bad, F.col(column))}, message, step), column: F.when(~bad, F.col(column))})


def fail_on_error(df: DataFrame) -> DataFrame:
    """A row with an error fails the job, naming its columns and original values."""
    if ERRORS not in df.columns:
        return df
    return df.withColumn(ERRORS, fail_when(has_error(), F.col(ERRORS), "RowContainsError", F.to_json(ERRORS)))


def fail_on_duplicate_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """A second row of a key fails the job; null is a key as any other.

    Keys are counted by grouped aggregation and joined back, so a key that many
    rows have is pre-aggregated and never gathered in one task."""
    require_columns(df, *keys)
    counts = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    first = df.columns[0]
    failing = fail_when(F.col("__n") > 1, F.col(first), "DuplicateKey", F.to_json(F.struct(*keys)))
    return df.join(counts, same).withColumn(first, failing).select(*df.columns)
