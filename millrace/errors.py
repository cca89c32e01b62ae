"""Failures, and errors that are kept beside the data.

A typed column cannot hold an error, so a row's errors are in one reserved map
column: column name to (original text, message, step).  A cell in error is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = "__errors"
TAG = "__tag"
RESERVED = (ERRORS, TAG)
_TYPE = "map<string,struct<original:string,message:string,step:string>>"


class InvalidParameter(ValueError):
    """An operator was given parameters that its input does not allow."""


class StepFailed(RuntimeError):
    """A step of a flow failed."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidParameter(message)


def require_columns(df: DataFrame, *columns: str) -> None:
    have = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in have]
    require(not missing, f"no such columns: {missing}")


def with_errors(df: DataFrame) -> DataFrame:
    """df with the error column, empty where it had none."""
    return df if ERRORS in df.columns else df.withColumn(ERRORS, F.create_map().cast(_TYPE))


def error_of(column: str, original: Column, message: str | Column, step: str) -> Column:
    value = F.struct(original.cast("string").alias("original"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), F.lit(step).alias("step"))
    return F.create_map(F.lit(column), value).cast(_TYPE)


def _without(errors: Column, column: str) -> Column:
    return F.map_filter(errors, lambda k, _: k != column)


def without_error_of(column: str) -> Column:
    return _without(F.col(ERRORS), column)


def set_errors(failed: dict[str, tuple[Column, Column]], message: str, step: str) -> Column:
    """The error column after each column's (is bad, original) has been recorded; later errors replace earlier ones."""
    out = F.col(ERRORS)
    for name, (bad, original) in failed.items():
        out = F.when(bad, F.map_concat(_without(out, name), error_of(name, original, message, step))).otherwise(out)
    return out


def has_error() -> Column:
    return F.size(ERRORS) > 0


def fail_when(bad: Column, value: Column, code: str, detail: Column | str) -> Column:
    """value, or a run-time failure `code: detail` where bad."""
    message = F.concat(F.lit(f"{code}: "), (detail if isinstance(detail, Column) else F.lit(detail)).cast("string"))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message)).otherwise(value)
