"""Writers of delimited text, JSON and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RESERVED, require
from ..functions.text import delimited_text

_MODES = {"continue": "append", "fail": "error", "overwrite": "overwrite"}


def _texts(df: DataFrame, columns: dict[str, str | Column] | None) -> DataFrame:
    columns = columns or {c: c for c in df.columns if c not in RESERVED}
    out = []
    for title, source in columns.items():
        kind = df.select(source).schema[0].dataType.simpleString()
        out.append(delimited_text(F.col(source) if isinstance(source, str) else source, kind).alias(title))
    return df.select(*out)


def write_delimited(df: DataFrame, path: str, columns: dict[str, str | Column] | None = None, delimiter: str = ";", header: bool = True, if_exists: str = "fail", partition_by: dict[str, Column] | None = None) -> DataFrame:
    """Delimited files below path: null is an empty cell, an empty text a pair of quotes; a line feed in a
    cell is written as the file's line break; returns df.

    columns: title to source column or expression.  partition_by: a folder for each value."""
    require(if_exists in _MODES, f"no such mode: {if_exists}")
    rows = _texts(df, columns) if not partition_by else _texts(df.withColumns(partition_by), {**(columns or {c: c for c in df.columns if c not in RESERVED}), **{k: k for k in partition_by}})
    writer = rows.write.mode(_MODES[if_exists]).option("sep", delimiter).option("quote", '"').option("escape", '"').option("header", header)
    writer = writer.option("emptyValue", '""').option("nullValue", "").option("lineSep", "\r\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return df


def write_json(df: DataFrame, path: str, if_exists: str = "fail") -> DataFrame:
    df.drop(*RESERVED).write.mode(_MODES[if_exists]).json(path)
    return df


def write_text(df: DataFrame, column: str, path: str, if_exists: str = "fail") -> DataFrame:
    df.select(F.col(column).cast("string")).write.mode(_MODES[if_exists]).text(path)
    return df


def write_table_files(df: DataFrame, path: str, if_exists: str = "fail") -> DataFrame:
    """Typed binary table files (Parquet): every column type round-trips."""
    df.drop(*RESERVED).write.mode(_MODES[if_exists]).parquet(path)
    return df
