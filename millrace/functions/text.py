"""Text and date helpers as Column functions."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(column: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def replace_text(column: Column, old: str, new: str, ignore_case: bool = False) -> Column:
    if not ignore_case:
        return F.replace(column, F.lit(old), F.lit(new))
    return F.regexp_replace(column, "(?iu)" + re.sub(r"([\\\[\]{}()*+?.^$|])", r"\\\1", old), re.sub(r"([\\$])", r"\\\1", new))


def merged_text(columns: list[Column], separator: str) -> Column:
    """Texts joined left to right.  The separator is written once something was, so a later
    null or empty text leaves a separator, and an earlier one does not."""
    parts = F.transform(F.array(*columns), lambda x: F.coalesce(x, F.lit("")))
    return F.aggregate(parts, F.lit(""), lambda done, x: F.when(done == "", x).otherwise(F.concat(done, F.lit(separator), x)))


def merged_time(date: Column, time: Column) -> Column:
    """The day of one timestamp with the time of another, whole seconds; null if either is."""
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), F.hour(time), F.minute(time), F.second(time))


def delimited_text(column: Column, kind: str) -> Column:
    """A value as delimited files have it: full timestamps, decimals without trailing zeros, base64 bytes."""
    if kind.startswith("timestamp"):
        return F.concat(F.date_format(column, "yyyy.MM.dd HH:mm:ss.SSSSSS"), F.lit("0"))
    if kind == "date":
        return F.date_format(column, "yyyy.MM.dd")
    if kind.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind == "binary":
        return F.base64(column)
    return column.cast("string")


def combine_url(*parts: str) -> str:
    """Parts of a URL joined by single slashes."""
    kept = [p for p in parts if p]
    return "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate(kept))


def friendly_name(path: str) -> str:
    """A path's last part, fit for messages."""
    return quote(re.split(r"[\\/]", path.rstrip("\\/"))[-1], safe=" .-_()")
