"""Textual row keys, their hashes, row checksums and schema fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a key's parts are written. A number's text ends in a letter for its type.
SUFFIX = {"bigint": "l", "double": "d", "float": "f"}
DECIMAL_SUFFIX = "m"
TIME_FORMAT = "yyyy.MM.dd HH:mm:ss.SSSSSS"
SEPARATOR, NULL_PART = "\0", "-"


def key_text(column: Column, kind: T.DataType) -> Column:
    """A value as it appears in a key; null stays null."""
    name = kind.simpleString()
    if isinstance(kind, T.BooleanType):
        return F.when(column, "true").when(~column, "false")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(column, TIME_FORMAT), F.lit("0"))
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy.MM.dd")
    if isinstance(kind, T.DecimalType):
        text = F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1")
        return F.concat(F.regexp_replace(text, r"\.$", ""), F.lit(DECIMAL_SUFFIX))
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = column == F.floor(column)
        text = F.when(whole & (F.abs(column) < 1e15), column.cast("bigint").cast("string")).otherwise(column.cast("string"))
        return F.concat(text, F.lit(SUFFIX[name]))
    return F.concat(column.cast("string"), F.lit(SUFFIX.get(name, "")))


def row_key(df: DataFrame, columns: list[str] | None = None, upper: bool = False) -> Column:
    """The key text of a row.  One column: its text, null for null.  Several: parts joined, a dash for null."""
    columns = columns or df.columns
    parts = [key_text(F.col(c), df.schema[c].dataType) for c in columns]
    key = parts[0] if len(parts) == 1 else F.concat_ws(SEPARATOR, *[F.coalesce(p, F.lit(NULL_PART)) for p in parts])
    return F.upper(key) if upper else key


_HASHES = {"sha256": lambda k: F.sha2(k, 256), "sha384": lambda k: F.sha2(k, 384), "sha512": lambda k: F.sha2(k, 512), "sha1": F.sha1, "md5": F.md5}


def key_hash(key: Column, algorithm: str = "sha256", upper: bool = False) -> Column:
    """Hex digest of a key; null for a null key."""
    digest = _HASHES[algorithm](key)
    return F.upper(digest) if upper else digest


def checksum(columns: list[Column]) -> Column:
    """A 64-bit checksum of the columns' values; equal rows have equal checksums, nulls count."""
    return F.xxhash64(*columns)


def schema_fingerprint(schema: T.StructType) -> str:
    """A short stable text for a schema: column names regardless of case and order, types, nullability of keys."""
    parts = sorted(f"{f.name.lower()}:{f.dataType.simpleString()}:{bool((f.metadata or {}).get('key'))}" for f in schema)
    value = 0xCBF29CE484222325  # 64-bit FNV-1a, a published hash
    for byte in "\n".join(parts).encode():
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{len(parts) % 256:02x}{value:016x}"
