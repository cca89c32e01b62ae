"""Converters: Column to Column, null where a value cannot be converted.

Texts may have white space, signs, thousands separators, parentheses for
negatives and exponents.  A fraction becomes a whole number by rounding half to
even, within the target's range.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = "decimal(38,10)"
# Ranges of whole-number types, and the narrowest type here that holds each.
WHOLE = {
    "int": (-(2**31), 2**31 - 1, "int"),
    "long": (-(2**63), 2**63 - 1, "bigint"),
    "short": (-(2**15), 2**15 - 1, "smallint"),
    "sbyte": (-(2**7), 2**7 - 1, "tinyint"),
    "byte": (0, 2**8 - 1, "smallint"),
    "ushort": (0, 2**16 - 1, "int"),
    "uint": (0, 2**32 - 1, "bigint"),
    "ulong": (0, 2**64 - 1, "decimal(20,0)"),
}


@dataclass(frozen=True)
class Locale:
    """How a culture writes numbers and dates."""

    decimal: str
    groups: str
    dates: tuple[str, ...]


# Formats of the cultures that the tests pin.
LOCALES = {
    "invariant": Locale(".", ",", ("yyyy-M-d", "yyyy.M.d", "yyyy/M/d", "M/d/yyyy", "M.d.yyyy")),
    "hu": Locale(",", " \u00a0\u202f", ("yyyy.M.d", "yyyy. M. d", "yyyy-M-d", "M.d.yyyy", "MMMM d.yyyy")),
    "gb": Locale(".", ",", ("d/M/yyyy", "d.M.yyyy", "yyyy.M.d", "yyyy-M-d", "d-M-yyyy", "d MMM yyyy")),
    "us": Locale(".", ",", ("M/d/yyyy", "M.d.yyyy", "yyyy.M.d", "yyyy-M-d", "MMM d, yyyy")),
    "de": Locale(",", ". \u00a0", ("d.M.yyyy", "yyyy.M.d", "yyyy-M-d")),
}


def number_text(column: Column, locale: str = "invariant", strip: tuple[str, ...] = ()) -> Column:
    """A number's text in the form that casts read; null for a text of another form."""
    how, text = LOCALES[locale], column.cast("string")
    for part in strip:
        text = F.regexp_replace(text, "(?i)" + _quoted(part), "")
    text = F.trim(F.regexp_replace(text, r"(?U)^[\s¤$€£]+|[\s¤$€£]+$", ""))
    text = F.regexp_replace(text, r"^\((.*)\)$", "-$1")
    text = F.regexp_replace(text, r"^(.*[0-9.,])([-+])$", "$2$1")
    text = F.when(~F.regexp_like(text, F.lit(r"(?U)^[-+]\s")), F.translate(text, how.groups, ""))
    if how.decimal != ".":
        text = F.translate(text, how.decimal, ".")
    return F.when(F.regexp_like(text, F.lit(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$")), text)


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\[]{}()*+?.^$|" else c for c in text)


def to_whole(column: Column, kind: str, of: str = "string", locale: str = "invariant", strip: tuple[str, ...] = ()) -> Column:
    """A whole number of WHOLE's `kind` from a column of Spark type `of`."""
    low, high, target = WHOLE[kind]
    if of == "boolean":
        return column.cast("int").cast(target)
    if of == "binary":
        return F.when(F.octet_length(column) == 8, F.conv(F.hex(column), 16, -10)).try_cast(WIDE).try_cast(target)
    if of == "string":
        text = number_text(column, locale, strip)
        number = F.coalesce(text.try_cast(WIDE), text.try_cast("double").try_cast(WIDE))
    else:
        number = column.try_cast("decimal(38,0)") if of.startswith(("tinyint", "smallint", "int", "bigint")) else column.try_cast(WIDE)
    rounded = F.bround(number, 0)
    return F.when((rounded >= F.lit(str(low)).cast("decimal(38,0)")) & (rounded <= F.lit(str(high)).cast("decimal(38,0)")), rounded).try_cast(target)


def to_real(column: Column, kind: str = "double", of: str = "string", locale: str = "invariant", strip: tuple[str, ...] = ()) -> Column:
    """float, double or decimal(p,s)."""
    if of == "boolean":
        return column.cast("int").cast(kind)
    return (number_text(column, locale, strip) if of == "string" else column).try_cast(kind)


def localised(column: Column, kind: str, locale: str) -> Column:
    """A number as the culture writes it, else as the invariant one does."""
    one = to_whole if kind in WHOLE else to_real
    return F.coalesce(one(column, kind, "string", locale), one(column, kind))


def to_bool(column: Column, of: str = "string") -> Column:
    """1 and 0, trimmed; numbers are true if they are 1."""
    if of == "boolean":
        return column
    if of != "string":
        return column.cast("double") == 1
    text = F.trim(column)
    return F.when(text == "1", True).when(text == "0", False)


def to_bool_words(column: Column, true: tuple[str, ...] = (), false: tuple[str, ...] = ()) -> Column:
    """true, yes, 1 and false, no, 0 in any case, and further known words."""
    text = F.upper(F.trim(column.cast("string")))
    yes, no = ("TRUE", "YES", "1", *map(str.upper, true)), ("FALSE", "NO", "0", *map(str.upper, false))
    return F.when(text.isin(*yes), True).when(text.isin(*no), False)


def to_date(column: Column, of: str = "string", formats: tuple[str, ...] | None = None, locale: str = "invariant", epoch: str | None = None) -> Column:
    """A date.  Numbers are days from the epoch, e.g. 1899-12-30 for workbooks."""
    if of in ("date", "timestamp", "timestamp_ntz"):
        return column.cast("date")
    if of != "string":
        return F.date_add(F.lit(epoch).cast("date"), F.floor(column).cast("int")) if epoch else F.lit(None).cast("date")
    text = F.trim(column)
    day = F.regexp_replace(text, r"\.?([ T]\d{1,2}:\d{2}.*)?$", "")
    return F.coalesce(*[F.try_to_timestamp(day, F.lit(f)).cast("date") for f in formats or LOCALES[locale].dates], text.try_cast("date"))


def to_timestamp(column: Column, of: str = "string", formats: tuple[str, ...] | None = None, locale: str = "invariant", epoch: str | None = None) -> Column:
    """A timestamp without zone.  Fractions are days from the epoch, whole numbers seconds."""
    if of in ("date", "timestamp", "timestamp_ntz"):
        return column.cast("timestamp_ntz")
    if of in ("double", "float") or of.startswith("decimal"):
        micros = F.round(column.cast("double") * 86400e6).cast("bigint")
        return F.timestamp_add("MICROSECOND", micros, F.lit(epoch).cast("timestamp_ntz")) if epoch else F.lit(None).cast("timestamp_ntz")
    if of != "string":
        return F.timestamp_add("SECOND", column, F.lit(epoch).cast("timestamp_ntz")) if epoch else F.lit(None).cast("timestamp_ntz")
    text = F.trim(column)
    tries = [f"{d}{sep}{t}" for d in LOCALES[locale].dates for sep, t in (("", ""), (" ", "HH:mm:ss"), (" ", "HH:mm"), ("'T'", "HH:mm:ss"), (" ", "HH:mm:ss.SSSSSS"))]
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats or tries])
    return F.coalesce(parsed.cast("timestamp_ntz"), text.try_cast("timestamp_ntz"))


def to_zoned(column: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss XXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")) -> Column:
    text = F.trim(column)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], text.try_cast("timestamp"))


def to_interval(column: Column, of: str = "string") -> Column:
    """A day-time interval from [-][d.]hh:mm[:ss[.fraction]] or from the time of a timestamp."""
    if of in ("timestamp", "timestamp_ntz"):
        return F.make_dt_interval(F.lit(0), F.hour(column), F.minute(column), F.date_format(column, "ss.SSSSSS").cast("decimal(18,6)"))
    form = r"^\s*(-?)(?:(\d+)[.:](?=\d+:\d+:))?(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,7})?))?\s*$"
    part = lambda i, kind: F.coalesce(F.nullif(F.regexp_extract(column, form, i), F.lit("")).try_cast(kind), F.lit(0).cast(kind))
    good = F.regexp_like(column, F.lit(form)) & (part(3, "int") < 24) & (part(4, "int") < 60) & (part(5, "decimal(18,6)") < 60)
    sign = F.when(F.regexp_extract(column, form, 1) == "-", -1).otherwise(1)
    return F.when(good, F.make_dt_interval(part(2, "int") * sign, part(3, "int") * sign, part(4, "int") * sign, (part(5, "decimal(18,6)") * sign).cast("decimal(18,6)")))


def to_text(column: Column, of: str = "string", pattern: str | None = None) -> Column:
    if pattern and of in ("date", "timestamp", "timestamp_ntz"):
        return F.date_format(column, pattern)
    if pattern:
        return F.format_string(pattern, column)
    return column.cast("string")


def to_guid(column: Column) -> Column:
    """A GUID in any of its textual forms, as 36 lower-case characters."""
    bare = F.lower(F.regexp_replace(F.trim(column), r"[{}()-]", ""))
    form = r"^[({]?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}[)}]?$"
    return F.when(F.regexp_like(F.trim(column), F.lit(form)), F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def to_bytes(column: Column) -> Column:
    return F.try_to_binary(column, F.lit("base64"))


def to_xml(column: Column) -> Column:
    return F.to_xml(column)


def from_xml(column: Column, schema: str) -> Column:
    """A struct of the schema; null for a text that is no such XML."""
    fields = T.StructType.fromDDL(schema).fieldNames()
    broken = "_broken"
    while broken in fields:
        broken += "_"
    parsed = F.from_xml(column, f"{schema}, {broken} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})
    return F.when(column.isNotNull() & parsed[broken].isNull(), F.struct(*[parsed[f].alias(f) for f in fields]))


def row_version(column: Column) -> Column:
    """Eight big-endian bytes as an unsigned whole number."""
    return F.when(F.octet_length(column) == 8, F.conv(F.hex(column), 16, 10)).try_cast("decimal(20,0)")


# Weights and codes of Hungarian tax and bank account numbers.
TAX_WEIGHTS = (9, 7, 3, 1, 9, 7, 3)
TAX_REGIONS = tuple(f"{n:02d}" for n in (*range(2, 21), *range(22, 45), 51))
GIRO_WEIGHTS = (9, 7, 3, 1, 9, 7, 3)


def _digits(text: Column, weights: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.substring(text, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)])


def hungarian_tax_number(column: Column) -> Column:
    """A valid tax number as 8-1-2 digits: check digit, tax kind 1 to 5, region."""
    text = F.regexp_replace(F.trim(column), "[ -]", "")
    check = F.pmod(F.lit(10) - F.pmod(_digits(text, TAX_WEIGHTS), F.lit(10)), F.lit(10))
    good = F.regexp_like(text, F.lit(r"^\d{8}[1-5]\d{2}$")) & (F.substring(text, 8, 1).try_cast("int") == check) & F.substring(text, 10, 2).isin(*TAX_REGIONS)
    return F.when(good, F.concat_ws("-", F.substring(text, 1, 8), F.substring(text, 9, 1), F.substring(text, 10, 2)))


def hungarian_bank_account(column: Column) -> Column:
    """A valid account number of 16 or 24 digits as groups of eight: the first group's check digit holds."""
    text = F.regexp_replace(F.trim(column), "[ -]", "")
    check = F.pmod(F.lit(10) - F.pmod(_digits(text, GIRO_WEIGHTS), F.lit(10)), F.lit(10))
    good = F.regexp_like(text, F.lit(r"^(\d{16}|\d{24})$")) & (F.substring(text, 8, 1).try_cast("int") == check)
    return F.when(good, F.regexp_replace(text, r"(\d{8})(?=\d)", "$1-"))
