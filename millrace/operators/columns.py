"""Column operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ERRORS, RESERVED, TAG, fail_when, require, require_columns, set_errors, with_errors, without_error_of
from ..functions import keys as key_functions
from ..functions import text as text_functions
from ..workspace import unused
from .ordering import numbered, with_previous


def remove_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def keep_columns(df: DataFrame, *columns: str) -> DataFrame:
    require_columns(df, *columns)
    return df.select(*columns, *[c for c in df.columns if c in RESERVED and c not in columns])


def rename_columns(df: DataFrame, names: dict[str, str], if_exists: str = "fail") -> DataFrame:
    """Columns get new names, all at once (a swap works).  Where a target column exists and
    holds a value, `if_exists` says, row by row: skip, remove_row, overwrite or fail."""
    require_columns(df, *names)
    require(if_exists in ("skip", "remove_row", "overwrite", "fail"), f"no such policy: {if_exists}")
    moved = {k.lower(): v for k, v in names.items()}
    have = {c.lower(): c for c in df.columns}
    taken = {t: have[t.lower()] for t in names.values() if t.lower() in have and t.lower() not in moved}
    blocked = F.lit(False)
    for t in taken.values():
        blocked = blocked | F.col(t).isNotNull()
    if if_exists == "remove_row" and taken:
        df = df.where(~blocked)
    out = []
    for c in df.columns:
        if c.lower() in moved:
            target = moved[c.lower()]
            value = F.col(c)
            if target in taken:
                old = F.col(taken[target])
                if if_exists == "skip":
                    value = F.when(old.isNotNull(), old.cast(df.schema[c].dataType)).otherwise(value)
                elif if_exists == "fail":
                    value = fail_when(old.isNotNull(), value, "ColumnRename", f"{target} has a value")
            out.append(value.alias(target))
        elif c not in taken.values():
            out.append(F.col(c))
    return df.select(*out)


def replace_null(df: DataFrame, value, *columns: str) -> DataFrame:
    require_columns(df, *columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in columns})


def _texts(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return list(columns) or [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in RESERVED]


def empty_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Empty texts become null; without columns, in all text columns."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in _texts(df, columns)})


def replace_error(df: DataFrame, value, *columns: str) -> DataFrame:
    """Cells in error get the value and are no longer in error; without columns, all cells."""
    if ERRORS not in df.columns:
        return df
    for c in columns or [c for c in df.columns if c not in RESERVED]:
        failed = F.map_contains_key(ERRORS, F.lit(c))
        df = df.withColumns({c: F.when(failed, F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(c)), ERRORS: without_error_of(c)})
    return df


def trim(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: text_functions.trim_all(F.col(c)) for c in _texts(df, columns)})


def replace_text(df: DataFrame, old: str, new: str, *columns: str, ignore_case: bool = False) -> DataFrame:
    return df.withColumns({c: text_functions.replace_text(F.col(c), old, new, ignore_case) for c in _texts(df, columns)})


def merge_text_columns(df: DataFrame, columns: list[str], target: str, separator: str = "", drop_source: bool = False) -> DataFrame:
    """Texts of the columns, joined, into target; the sources become null or go."""
    require_columns(df, *columns)
    out = df.withColumn("__merged", text_functions.merged_text([F.col(c) for c in columns], separator))
    out = out.drop(*columns) if drop_source else out.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})
    return out.withColumn(target, F.col("__merged")).drop("__merged")


def merge_date_with_time(df: DataFrame, date: str, time: str, target: str) -> DataFrame:
    require_columns(df, date, time)
    return df.withColumn(target, text_functions.merged_time(F.col(date), F.col(time)))


def convert(
    df: DataFrame,
    columns: list[str] | dict[str, str],
    converter: Callable[..., Column],
    null: str = "keep",
    invalid: str = "wrap",
    null_value=None,
    invalid_value=None,
    step: str = "convert",
    **options,
) -> DataFrame:
    """Columns through a converter, in place or (a dict) source to target.

    null: keep, value, remove_row, fail or wrap, for a null source.  invalid: the
    same for a value that does not convert; keep then leaves the cell null."""
    for policy in (null, invalid):
        require(policy in ("keep", "value", "remove_row", "fail", "wrap"), f"no such policy: {policy}")
    pairs = columns if isinstance(columns, dict) else {c: c for c in columns}
    require_columns(df, *pairs)
    if "wrap" in (null, invalid):
        df = with_errors(df)
    values, failed, bad_rows = {}, {}, F.lit(False)
    for source, target in pairs.items():
        kind = df.schema[source].dataType.simpleString()
        old = F.col(source)
        new = converter(old, of=kind, **options) if "of" in converter.__code__.co_varnames else converter(old, **options)
        absent, wrong = old.isNull(), old.isNotNull() & new.isNull()
        for policy, state, value in ((null, absent, null_value), (invalid, wrong, invalid_value)):
            if policy == "value":
                new = F.when(state, F.lit(value)).otherwise(new)
            elif policy == "fail":
                new = fail_when(state, new, "TypeConversion", F.concat(F.lit(f"{source}="), F.coalesce(old.cast("string"), F.lit("null"))))
            elif policy == "remove_row":
                bad_rows = bad_rows | state
        wrapped = (absent if null == "wrap" else F.lit(False)) | (wrong if invalid == "wrap" else F.lit(False))
        values[target] = new
        if "wrap" in (null, invalid):
            failed[target] = (wrapped, old)
    if "remove_row" in (null, invalid):
        df = df.where(~bad_rows)
    if failed:
        values[ERRORS] = set_errors(failed, "invalid value", step)
    return df.withColumns(values)


def add_incremental_id(df: DataFrame, column: str, order: list[str], first: int = 0, kind: str = "long") -> DataFrame:
    """Consecutive numbers from `first` in the given order."""
    at = unused(df, "__at")
    rows = numbered(df, order, at)
    number = F.col(at) + first
    return rows.select(*[c for c in df.columns if c != column], (number.cast("int") if kind == "int" else number.cast("long")).alias(column))


def add_key_hash(df: DataFrame, column: str, keys: list[str] | None = None, algorithm: str = "sha256", upper: bool = False, ignore_case: bool = False) -> DataFrame:
    return df.withColumn(column, key_functions.key_hash(key_functions.row_key(df, keys, ignore_case), algorithm, upper))


def add_checksum(df: DataFrame, column: str, columns: list[str] | None = None, excluding: list[str] | None = None) -> DataFrame:
    chosen = [c for c in columns or df.columns if c not in (excluding or []) and c not in RESERVED]
    return df.withColumn(column, key_functions.checksum([F.col(c) for c in chosen]))


def resolve_hierarchy(df: DataFrame, identity: str, levels: list[str], order: list[str], parent: str = "parentId", name: str | None = None, level: str | None = None, drop_levels: bool = False) -> DataFrame:
    """The parent of each row, from sparse level columns: a row is at its deepest non-empty level,
    its parent is the last row before it that was one level higher, null if none was."""
    require_columns(df, identity, *levels, *order)
    depth = F.coalesce(*[F.when(F.coalesce(F.col(levels[i]), F.lit("")) != "", i) for i in range(len(levels) - 1, -1, -1)])
    rows = df.withColumn("__depth", depth)
    rows = with_previous(rows, {f"__last{i}": F.when(F.col("__depth") == i, F.col(identity)) for i in range(len(levels))}, order, skip_nulls=True)
    found = F.coalesce(*[F.when(F.col("__depth") == i + 1, F.col(f"__last{i}")) for i in range(len(levels))])
    out = rows.withColumn(parent, found)
    if name:
        out = out.withColumn(name, F.get(F.array(*levels), F.col("__depth")))
    if level:
        out = out.withColumn(level, F.col("__depth"))
    return out.drop("__depth", "__first", *[f"__last{i}" for i in range(len(levels))], *(levels if drop_levels else []))


def set_tag(df: DataFrame, tag) -> DataFrame:
    return df.withColumn(TAG, tag if isinstance(tag, Column) else F.lit(tag).cast("string"))
