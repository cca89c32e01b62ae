"""Operators that make several rows of one."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RESERVED, TAG, require, require_columns
from ..workspace import unused
from .ordering import ranged


def explode_rows(df: DataFrame, rows: Column, keep_original: bool = False) -> DataFrame:
    """A row for each struct of the array `rows`; its fields replace or join the row's columns.
    With keep_original the row itself comes along."""
    made = df.select("*", F.explode(rows).alias("__made"))
    fields = made.schema["__made"].dataType.fieldNames()
    out = made.select(*[c for c in df.columns if c not in fields], *[F.col(f"__made.{f}").alias(f) for f in fields])
    return df.unionByName(out, allowMissingColumns=True) if keep_original else out


def explode_frames(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str, by: list[str] | None = None) -> DataFrame:
    """Rows made by a Python function: of batches, or of whole groups if `by` is given (each group must fit a task)."""
    if by:
        return df.groupBy(*by).applyInPandas(lambda group: pd.concat(list(function(iter([group])))), schema)
    return df.mapInPandas(lambda batches: iter(function(batches)), schema)


@dataclass(frozen=True)
class Scan:
    """How a whole input, in one order, becomes other rows, a range of it at a time.

    empty: the state before the first row.  summary(frames): what a range, on its own, does to a state.
    combine(a, b): a, then b; associative, with `empty` neutral.  rows(state, frames): the rows made of
    a range, given the state before it.  States are pickled and should be small: there is one for each range."""

    empty: Any
    summary: Callable[[Iterator[pd.DataFrame]], Any]
    combine: Callable[[Any, Any], Any]
    rows: Callable[[Any, Iterator[pd.DataFrame]], Iterable[pd.DataFrame]]


def explode_whole(df: DataFrame, order: list[str], scan: Scan, schema: str, keep_original: bool = False, ranges: int | None = None) -> DataFrame:
    """Rows that a scan makes of all rows of df in one global order (nulls first).

    A parallel prefix scan: each range is summed up on its own, the summaries (a row a range) are
    combined from left to right, and each range is gone through again from the state before it, frame by
    frame.  No task holds more than a frame of its range.  With keep_original df's rows come along."""
    r = ranged(df, order, ranges)
    state = unused([*df.columns, r.range, r.place], "__state")
    columns, place = df.columns, r.place

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts: list[int] = []

        def own() -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    starts[:] = starts or [int(frame[place].iloc[0])]
                    yield frame[columns]

        found = scan.summary(own())
        if starts:
            yield pd.DataFrame({place: starts, state: [pickle.dumps(found)]})

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far = scan.empty
        for frame in frames:
            for start, found in zip(frame[place], frame[state]):
                yield pd.DataFrame({place: [start], state: [pickle.dumps(so_far)]})
                so_far = scan.combine(so_far, pickle.loads(found))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next((f for f in frames if len(f)), None)
        if first is not None:
            own = (f[columns] for f in chain([first], frames) if len(f))
            yield from scan.rows(pickle.loads(first[state].iloc[0]), own)

    kinds = f"`{place}` long, `{state}` binary"
    states = r.together().sortWithinPartitions(place).mapInPandas(summed, kinds)
    # a row a range, for its first row; shuffled, as a coalesce would have the one task sum up all ranges itself
    carried = states.repartition(1).sortWithinPartitions(place).mapInPandas(scanned, kinds)
    rows = r.together().join(F.broadcast(carried), place, "left")
    out = rows.sortWithinPartitions(place).mapInPandas(made, schema)
    return df.unionByName(out, allowMissingColumns=True) if keep_original else out


def unpivot(df: DataFrame, dimension: str, value: str, values: list[str] | None = None, fixed: list[str] | dict[str, str] | None = None, skip_nulls: bool = True) -> DataFrame:
    """Columns become rows of (dimension, value).

    With `values` those columns do, and null values are skipped unless told
    otherwise; without, all columns but the fixed ones do, nulls included."""
    require(bool(values) or bool(fixed), "unpivot needs value columns or fixed columns")
    names = fixed if isinstance(fixed, dict) else {c: c for c in fixed} if fixed else None
    chosen = values or [c for c in df.columns if c not in names and c not in RESERVED]
    require_columns(df, *chosen, *(names or {}))
    kept = names if names is not None else {c: c for c in df.columns if c not in chosen}
    kinds = {df.schema[c].dataType.simpleString() for c in chosen}
    cells = F.array(*[F.struct(F.lit(c).alias("d"), (F.col(c) if len(kinds) == 1 else F.col(c).cast("string")).alias("v")) for c in chosen])
    if values and skip_nulls:
        cells = F.filter(cells, lambda x: x["v"].isNotNull())
    rows = df.select(*[F.col(s).alias(t) for s, t in kept.items()], F.explode(cells).alias("__cell"))
    return rows.select(*kept.values(), F.col("__cell.d").alias(dimension), F.col("__cell.v").alias(value))


def tagged_versions(df: DataFrame, *tags: str, keep_original: bool = False) -> DataFrame:
    """A copy of each row for each tag; the original too if asked for."""
    own = [F.col(TAG) if TAG in df.columns else F.lit(None).cast("string")] if keep_original else []
    rest = [c for c in df.columns if c != TAG]
    return df.select(*rest, F.explode(F.array(*own, *[F.lit(t) for t in tags])).alias(TAG))
