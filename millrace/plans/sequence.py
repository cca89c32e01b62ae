"""Fluent sequences: a DataFrame with the operators as methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..errors import RESERVED
from ..operators import aggregate, columns, filters, generate, lookup, sets

_OPERATORS: dict[str, Callable[..., DataFrame]] = {
    name: function
    for module in (filters, columns, generate, aggregate, lookup, sets)
    for name, function in vars(module).items()
    if callable(function) and not name.startswith("_") and getattr(function, "__module__", "") == module.__name__
}


class Seq:
    """Seq(df).remove_rows(...).join(...).df: every operator of the library, and conditional blocks."""

    def __init__(self, df: DataFrame):
        self.df = df

    def then(self, operator: Callable[..., DataFrame], *args, **options) -> Seq:
        return Seq(operator(self.df, *args, **options))

    def __getattr__(self, name: str) -> Callable[..., Seq]:
        operator = _OPERATORS.get(name)
        if operator is None:
            raise AttributeError(name)
        return lambda *args, **options: self.then(operator, *args, **options)

    def when(self, condition: Column, block: Callable[[Seq], Seq]) -> Seq:
        """The block's operators on rows that meet the condition; the others pass through.  Nested conditions add up."""
        return Seq(filters.apply_where(self.df, condition, lambda df: block(Seq(df)).df))

    def when_tag(self, condition: Callable[[Column], Column], block: Callable[[Seq], Seq]) -> Seq:
        return Seq(filters.apply_where_tag(self.df, condition, lambda df: block(Seq(df)).df))

    def if_true(self, flag: bool, block: Callable[[Seq], Seq]) -> Seq:
        return block(self) if flag else self

    def cached(self) -> Seq:
        return Seq(self.df.persist())

    def result(self) -> DataFrame:
        """The rows without the reserved columns."""
        return self.df.drop(*RESERVED)
