"""Control flow: steps that are skipped once one has failed, isolation, loops and values."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import StepFailed


def last_value(column: str, order: list[str]) -> Column:
    """The column's value in the last row by `order`; null without rows."""
    return F.max_by(column, F.struct(*order))


@dataclass
class State:
    failures: list[BaseException] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        return bool(self.failures)


class Flow:
    """Steps in a row.  A step's exception is kept; later steps are skipped until it is handled."""

    def __init__(self, state: State | None = None):
        self.state = state or State()
        self.values: dict[str, Any] = {}

    def run(self, step: Callable[[], Any], into: str | None = None) -> Flow:
        if not self.state.failed:
            try:
                result = step()
                if into:
                    self.values[into] = result
            except Exception as e:
                self.state.failures.append(e)
        return self

    def execute(self, df: Callable[[], DataFrame], sink: Callable[[DataFrame], Any] | None = None, into: str | None = None) -> Flow:
        """Runs a sequence: into a sink, or to its number of rows."""
        return self.run(lambda: sink(df()) if sink else df().count(), into)

    def take(self, df: Callable[[], DataFrame], into: str, limit: int | None = None) -> Flow:
        return self.run(lambda: (df().limit(limit) if limit is not None else df()).collect(), into)

    def set(self, name: str, value: Any) -> Flow:
        return self.run(lambda: value() if callable(value) else value, name)

    def set_from(self, name: str, df: Callable[[], DataFrame], column: str, order: list[str]) -> Flow:
        """The column's value in the last row by `order`; null without rows."""
        return self.run(lambda: df().agg(last_value(column, order)).first()[0], name)

    def write_observed(self, df: Callable[[], DataFrame], sink: Callable[[DataFrame], Any], values: dict[str, Column]) -> Flow:
        """Runs a sequence into a sink; each name becomes the value of its aggregate over the rows written, seen in passing: there is no
        second pass.  last_value is such an aggregate.  The sink must go through the rows; if it does so in parts, only one counts."""

        def step() -> None:
            seen = Observation()
            sink(df().observe(seen, *[v.alias(n) for n, v in values.items()]))
            self.values.update(seen.get)

        return self.run(step)

    def increment(self, name: str, by: int = 1) -> Flow:
        return self.run(lambda: self.values.get(name, 0) + by, name)

    def when(self, condition: Callable[[], bool] | bool, then: Callable[[Flow], Any], otherwise: Callable[[Flow], Any] | None = None) -> Flow:
        def step() -> None:
            branch = then if (condition() if callable(condition) else condition) else otherwise
            if branch:
                branch(self)

        return self.run(step)

    def for_each(self, items: Iterable | Callable[[], Iterable], body: Callable[[Any, Flow], Any], condition: Callable[[Any], bool] | None = None, isolated: bool = False) -> Flow:
        """The body for each item, each in a flow of its own if isolated, so that one failure does not stop the others."""

        def step() -> None:
            for item in items() if callable(items) else items:
                if condition and not condition(item):
                    continue
                if isolated:
                    self.isolate(lambda f, item=item: body(item, f))
                else:
                    body(item, self)
                    if self.state.failed:
                        return

        return self.run(step)

    def isolate(self, body: Callable[[Flow], Any]) -> Flow:
        """The body in a flow whose failures stay there."""
        inner = Flow()
        inner.values = self.values
        return self.run(lambda: inner.run(lambda: body(inner)))

    def handle(self, handler: Callable[[list[BaseException]], Any]) -> Flow:
        """Gives the failures to the handler; the flow goes on."""
        if self.state.failed:
            failures, self.state.failures = self.state.failures, []
            self.run(lambda: handler(failures))
        return self

    def raise_failures(self) -> Flow:
        if self.state.failed:
            raise StepFailed("; ".join(f"{type(e).__name__}: {e}" for e in self.state.failures)) from self.state.failures[0]
        return self
