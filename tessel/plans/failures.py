"""Failures of typed parts: conditions on a row under which the language gives an error instead of a value.

Lowering rules note them while a collector is open. A failure that is evaluated
whenever the program is, and whose message is a column, becomes the row's error.
Rows with any other failure (behind a condition, inside a higher-order function,
beside further outputs) are left to the interpreter.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Noted:
    condition: Column
    code: str
    message: Column | None
    guarded: bool


@dataclass
class Failures:
    """nulls tells whether nulls where a value is needed count: not if a check of the input's shape excludes them."""

    nulls: bool = True
    items: list[Noted] = field(default_factory=list)
    guards: int = 0

    def any(self) -> Column:
        return reduce(lambda a, b: a | b, (F.coalesce(n.condition, F.lit(False)) for n in self.items))

    def plain(self) -> bool:
        """Whether all of them are certain to be met and have their message."""
        return all(n.message is not None and not n.guarded for n in self.items)

    def error(self) -> Column:
        """The first failure, in the order of evaluation, or null."""
        return F.coalesce(*[F.when(n.condition, F.struct(F.lit(n.code).alias("code"), n.message.alias("message"))) for n in self.items])


_current: ContextVar[Failures | None] = ContextVar("failures", default=None)


@contextmanager
def collecting(nulls: bool = True) -> Iterator[Failures]:
    made = Failures(nulls)
    token = _current.set(made)
    try:
        yield made
    finally:
        _current.reset(token)


@contextmanager
def guarded() -> Iterator[None]:
    """Parts that aren't always evaluated, or whose errors are caught."""
    current = _current.get()
    if current is not None:
        current.guards += 1
    try:
        yield
    finally:
        if current is not None:
            current.guards -= 1


def note(condition: Column, code: str = "", message: Column | None = None, *, null: bool = False) -> None:
    """This row fails where the condition holds. null: it is about a null where a value is needed."""
    current = _current.get()
    if current is not None and (current.nulls or not null):
        current.items.append(Noted(condition, code, message, current.guards > 0))


def each(higher: Callable, items: Column, f: Callable) -> Column:
    """higher(items, f) for a higher-order function; the row fails where f does for some item."""
    current = _current.get()
    if current is None:
        return higher(items, f)
    with collecting(current.nulls) as inner:
        made = higher(items, f)
    if inner.items:

        def failing(*args: Column) -> Column:
            with collecting(current.nulls) as again:
                f(*args)
            return again.any()

        one, two = (lambda x: failing(x)), (lambda x, i: failing(x, i))
        note(F.exists(F.transform(items, one if len(inspect.signature(f).parameters) == 1 else two), lambda bad: bad))
    return made


def fold(items: Column, start: Column, step: Callable, finish: Callable | None = None) -> Column:
    """F.aggregate; the row fails where a step does."""
    current = _current.get()
    if current is None:
        return F.aggregate(items, start, step, finish) if finish else F.aggregate(items, start, step)
    with collecting(current.nulls) as inner:
        made = F.aggregate(items, start, step, finish) if finish else F.aggregate(items, start, step)
    if inner.items:

        def watched(acc: Column, x: Column) -> Column:
            with collecting(current.nulls) as again:
                out = step(acc["state"], x)
            return F.struct(out.alias("state"), (acc["bad"] | again.any()).alias("bad"))

        note(F.aggregate(items, F.struct(start.alias("state"), F.lit(False).alias("bad")), watched, lambda acc: acc["bad"]))
    return made
