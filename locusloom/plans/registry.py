"""Physical strategies of overlap joins by name.

A strategy is a function of a `Join` that returns the joined rows: aliased sides of a plain join, or struct columns named by
the aliases; the left side's columns for semi and anti joins. `overlap_join(strategy=name)` runs one; "auto" asks the strategies
that say when they suit, last registered first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from locusloom.schema import Interval, IntervalSchema


@dataclass(frozen=True)
class Join:
    """What an overlap join is asked for. how: inner, left, right, full, semi or anti."""

    left: DataFrame
    right: DataFrame
    how: str
    left_schema: IntervalSchema
    right_schema: IntervalSchema
    predicate: Callable[[Interval, Interval], Column]
    on: Column | None
    left_alias: str
    right_alias: str
    bins: list[int] | None


@dataclass(frozen=True)
class Strategy:
    run: Callable[[Join], DataFrame]
    suits: Callable[[Join], bool]


_STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, run: Callable[[Join], DataFrame], suits: Callable[[Join], bool] = lambda join: False) -> None:
    """Makes a strategy known; one of the same name is replaced. suits: when "auto" takes it."""
    if name == "auto":
        raise ValueError("auto chooses among strategies and can't be one")
    _STRATEGIES.pop(name, None)
    _STRATEGIES[name] = Strategy(run, suits)


def unregister_strategy(name: str) -> None:
    del _STRATEGIES[name]


def strategies() -> list[str]:
    return list(_STRATEGIES)


def joined_by(name: str, join: Join) -> DataFrame:
    if name == "auto":
        name = next(n for n in reversed(_STRATEGIES) if _STRATEGIES[n].suits(join))
    if name not in _STRATEGIES:
        raise ValueError(f"unknown strategy {name}; known: {', '.join(_STRATEGIES)}")
    return _STRATEGIES[name].run(join)
