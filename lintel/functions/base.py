"""Column idioms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def lookup(pairs: dict, key: Column) -> Column:
    """The value of a key in a fixed map, null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def first_match(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The result of the first true case."""
    out = reduce(lambda chain, case: F.when(*case) if chain is None else chain.when(*case), cases, None)
    return out if otherwise is None else out.otherwise(otherwise)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
