"""Aggregates of any expression. Partial sums are built before the shuffle by Spark itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.predicates import _col


def count() -> Column:
    return F.count(F.lit(1))


def sum_(c: str | Column) -> Column:
    """Integers sum to a long, which raises rather than wraps."""
    return F.sum(_col(c))


def avg(c: str | Column) -> Column:
    return F.avg(_col(c))


def exact_avg(c: str | Column) -> Column:
    """Of wide integers: the sum is exact, and rounded once, when divided."""
    return F.sum(_col(c).cast("decimal(38,0)")).cast("double") / F.count(_col(c))


def exact_sum(c: str | Column, scale: int = 2) -> Column:
    """Of doubles with ``scale`` decimals: the same whatever the order of rows."""
    return F.sum(_col(c).cast(f"decimal(38,{scale})")).cast("double")


def min_(c: str | Column) -> Column:
    return F.min(_col(c))


def max_(c: str | Column) -> Column:
    return F.max(_col(c))


def count_distinct(c: str | Column) -> Column:
    """Exact, for any type."""
    return F.count_distinct(_col(c))


def composed(build: Callable[..., Column], *columns: str | Column) -> Column:
    """A user's own aggregate: ``build`` gets the columns and returns an expression of aggregates, which Spark sums up before and after the shuffle.

    ``composed(lambda x: F.sqrt(F.avg(x * x)), "a")`` is the root mean square. What no such expression gives is for a grouped Pandas UDF.
    """
    return build(*map(_col, columns))
