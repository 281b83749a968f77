"""Boolean columns. Spark pushes them to the Parquet reader, which skips row groups by their statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def eq(c: str | Column, value) -> Column:
    return _col(c) == value


def ne(c: str | Column, value) -> Column:
    return _col(c) != value


def lt(c: str | Column, value) -> Column:
    return _col(c) < value


def le(c: str | Column, value) -> Column:
    return _col(c) <= value


def gt(c: str | Column, value) -> Column:
    return _col(c) > value


def ge(c: str | Column, value) -> Column:
    return _col(c) >= value


def contains(c: str | Column, part: str) -> Column:
    """Case-sensitive substring of the column's text; ``%`` and ``_`` stand for themselves. For doubles by six decimals, pass :func:`lamina.functions.scalars.text`."""
    return F.contains(_col(c).cast("string"), F.lit(part))


def not_(p: Column) -> Column:
    return ~p


def all_of(*p: Column) -> Column:
    return reduce(and_, p)


def any_of(*p: Column) -> Column:
    return reduce(or_, p)


def at(index: int, columns: list[str]) -> Column:
    """The column at an ordinal of a result, for a condition on an aggregate."""
    name = columns[index].replace("`", "``")
    return F.col(f"`{name}`")
