"""Scan, filter, project, aggregate, group, sort and page.

Every operator only adds to the logical plan: pruning, push-down, partial aggregation, top-k and spill are Spark's.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.predicates import _col
from lamina.sources.columnar import read_table

Keys = Mapping[str, str | Column]


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """Columns of a table, and those rows that meet a condition, which may use any column of the table."""
    rows = read_table(spark, path)
    if condition is not None:
        rows = rows.where(condition)
    return rows.select(*columns) if columns else rows


def where(rows: DataFrame, condition: Column) -> DataFrame:
    """A filter; over groups, HAVING."""
    return rows.where(condition)


def project(rows: DataFrame, *columns: str | Column, **named: str | Column) -> DataFrame:
    return rows.select(*columns, *[_col(c).alias(n) for n, c in named.items()])


def aggregate(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """One row, also of no rows: counts are then 0 and other aggregates null."""
    return rows.agg(*[c.alias(n) for n, c in aggregates.items()])


def group_by(rows: DataFrame, keys: Keys | list[str], **aggregates: Column) -> DataFrame:
    """Groups by keys, which may be expressions and keep their types; no rows give no groups."""
    named = keys if isinstance(keys, Mapping) else {k: k for k in keys}
    return rows.groupBy(*[_col(c).alias(n) for n, c in named.items()]).agg(*[c.alias(n) for n, c in aggregates.items()])


def first_seen(rows: DataFrame, keys: list[str], by: str | None = None, **aggregates: Column) -> DataFrame:
    """:func:`group_by` in the order in which the groups first appear: by the column ``by`` or, without one, in the input's partitions.

    Spark packs files into partitions by size, so only within one file are partitions in the order of the input.
    """
    numbered = rows.withColumn("__at", F.col(by) if by else F.monotonically_increasing_id())
    grouped = group_by(numbered, keys, **aggregates, __first=F.min("__at"))
    return grouped.orderBy("__first").drop("__first")


def order(rows: DataFrame, *keys: str, desc: bool = False, then: tuple[str, ...] = ()) -> DataFrame:
    """A full sort by ``keys`` in one direction; ``then``, ascending, settles ties."""
    return rows.orderBy(*[F.desc(k) if desc else F.asc(k) for k in keys], *then)


def top_k(rows: DataFrame, k: int, *keys: str, desc: bool = True, then: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows of :func:`order`; each task keeps k of its own, and those alone are merged."""
    return order(rows, *keys, desc=desc, then=then).limit(k)


def page(rows: DataFrame, offset: int, limit: int, *keys: str, desc: bool = True, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of :func:`order`."""
    return order(rows, *keys, desc=desc, then=then).offset(offset).limit(limit)
