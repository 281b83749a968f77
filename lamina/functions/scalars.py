"""Scalar functions of one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.predicates import _col
from lamina.sources.delimited import DATE, TIME

HOST = r"^(?:https?://)?(?:www\.)?([^/]*)"


def byte_len(c: str | Column) -> Column:
    return F.octet_length(_col(c))


def url_host(c: str | Column) -> Column:
    """The URL up to its first slash, without ``http://`` or ``https://`` and then ``www.``."""
    return F.regexp_extract(_col(c), HOST, 1)


def minute_of(c: str | Column) -> Column:
    return F.minute(_col(c)).cast("long")


def trunc_minute(c: str | Column) -> Column:
    return F.date_trunc("minute", _col(c)).cast("timestamp_ntz")


def plus(c: str | Column, k: int) -> Column:
    """The column as a long, plus a constant, so that no narrow type overflows."""
    return _col(c).cast("long") + F.lit(k).cast("long")


def parse_date(c: str | Column) -> Column:
    """``YYYY-MM-DD``, or the epoch."""
    return F.coalesce(F.when(_col(c).rlike(DATE), _col(c).try_cast("date")), F.lit("1970-01-01").cast("date"))


def format_date(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def parse_timestamp(c: str | Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``, or the epoch."""
    return F.coalesce(F.when(_col(c).rlike(TIME), _col(c).try_cast("timestamp_ntz")), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def format_timestamp(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")


def text(c: str | Column, double: bool = False) -> Column:
    """The value as text; doubles with six decimals."""
    return F.format_string("%.6f", _col(c)) if double else _col(c).cast("string")
