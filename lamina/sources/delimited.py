"""CSV with fixed types. Missing text is an empty string, never null."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"


def _typed(field: T.StructField) -> Column:
    """A column of text as its type: bad integers raise, bad doubles are 0, bad dates and times the epoch."""
    raw = F.coalesce(F.col(f"`{field.name}`"), F.lit(""))
    kind = field.dataType
    if isinstance(kind, T.StringType):
        out = raw
    elif isinstance(kind, T.DoubleType):
        out = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    elif isinstance(kind, T.DateType):
        out = F.coalesce(F.when(raw.rlike(DATE), raw.try_cast("date")), F.lit("1970-01-01").cast("date"))
    elif isinstance(kind, T.TimestampNTZType):
        out = F.coalesce(F.when(raw.rlike(TIME), raw.try_cast("timestamp_ntz")), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    else:
        value = raw.try_cast(kind)
        why = F.concat(F.lit(f"column {field.name} holds no {kind.simpleString()}: "), raw)
        out = F.when(value.isNull(), F.raise_error(why).cast(kind)).otherwise(value)
    return out.alias(field.name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, multi_line: bool = False) -> DataFrame:
    """A comma-separated file with ``"`` quotes, doubled within quotes, as ``schema``.

    Rows with too few or too many fields raise (FAILFAST). Either line ending will do. ``multi_line`` allows line breaks within quotes
    but makes a file one task; without it files are split.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.csv(path, schema=text, header=header, enforceSchema=True, quote='"', escape='"', mode="FAILFAST", multiLine=multi_line, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    last = schema.fields[-1].name
    return raw.withColumn(last, F.rtrim(F.col(f"`{last}`"), F.lit("\r"))).select(*[_typed(f) for f in schema.fields])


@dataclass(frozen=True)
class Progress:
    """What an ingest has written: rows, files and their bytes, the bytes read, and the seconds that it took."""

    rows: int
    files: int
    bytes_written: int
    bytes_read: int
    seconds: float

    @property
    def rate(self) -> float:
        """MB read a second."""
        return self.bytes_read / 1e6 / max(self.seconds, 1e-9)


def _files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the files of a folder (or of one file) but for hidden ones."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for f in store.globStatus(where) for f in (store.listStatus(f.getPath()) if f.isDirectory() else [f])]
    sizes = [f.getLen() for f in found if f.getPath().getName()[0] not in "._"]
    return len(sizes), sum(sizes)


def ingest(spark: SparkSession, path: str, to: str, schema: T.StructType, cluster: list[str] | None = None, **options) -> Progress:
    """CSV to Parquet. With ``cluster``, rows are range-partitioned and sorted by these columns, so that row groups have narrow statistics
    and filters on them skip most. Rows are counted as they are written."""
    from lamina.sources.columnar import clustered, write_table

    began, seen = time.monotonic(), Observation()
    # counted behind the shuffle, as rows are read once more for the bounds of its ranges
    write_table(clustered(read_csv(spark, path, schema, **options), cluster).observe(seen, F.count(F.lit(1)).alias("rows")), to)
    files, written = _files(spark, to)
    return Progress(seen.get["rows"], files, written, _files(spark, path)[1], time.monotonic() - began)
