"""Tables as Parquet: column pruning, statistics and encodings are the format's and the reader's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.schema import tags

#: The tables that the driver provides.
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table, or some of its columns in the order asked for; an unknown column raises."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def clustered(rows: DataFrame, columns: list[str] | None) -> DataFrame:
    """``rows`` range-partitioned and sorted by ``columns``, if any are given."""
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else rows


def write_table(rows: DataFrame, path: str, cluster: list[str] | None = None, mode: str = "errorifexists", group_bytes: int = 128 << 20, delta: bool = False) -> None:
    """Parquet with row groups of ``group_bytes``; ``cluster`` as in :func:`lamina.sources.delimited.ingest`.

    With ``delta``, integers, dates and times that a dictionary doesn't suit are stored as packed differences, and strings with
    the prefix that they share with the one before (version 2 of the format's pages).
    """
    writer = clustered(rows, cluster).write.mode(mode).option("parquet.block.size", group_bytes)
    if delta:
        writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    writer.parquet(path)


def export_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    """CSV that :func:`lamina.sources.delimited.read_csv` reads back: quotes where needed, doubled within."""
    rows.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=header, quote='"', escape='"', emptyValue="", dateFormat="yyyy-MM-dd", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def describe(rows: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of each column."""
    return tags(rows.schema)
