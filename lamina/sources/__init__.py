"""Readers and writers: CSV, and Parquet as the columnar format."""

from lamina.sources.columnar import describe, export_csv, read_table, tables, write_table
from lamina.sources.delimited import Progress, ingest, read_csv

__all__ = ["Progress", "describe", "export_csv", "ingest", "read_csv", "read_table", "tables", "write_table"]
