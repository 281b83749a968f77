"""Pieces that several operators share: reading, checkpoints, grouped batches, block grids and components.

Conventions of every operator here: it selects the columns it needs by name, so extra columns of any
name never clash; a null text is an empty text unless its docstring says otherwise; an empty table gives
an empty result with the same schema; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: what the session's ``spark.checkpoint.dir`` names or, where none is named, :func:`lamina.session.shared_folder`."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that all executors share, so that a lost executor costs no earlier work.

    Spark deletes the files when nothing refers to them, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows' bytes, by ``weight`` or 64 each, are few; beyond, it is joined by shuffles. It must be cheap to sum."""
    total = df.agg(F.sum(F.lit(64) if weight is None else weight)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def slots(spark: SparkSession) -> int:
    """Partitions to deal Python work into: those of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the session's limit of an Arrow batch to ``most`` bytes; a lower one stays.

    Spark takes the limit from the session alone. Its default of 64 MB is held by the JVM, once more while it grows, and by Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if now.startswith("-") or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most:
        spark.conf.set(key, f"{most}b")


def as_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id`` and ``__text``, the text as UTF-8 bytes (null: empty), so that Python need not decode it, to be sent in small batches."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__text"))


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Where consecutive pieces of about ``most`` bytes of a binary array begin and end; a longer text is a piece of its own."""
    sizes = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + most, "right")) - 1)
        yield begin, end
        begin = end


def rows_of(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of a batch in pieces of about ``most`` bytes, so that work arrays stay small whatever the texts' lengths."""
    ids, texts = batch.column(0), batch.column(1)
    for begin, end in pieces(texts, most):
        yield ids.slice(begin, end - begin).to_pylist(), texts.slice(begin, end - begin).to_pylist()


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a schema in Spark's notation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_texts(df: DataFrame, work: Callable[[list, list[bytes]], dict[str, object]], schema: str, most: int = 1 << 19) -> DataFrame:
    """``work(ids, texts)`` over pieces of ``df`` (the columns of :func:`as_bytes`); it returns the columns of ``schema``."""
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows_of(batch, most):
                out = work(ids, texts)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def groups_of(batches: Iterable[pa.RecordBatch], keys: int, least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first ``keys`` columns, each of ``least`` rows or more while rows last.

    A group's rows may span batches. A table holds whole groups only: what is not known to be complete waits.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        whole = pa.Table.from_batches(held)
        marks = bounds(whole, keys)
        if len(marks) > 2:
            yield whole.slice(0, marks[-2])
            held = whole.slice(marks[-2]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def bounds(rows: pa.Table, keys: int) -> np.ndarray:
    """Where the runs of equal leading columns begin, and the end."""
    if not rows.num_rows:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in range(keys):
        x = rows.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


def grid(df: DataFrame, keys: list[str], id_col: str, block: int) -> DataFrame:
    """``df`` with ``__i`` and ``__j``: its groups, those of over ``block`` rows cut into a triangle of chunk pairs.

    Two rows of one group meet in one pair (i, j), i <= j, at least; a pair holds about 2 x ``block`` rows, whatever
    the group's size, so a group with a third of all rows becomes many tasks. ``__c`` is the row's own chunk.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
    large = large.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.ceil(F.col("__n") / block).cast("int").alias("__chunks"))
    same = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    dealt = df.join(large, cond, "left").withColumn("__c", F.when(F.col("__chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64(id_col), F.col("__chunks"))).cast("int"))
    pairs = F.when(F.col("__chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("__chunks") - 1), lambda k: F.struct(F.least(k, F.col("__c")).alias("i"), F.greatest(k, F.col("__c")).alias("j")))
    )
    return dealt.withColumn("__p", F.explode(pairs)).select(*df.columns, "__c", F.col("__p.i").alias("__i"), F.col("__p.j").alias("__j"))


#: The base of polynomial hashes modulo 2**64.
ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    inverse = pow(int(ODD), -1, 1 << 64)
    up, down = np.full(n, ODD, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Forest:
    """Union-find over positions 0..n-1, fed with arrays of pairs; the smallest position of a tree is its root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            x = y

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            keep = a != b
            lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
            if not len(lo):
                return
            pairs = np.unique(hi * np.int64(len(self.up)) + lo)
            hi, lo = pairs // len(self.up), pairs % len(self.up)
            np.minimum.at(self.up, hi, lo)  # each pair stays until its two ends have one root
            a, b = hi, lo

    def all(self) -> np.ndarray:
        return self.roots(np.arange(len(self.up)))


def _stars(e: DataFrame) -> bool:
    """Whether every node of the pairs (a, b) is either the centre of a star or has one pair alone, with its centre."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the long pairs (a, b) the smallest node it reaches.

    Alternating large-star and small-star rounds on DataFrames until all that is left are stars: minima are pre-aggregated before the
    shuffle, joins are equi-joins that adaptive execution can split, and each round's edges are checkpointed. The number of
    rounds is logarithmic in the size of a component. Loops and nulls are dropped.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(e):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a")
        e = cut(linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
