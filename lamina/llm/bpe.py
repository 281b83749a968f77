"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of over ``chunk`` characters is cut into overlapping chunks, which are pre-tokenised in parallel. Whether a position
is a pre-token boundary depends only on where the scan began, and from a shared boundary on two scans agree; so
chunk k + 1 is joined to chunk k at the first boundary they share in their overlap, which any pre-token may end, with or without white
space. A chunk that shares none, as within one word longer than the overlap or a run of digits that a pattern cuts by threes, is
scanned on from the last boundary known, until a boundary is one that a later chunk has found. The pieces between joints are
then encoded in parallel, and ids are joined in order. Shorter texts are one piece. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import arrow_schema, bound_batches, bounds, cut, groups_of, map_texts, slots, table

#: Characters of a chunk, and those that two neighbours share.
CHUNK, OVERLAP = 32768, 2048
RANKS = "byte_bpe_multi_50k.tiktoken"


def load(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, read by the driver and sent to the executors, which may not have it; a vocabulary is under 10 MB."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 10 << 20:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return spark.sparkContext.broadcast(data)


@lru_cache(4)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def boundaries(text: str, at: int, whole: bool, pattern: str) -> np.ndarray:
    """Ends of pre-tokens of ``text``, which begins at ``at``, at which it may be parted.

    If more text follows (not ``whole``), those that it could change are left out. So are ends behind white space: only such a
    pre-token is split by what comes after it (the pattern looks ahead there alone), so a text cut behind one could be split otherwise.
    """
    ends = [m.end() for m in splitter(pattern).finditer(text)][: None if whole else -2]
    return np.array([e + at for e in ends if e < len(text) and not text[e - 1].isspace()], dtype=np.int64)


def encode_whole(text: str, enc: tiktoken.Encoding) -> list[int]:
    return enc.encode_ordinary(text)


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    return b"".join(enc.decode_tokens_bytes(ids))


def stitch(text: str, starts: list[int], chunks: list[np.ndarray], chunk: int, pattern: str) -> list[int]:
    """Joints of a text from the boundaries of its chunks, which begin at ``starts``: piece k is joints[k]:joints[k + 1].

    Boundaries are right from the first chunk's, and from any that one shares with the boundaries already right. Where neighbours share
    none, the text is scanned on from the last that is right, and parted on the way as often as chunks would be.
    """
    joints, right = [0], chunks[0]
    k = 1
    while k < len(starts):
        both = np.intersect1d(right, chunks[k], assume_unique=True)
        if len(both):
            joints.append(int(both[0]))
            right = chunks[k][chunks[k] >= both[0]]
            k += 1
            continue
        at = max(joints[-1], int(right[-1]) if len(right) else 0)
        right = chunks[-1][:0]
        for m in splitter(pattern).finditer(text, at):
            e = m.end()
            if e >= len(text) or text[e - 1].isspace():
                continue
            while k < len(starts) - 1 and e >= starts[k + 1] + chunk:  # past this chunk without meeting it
                k += 1
            j = next((j for j in (k, k + 1) if j < len(starts) and (x := int(np.searchsorted(chunks[j], e))) < len(chunks[j]) and chunks[j][x] == e), None)
            if j is not None:
                joints.append(e)
                right, k = chunks[j][chunks[j] >= e], j + 1
                break
            if e - joints[-1] >= chunk:
                joints.append(e)
        else:
            break
    return [*joints, len(text)]


def pieces(long: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(__row, __k, __piece) of (__row, __t): each text's pieces in order, which split by the pattern as the text does."""
    n = slots(long.sparkSession)

    def to_chunks(batches):
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = list(range(0, len(t), chunk))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([len(t)] * len(at), pa.int64()), pa.array([t[x : x + chunk + overlap] for x in at])], names=["__row", "__at", "__n", "__chunk"])

    def scan(batches):
        for b in batches:
            row, at, n, texts = (c.to_pylist() for c in b.columns)
            ends = [boundaries(t, x, x + len(t) >= m, pattern) for t, x, m in zip(texts, at, n, strict=True)]
            # joints lie where chunks overlap
            ends = [e[(e <= x + overlap) | (e >= x + chunk)] for e, x in zip(ends, at, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.list_(pa.int64()))], names=["__row", "__at", "__ends"])

    def to_pieces(batches):
        for b in batches:
            for row, t, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = sorted(found, key=lambda x: x["__at"])
                joints = stitch(t, [x["__at"] for x in found], [np.array(x["__ends"], dtype=np.int64) for x in found], chunk, pattern)
                part = [t[x:y] for x, y in zip(joints[:-1], joints[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array(range(len(part)), pa.int32()), pa.array(part)], names=["__row", "__k", "__piece"])

    chunks = long.select("__row", "__t").mapInArrow(to_chunks, "__row long, __at long, __n long, __chunk string").repartition(n, "__row", "__at")
    ends = chunks.mapInArrow(scan, "__row long, __at long, __ends array<long>")
    found = ends.groupBy("__row").agg(F.collect_list(F.struct("__at", "__ends")).alias("__found"))  # a text's own, few to a chunk
    return long.join(found, "__row").select("__row", "__t", "__found").mapInArrow(to_pieces, "__row long, __k int, __piece string")


def _coded(docs: DataFrame, id_col: str, text_col: str, shape: str, finish: Callable[[list, list[bytes]], dict[str, object]], path: str | None, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """The id of each row of ``docs`` and the columns of ``shape``, which ``finish`` makes of whole lists of ids and their bytes where they come about."""
    spark = docs.sparkSession
    bound_batches(spark)
    ranks = load(spark, path or public_tokenizers.path(RANKS))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__t"))
    size = F.coalesce(F.length("__t"), F.lit(0))  # in characters, as chunks are

    def work(ids, texts):
        enc = encoding(ranks.value, pattern)
        got = [encode_whole(t.decode("utf-8", "replace"), enc) for t in texts]
        return {"__doc": ids} | finish(got, [decode(x, enc) for x in got])

    short = map_texts(rows.where(size <= chunk).select("__doc", F.coalesce("__t", F.lit("")).cast("binary")), work, f"__doc long, {shape}")
    # long texts only are numbered, cut, and joined again
    long = cut(rows.where(size > chunk).withColumn("__row", F.monotonically_increasing_id()))

    def code(batches):
        enc = encoding(ranks.value, pattern)
        for b in batches:
            got = [encode_whole(t, enc) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int32())), pa.array([decode(x, enc) for x in got], pa.binary())], names=["__row", "__k", "ids", "decoded"])

    kind = arrow_schema(f"__row long, {shape}")

    def glue(batches):
        for whole in groups_of(batches, 1):
            row, ids, raw = (whole.column(c).combine_chunks() for c in ("__row", "ids", "decoded"))
            marks = bounds(whole, 1)
            for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):  # ids stay an array, not Python numbers
                out = {"__row": row.slice(a, 1)} | finish([ids.slice(a, b - a).flatten().to_numpy()], [b"".join(raw.slice(a, b - a).to_pylist())])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)

    n = slots(spark)
    coded = pieces(long, chunk, overlap, pattern).repartition(n, "__row", "__k").mapInArrow(code, "__row long, __k int, ids array<int>, decoded binary")
    whole = coded.repartition(n, "__row").sortWithinPartitions("__row", "__k").mapInArrow(glue, f"__row long, {shape}")
    return short.union(long.select("__row", "__doc").join(whole, "__row").drop("__row")).withColumnRenamed("__doc", id_col)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` (array of int) and ``decoded`` (their bytes, joined).

    A null or empty text has no ids. Ids equal those of tiktoken's encode_ordinary over the whole text. Repeated and null ids
    of documents are fine: rows are told apart by their own number.
    """
    return _coded(docs, id_col, text_col, "ids array<int>, decoded binary", lambda ids, raw: {"ids": ids, "decoded": raw}, path, pattern, chunk, overlap)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """:func:`encode`, but per row the id, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``."""

    def finish(ids, raw):
        return {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(np.ascontiguousarray(x, dtype="<u4")).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
        }

    return _coded(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish, path, pattern, chunk, overlap)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`digests` of all documents."""
    return digests(table(spark, sf_dir, "documents"))
