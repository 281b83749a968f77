"""Line dedup: exact reference counts of line keys, and sharded cuckoo filters of the keys that repeat.

The reference table has a row per (key, document) pair; from it come the count of documents and the largest document of
each key. Both are monotone under inserts and recomputed from what remains under deletes, so incremental dedup is reversible.
The keys at or above the threshold also go into cuckoo filters, one per shard of the key space, which insert and delete
by fingerprint; every keyed line probes them, and only the lines that hit are looked up in the exact table, so a false hit costs a row and
changes nothing. Filters that are few are sent to where the texts are read; otherwise the lines' digests go to their shards' filters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import as_bytes, cut, groups_of, rows_of, slots, table

BLANK = b" \t\n\x0b\x0c\r"
#: Shards of the key space at least and at most, keys that a shard is meant for, and the parts that the lines of one shard are dealt to.
SHARDS, MOST_SHARDS, SHARD_KEYS, SALTS = 64, 1 << 16, 1 << 18, 16
#: Bytes of a filter for each of its keys (16 bits at a load of 0.4 to 0.8), and of all filters up to which they are broadcast; beyond, lines are dealt to the filters.
KEY_BYTES, FILTER_BYTES = 5, 32 << 20


def key_of(line: bytes, least: int) -> bytes | None:
    """The 16-byte digest of the line's key (white space stripped, A-Z lower-cased), None if the key has under ``least`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < least or len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class Cuckoo:
    """A cuckoo filter: two candidate buckets of four 16-bit fingerprints a key; supports insert, delete and membership."""

    def __init__(self, n: int = 0, table: np.ndarray | None = None) -> None:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / 4 / 0.8))))
        self.table = np.zeros((buckets, 4), dtype=np.uint16) if table is None else table

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        fp = (h & np.uint64(0xFFFF)).astype(np.uint64)
        fp = np.where(fp == 0, np.uint64(1), fp)
        one = (h >> np.uint64(20)) & mask
        return fp.astype(np.uint16), one.astype(np.int64), ((one ^ (fp * np.uint64(0x5BD1E995))) & mask).astype(np.int64)

    @classmethod
    def of(cls, h: np.ndarray) -> Cuckoo:
        """A filter that holds the hashes: of the size for their number or, where they find no places in that, of twice it, and so on."""
        for turn in range(16):
            made = cls(len(h) << turn)
            try:
                made.insert(h)
            except OverflowError:
                continue
            return made
        raise OverflowError("more equal hashes than two buckets hold")

    def insert(self, h: np.ndarray) -> None:
        """Adds hashes (uint64); a filter never grows in place, and one that is too full raises, its content then undefined."""
        fp, one, two = self._places(h)
        for f, a, b in zip(fp.tolist(), one.tolist(), two.tolist(), strict=True):
            at = a
            for turn in range(500):
                for spot in (a, b) if turn == 0 else (at,):
                    free = np.flatnonzero(self.table[spot] == 0)
                    if len(free):
                        self.table[spot, free[0]] = f
                        break
                else:
                    victim = (turn * 7 + f) % 4
                    f, self.table[at, victim] = int(self.table[at, victim]), f
                    at = int((np.uint64(at) ^ (np.uint64(f) * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1))
                    continue
                break
            else:
                raise OverflowError("the filter is full")

    def delete(self, h: np.ndarray) -> None:
        """Removes one copy of each hash; only hashes that were inserted may be deleted."""
        for f, a, b in zip(*(x.tolist() for x in self._places(h)), strict=True):
            for spot in (a, b):
                held = np.flatnonzero(self.table[spot] == f)
                if len(held):
                    self.table[spot, held[0]] = 0
                    break

    def has(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(h)
        return (self.table[one] == fp[:, None]).any(axis=1) | (self.table[two] == fp[:, None]).any(axis=1)


def _halves(keys: list[bytes], shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Shard and filter hash of 16-byte keys."""
    x = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    return (x[:, 1] % np.uint64(shards)).astype(np.int64), x[:, 0]


def shards_for(keys: int) -> int:
    """A power of two that grows with the number of keys, so that a shard's filter doesn't."""
    return min(MOST_SHARDS, max(SHARDS, 1 << max(0, (keys // SHARD_KEYS)).bit_length()))


def _keyed(ids: list, texts: list[bytes], least: int) -> tuple[list[bytes], list]:
    """The different keys of each text, and the id of each key's text."""
    keys: list[bytes] = []
    of: list = []
    for i, t in zip(ids, texts, strict=True):
        got = {k for x in t.split(b"\n") if len(x) >= least and (k := key_of(x, least))}
        keys += got
        of += [i] * len(got)
    return keys, of


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(key, doc): a row for each key of ``least`` code points or more and each row of ``docs`` with a non-null id that holds it."""

    def run(batches):
        for batch in batches:
            for ids, texts in rows_of(batch):
                keys, of = _keyed(ids, texts, least)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(of, pa.int64())], names=["key", "doc"])

    return as_bytes(docs.where(F.col(id_col).isNotNull()), id_col, text_col).mapInArrow(run, "key binary, doc long")


class LineIndex:
    """The exact table of references with its inserts and deletes. Each change gives a new index; tables are lazy until cut.

    A :meth:`stored` index also holds the table of repeated keys and the shards' filters. Its inserts and deletes count again only
    the keys that they touch, and put keys that cross the threshold into their shards' filters or take them out.
    A document is to be deleted before it is inserted with another text.
    """

    def __init__(self, refs: DataFrame, documents: int = 3, keys: DataFrame | None = None, shards: DataFrame | None = None, parts: int = SHARDS) -> None:
        self.refs, self.documents, self.keys, self.shards, self.parts = refs, documents, keys, shards, parts

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> LineIndex:
        return cls(lines_of(docs, id_col, text_col, least), documents)

    def stored(self) -> LineIndex:
        refs = cut(self.refs.distinct())
        keys = cut(LineIndex(refs, self.documents).repeated())
        parts = shards_for(keys.count())
        return LineIndex(refs, self.documents, keys, cut(filters(keys, parts)), parts)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> LineIndex:
        new = lines_of(docs, id_col, text_col, least)
        if self.keys is None:
            return LineIndex(self.refs.union(new), self.documents)
        new = cut(new.distinct())
        return self._changed(self.refs.union(new), new.select("key").distinct())

    def delete(self, gone: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the references of the documents whose ids are in ``gone``."""
        ids = gone.select(F.col(id_col).cast("long").alias("doc")).distinct()
        left = self.refs.join(ids, "doc", "left_anti").select("key", "doc")
        if self.keys is None:
            return LineIndex(left, self.documents)
        return self._changed(cut(left), cut(self.refs.join(ids, "doc", "left_semi").select("key").distinct()))

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The stored index of ``refs``, which differ from this one's in the keys of ``touched`` alone."""
        now = cut(LineIndex(refs.join(touched, "key", "left_semi"), self.documents).repeated())
        before = self.keys.join(touched, "key", "left_semi")
        keys = cut(self.keys.join(touched, "key", "left_anti").union(now))
        moves = now.join(before, "key", "left_anti").select("key", F.lit(True).alias("more")).union(before.join(now, "key", "left_anti").select("key", F.lit(False).alias("more")))
        return LineIndex(refs, self.documents, keys, moved(self.shards, moves, keys, self.parts), self.parts)

    def repeated(self) -> DataFrame:
        """(key, n, last): keys of at least ``documents`` documents, their count and the largest document.

        Counts are pre-aggregated before the shuffle; a document's repeated rows count once.
        """
        if self.keys is not None:
            return self.keys
        return self.refs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).where(F.col("n") >= self.documents)


def shard_of(key: str, shards: int) -> Column:
    """The shard of a 16-byte key, by two of its bytes; ``shards`` is a power of two."""
    return F.conv(F.hex(F.concat(F.substring(key, 10, 1), F.substring(key, 9, 1))), 16, 10).cast("int").bitwiseAND(F.lit(shards - 1))


def moved(shards: DataFrame, moves: DataFrame, keys: DataFrame, parts: int) -> DataFrame:
    """The filters of ``shards`` with the keys of ``moves`` put in (``more``) or taken out. A filter that gets too full is built again from ``keys``."""

    def move(held: pa.Table, new: pa.Table) -> pa.Table:
        shard = (held if held.num_rows else new).column("shard")[0].as_py()
        table = held.column("filter")[0].as_py() if held.num_rows else None
        if new.num_rows:
            more = np.array(new.column("more").to_pylist(), dtype=bool)
            _, h = _halves(new.column("key").to_pylist())
            try:
                if table is None:
                    f = Cuckoo.of(h[more])
                else:
                    f = Cuckoo(table=np.frombuffer(table, dtype=np.uint16).reshape(-1, 4).copy())
                    f.delete(h[~more])
                    f.insert(h[more])
                table = f.table.tobytes()
            except OverflowError:
                table = None
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([table], pa.binary())})

    dealt = moves.select(shard_of("key", parts).alias("shard"), "key", "more")
    out = cut(shards.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(move, "shard int, filter binary"))
    full = [r.shard for r in out.where("filter is null").select("shard").collect()]
    return cut(out.where("filter is not null").union(filters(keys.where(shard_of("key", parts).isin(full)), parts))) if full else out


def filters(keys: DataFrame, parts: int) -> DataFrame:
    """(shard, filter): the cuckoo filters of the column ``key``, built by the executors."""
    def build(batches):
        for whole in groups_of(batches, 1, 1):
            shards, values = whole.column(0).to_numpy(), whole.column(1).to_pylist()
            for s in np.unique(shards):
                _, h = _halves([k for k, x in zip(values, shards, strict=True) if x == s])
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([Cuckoo.of(h).table.tobytes()], pa.binary())], names=["shard", "filter"])

    dealt = keys.select(shard_of("key", parts).alias("shard"), "key").repartition(min(parts, slots(keys.sparkSession)), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(build, "shard int, filter binary")


def held_lines(docs: DataFrame, shards: DataFrame, parts: int) -> DataFrame:
    """Of the lines (key, doc) of ``docs``, those that their shards' filters hold. Each filter goes to SALTS tasks, ahead of the lines dealt there, which stream past it."""
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    lines = docs.select(shard_of("key", parts).alias("shard"), salt.alias("salt"), F.lit(1).alias("line"), "key", "doc", F.lit(None).cast("binary").alias("filter"))
    ahead = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("line"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc"), "filter")

    def probe(batches):
        at, f = None, None
        for batch in batches:
            shard, salt, line = (batch.column(c).to_numpy() for c in range(3))
            keep = []
            marks = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (line[1:] != line[:-1])))) if len(shard) else shard
            for a, b in zip(marks.tolist(), [*marks[1:].tolist(), len(shard)], strict=True):
                if line[a] == 0:
                    at, f = (shard[a], salt[a]), Cuckoo(table=np.frombuffer(batch.column(5)[a].as_py(), dtype=np.uint16).reshape(-1, 4))
                elif at == (shard[a], salt[a]):
                    _, h = _halves(batch.column(3).slice(a, b - a).to_pylist(), parts)
                    keep.append(a + np.flatnonzero(f.has(h)))
            rows = batch.take(pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4)], names=["key", "doc"])

    dealt = ahead.union(lines).repartition(slots(docs.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "line")
    return dealt.mapInArrow(probe, "key binary, doc long")


def drops(docs: DataFrame, id_col: str, text_col: str, least: int, documents: int, stored: LineIndex | None = None) -> DataFrame:
    """(__doc, __keys): the keys whose lines each document loses. Documents that lose none are missing."""
    spark = docs.sparkSession
    if stored is not None and stored.keys is None:
        stored = stored.stored()
    index = stored.keys.select("key", "last") if stored is not None else cut(LineIndex.of(docs, id_col, text_col, least, documents).repeated().select("key", "last"))
    n = index.count()
    parts = stored.parts if stored is not None else shards_for(n)
    shards = stored.shards if stored is not None else filters(index, parts)
    rows = docs.where(F.col(id_col).isNotNull())
    if n * KEY_BYTES <= FILTER_BYTES:
        sent = spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in shards.collect()})

        def probe(batches):
            held = {s: Cuckoo(table=np.frombuffer(x, dtype=np.uint16).reshape(-1, 4)) for s, x in sent.value.items()}
            for batch in batches:
                for ids, texts in rows_of(batch):
                    keys, of = _keyed(ids, texts, least)
                    if keys:
                        shard, h = _halves(keys, parts)
                        order = np.argsort(shard, kind="stable")
                        hit = np.zeros(len(keys), dtype=bool)
                        for one in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                            if (s := int(shard[one[0]])) in held:
                                hit[one] = held[s].has(h[one])
                        keys, of = [keys[k] for k in np.flatnonzero(hit)], [of[k] for k in np.flatnonzero(hit)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(of, pa.int64())], names=["key", "doc"])

        hits = as_bytes(rows, id_col, text_col).mapInArrow(probe, "key binary, doc long")
    else:
        hits = held_lines(lines_of(rows, id_col, text_col, least), shards, parts)
    # the looked-up table is written, so that the key of a very common line is one that the join can split
    gone = hits.join(index, "key").where("doc <> last")
    return cut(gone.groupBy("doc").agg(F.collect_set("key").alias("__keys")).withColumnRenamed("doc", "__doc"))


def stay(text: bytes, keys: list[bytes] | None, least: int) -> tuple[bytes, int, int]:
    """The text without the lines of ``keys``, its lines, and those dropped."""
    lines = text.split(b"\n")
    if not keys:
        return text, len(lines), 0
    gone = set(keys)
    left = [x for x in lines if len(x) < least or key_of(x, least) not in gone]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3, index: LineIndex | None = None) -> DataFrame:
    """Per row of ``docs``: the id, ``n_lines``, ``n_dropped`` and ``kept`` (binary: the lines that stay, joined by newlines).

    A null or empty text is one empty line. Keys under ``least`` code points are never dropped. Rows of one id are one document:
    if it is the largest holder, all its rows keep the line. Rows with a null id are not counted and keep all lines.
    With an ``index``, which is to hold ``docs`` (and may hold more, with the same ``least``), its counts decide, and nothing is counted again.
    """
    gone = drops(docs, id_col, text_col, least, documents, index)

    def work(batches):
        for batch in batches:
            kept, lines, dropped = zip(*(stay(t, k, least) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], names=["__id", "n_lines", "n_dropped", "kept"])

    joined = as_bytes(docs, id_col, text_col).join(gone, F.col("__id") == F.col("__doc"), "left").select("__id", "__text", "__keys")
    return joined.mapInArrow(work, "__id long, n_lines long, n_dropped long, kept binary").withColumnRenamed("__id", id_col)


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", least: int = 20, documents: int = 3, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with the dropped lines gone from their texts, and ``size_col``, if there is one, set to what is left of texts that lost some.
    An ``index`` is used as in :func:`drop_lines`."""
    gone = drops(docs, id_col, text_col, least, documents, index)

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array([stay(t, k, least)[0].decode("utf-8", "replace") for t, k in zip(texts.to_pylist(), keys.to_pylist(), strict=True)], pa.string())

    # only texts that lose lines go through Python
    joined = docs.join(gone, docs[id_col].cast("long") == F.col("__doc"), "left")
    untouched = joined.where("__keys is null").select(*docs.columns)
    changed = joined.where("__keys is not null").withColumn(text_col, rewrite(F.col(text_col).cast("string").cast("binary"), F.col("__keys")))
    if size_col in docs.columns:
        changed = changed.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return untouched.union(changed.select(*docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`drop_lines` of all documents, with the digest of what is kept."""
    out = drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
