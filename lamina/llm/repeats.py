"""Suffix dedup of bytes by column-wise multi-document construction.

Every 100-byte string holds, among its 32-byte grams, a first one of least hash, its anchor, which the string's content
alone chooses: equal strings have it at equal offsets. Strings with the same anchor in a text follow each other; if the
anchor's gram occurs more than once in the corpus, the bytes they cover to either side of it make a piece (the gram itself goes
as 128 bits of hash), and the pieces of one gram are a collection of short documents aligned by columns. Their suffixes are sorted as multi-string Burrows-Wheeler construction does:
column by column from the right, each round inserts one symbol of every piece. The symbols in the order of the round before are that column's
segment of the transform; a stable sort by symbol gives the new order, and the common prefix of two neighbours is one more
than the least one between their places in the old order. Neighbours with common prefixes of 68 or more, the gram left out, are
one string.

Rounds run over 136 columns, not the longest document's bytes, and a column's segment takes the place of the one before,
since equal strings always meet in the same column; so the passes over external files that whole documents would need are
passes over arrays of one task, whose pieces are dealt by anchor.

Equal texts are told first: all but the earliest go as a whole, and are not cut into pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import bound_batches, bounds, cut, groups_of, powers, rows_of, sized, slots, table

#: Length of the strings, of the grams, and the grams in a string.
LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes to either side of an anchor that a string with it can cover
COLUMNS = 2 * REACH
#: The filters of repeated and of hot grams: 256 slices of this many bits, 8 MB each whatever the input. False hits cost time alone.
SLICE_BITS = 1 << 18
#: Occurrences of a gram beyond which its pieces don't meet in one task as they are.
HOT = 5_000
#: Kinds of spans: to remove; a hot piece, to remove unless it is the first of its like; such a first.
GONE, HELD, FIRST = 0, 1, 2
_K = np.uint64(0xC2B2AE3D27D4EB4F)


def sliding(op: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """``op`` over each w neighbours of ``x``, by running values within blocks of w from either side."""
    n = len(x) - w + 1
    pad = np.concatenate((x, np.repeat(x[-1:], -len(x) % w))).reshape(-1, w)
    up = op.accumulate(pad, axis=1).ravel()
    down = op.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(down[:n], up[w - 1 : w - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of the joined texts' anchors: gram hash, place, and where the first and last string with it begin; where each text
    begins (and the end); the joined texts."""
    joined = b"".join(texts)
    first = np.cumsum([0] + [len(t) for t in texts])
    raw = np.frombuffer(joined, dtype=np.uint8)
    n = len(raw)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, first, joined
    up, down = powers(1 << n.bit_length())
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(raw * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h = (h ^ (h >> np.uint64(32))) * _K
    h ^= h >> np.uint64(29)
    # the 33 highest bits of the hash, then the place: the least is the first of least hash
    low = np.uint64((1 << 31) - 1)
    least = sliding(np.minimum, (h & ~low) | np.arange(len(h), dtype=np.uint64), REACH + 1) & low
    ends = np.repeat(first[1:], np.diff(first))
    begin = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[: len(least)])  # strings don't cross documents
    at = least[begin].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else begin
    last = np.append(new[1:], len(at)) - 1 if len(at) else begin
    return h[at[new]], at[new], begin[new], begin[last], first, joined


def columnwise(pieces: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int = REACH) -> np.ndarray:
    """For each piece (a row of symbols, 0 where it has none) and each column, whether the string of ``length`` symbols
    from there also stands, in the same column, in a piece of its group with a smaller ``rank``.

    ``group`` is sorted. One round per column, from the right.
    """
    n, columns = pieces.shape
    repeated = np.zeros((n, columns - length + 1), dtype=bool)
    order = np.arange(n)
    common = np.zeros(n + 1, dtype=np.int32)  # of each piece in order with the one before; one more so that ranges may end there
    apart = np.concatenate(([True], group[1:] != group[:-1]))
    base = np.cumsum(apart).astype(np.int64) * 512
    for j in range(columns - 1, -1, -1):
        symbol = pieces[order, j].astype(np.int64)  # this column's segment of the transform
        key = base + symbol  # groups keep their places
        if (key[1:] < key[:-1]).any():
            turn = np.argsort(key, kind="stable")
            key, symbol = key[turn], symbol[turn]
        else:
            turn = np.arange(n)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        new = np.zeros(n + 1, dtype=np.int32)
        if len(same):
            ranges = np.stack((turn[same - 1] + 1, turn[same] + 1), axis=1).ravel()
            new[same] = np.where(symbol[same] > 0, np.minimum.reduceat(common, ranges)[::2] + 1, 0)
        order, common = order[turn], new
        if j < repeated.shape[1]:
            runs = np.flatnonzero(common[:n] < length)
            if len(runs) < n:
                r = rank[order]
                least = np.repeat(np.minimum.reduceat(r, runs), np.diff(np.append(runs, n)))
                repeated[order, j] = r > least
    return repeated


def intervals(repeated: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and begins and ends in columns, of what runs of repeated strings cover."""
    edge = np.diff(np.pad(repeated.view(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, begin, end + length - 1


def _merge(spans: list[dict]) -> list[list[int]]:
    """Sorted, disjoint and not touching (begin, end) of what goes of a document."""
    firsts = {x["begin"] for x in spans if x["kind"] == FIRST}  # a document's pieces differ in where they begin
    gone = np.array([(x["begin"], x["end"]) for x in spans if x["kind"] == GONE or x["kind"] == HELD and x["begin"] not in firsts], dtype=np.int64)
    if not len(gone):
        return []
    gone = gone[np.argsort(gone[:, 0], kind="stable")]
    reach = np.maximum.accumulate(gone[:, 1])
    new = np.concatenate(([True], gone[1:, 0] > reach[:-1]))
    return np.stack((gone[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(gone) - 1)]), axis=1).tolist()


def _name(h: int, x: int, piece: bytes, left: int) -> bytes:
    return hashlib.blake2b(b"%d,%d,%d," % (h, x, left) + piece, digest_size=16).digest()


def _sizes(rows: pa.Table) -> np.ndarray:
    """For each row the rows of its gram."""
    size = np.diff(bounds(rows, 2))
    return np.repeat(size, size)


def _compare(rows: pa.Table) -> pa.RecordBatch:
    """Spans to remove of whole groups of pieces (h, x, piece, left, doc, v, pos), sorted by h and x.

    Of equal pieces the first stands for all; the others go as a whole. Different ones are compared column by column.
    """
    rows = rows.filter(pa.array(_sizes(rows) > 1))
    h, x, left, doc, v, pos = (rows.column(c).to_numpy() for c in ("h", "x", "left", "doc", "v", "pos"))
    text = rows.column("piece").to_pylist()
    length = np.array([len(t) for t in text], dtype=np.int64)
    order = np.lexsort((pos, v, doc))
    rank = np.empty(len(text), dtype=np.int64)
    d, w, q = doc[order], v[order], pos[order]
    rank[order] = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (q[1:] != q[:-1]))))[: len(text)]
    names = list(zip(h.tolist(), x.tolist(), left.tolist(), text, strict=True))
    one: dict[tuple[int, int, int, bytes], int] = {}
    for k in order.tolist():
        one.setdefault(names[k], k)
    kept = np.zeros(len(text), dtype=bool)
    kept[np.fromiter(one.values(), dtype=np.int64, count=len(one))] = True
    # an equal place is the same row given twice, and not an earlier one
    copy = np.flatnonzero(rank > np.array([rank[one[y]] for y in names], dtype=np.int64))
    out = [(doc[copy], v[copy], (pos - left)[copy], (pos - left + length + GRAM)[copy])]
    size = _sizes(rows.filter(pa.array(kept)))
    two = np.flatnonzero(kept)[size > 1]
    if len(two):
        symbols = np.zeros((len(two), COLUMNS), dtype=np.uint16)
        for row, k in enumerate(two.tolist()):
            a = REACH - left[k]
            symbols[row, a : a + length[k]] = np.frombuffer(text[k], dtype=np.uint8)
            symbols[row, a : a + length[k]] += 1
        new = np.concatenate(([True], (h[two][1:] != h[two][:-1]) | (x[two][1:] != x[two][:-1])))
        row, a, b = intervals(columnwise(symbols, np.cumsum(new), rank[two]))
        start = (pos[two] - REACH)[row]
        out.append((doc[two][row], v[two][row], start + a, start + b))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["doc", "v", "begin", "end"])


def repeated_spans(base: DataFrame) -> DataFrame:
    """(doc, v, begin, end, kind): byte spans of rows (doc, text, v); ``v`` orders rows of one ``doc``. Spans may overlap.

    Pieces of a gram meet in one task, unless it occurs over HOT times: then equal pieces are reduced to their first before the
    shuffle, each document is told which of its pieces are such firsts, and its other hot pieces go. If over HOT different
    pieces of a gram are left, their strings are compared by hash, again reduced before the shuffle.
    """
    spark = base.sparkSession
    n = slots(spark)

    def count(batches):
        for batch in batches:
            for _, texts in rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(texts)[0].view(np.int64))], names=["h"])

    again = base.select("doc", "text").mapInArrow(count, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def bits_of(h: np.ndarray) -> np.ndarray:
        return np.concatenate([(h >> np.uint64(shift)) & np.uint64(SLICE_BITS - 1) for shift in (8, 26, 38)])  # an anchor's highest bits are small

    def slice_bits(batches):
        for whole in groups_of(batches, 1):
            slices, h, times = whole.column(0).to_numpy(), whole.column(1).to_numpy().view(np.uint64), whole.column(2).to_numpy()
            for s in np.unique(slices):
                bits = np.zeros((2, SLICE_BITS), dtype=bool)
                bits[0, bits_of(h[slices == s])] = True
                bits[1, bits_of(h[(slices == s) & (times > HOT)])] = True
                packed = [np.packbits(x, bitorder="little").tobytes() if x.any() else None for x in bits]
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["s", "bits", "hot"])

    dealt = again.select(F.col("h").bitwiseAND(F.lit(255)).cast("int").alias("s"), "h", "n").repartition(min(256, n), "s").sortWithinPartitions("s")
    tables = np.zeros((2, 256, SLICE_BITS // 8), dtype=np.uint8)
    for r in dealt.mapInArrow(slice_bits, "s int, bits binary, hot binary").toLocalIterator():  # 256 rows of 64 kB at most
        for k, x in enumerate((r.bits, r.hot)):
            if x is not None:
                tables[k, r.s] = np.frombuffer(x, dtype=np.uint8)
    any_hot = bool(tables[1].any())
    sent = spark.sparkContext.broadcast(tables if any_hot else tables[:1])

    def held(h: np.ndarray, k: int) -> np.ndarray:
        """Whether the filter of repeated grams (k = 0) or hot ones (1) holds each hash."""
        if k and not any_hot:
            return np.zeros(len(h), dtype=bool)
        s = np.tile((h & np.uint64(255)).astype(np.int64), 3)
        bit = bits_of(h).astype(np.int64)
        return ((sent.value[k, s, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).reshape(3, -1).all(axis=0)

    def occurrences(texts: list[bytes], hot: bool):
        """Per repeated anchor, of hot grams or the others: its text's place in the list, two hashes of its gram, piece, bytes left of the gram, and place in the text."""
        h, at, begin, last, first, joined = anchors(texts)
        hit = held(h, 0)
        hit &= held(h, 1) == hot
        h, at, begin, end = h[hit].view(np.int64), at[hit], begin[hit], last[hit] + LENGTH
        of = np.searchsorted(first, at, "right") - 1
        places = list(zip(begin.tolist(), at.tolist(), (at + GRAM).tolist(), end.tolist(), strict=True))
        x = np.array([xxhash.xxh64_intdigest(joined[p:q]) for _, p, q, _ in places], dtype=np.uint64).view(np.int64)
        return of, h, x, [joined[a:p] + joined[q:b] for a, p, q, b in places], at - begin, at - first[of]

    def pieces(batches):
        """Of grams that aren't hot."""
        for batch in batches:
            v, at = np.array(batch.column(2).to_pylist(), dtype=np.int64), 0
            for ids, texts in rows_of(batch):
                of, h, x, piece, left, pos = occurrences(texts, False)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), pa.array(piece, pa.binary()), pa.array(left.astype(np.int32)), pa.array(np.array(ids, dtype=np.int64)[of]), pa.array(v[at + of]), pa.array(pos)], names=["h", "x", "piece", "left", "doc", "v", "pos"])
                at += len(ids)

    def hot_pieces(batches):
        """Of hot grams, with where they begin and end; a piece that the task has given from an earlier place is null."""
        least: dict[tuple[int, int, bytes, int], tuple[int, int, int]] = {}
        for batch in batches:
            v, at = np.array(batch.column(2).to_pylist(), dtype=np.int64), 0
            for ids, texts in rows_of(batch):
                of, h, x, piece, left, pos = occurrences(texts, True)
                doc, w = np.array(ids, dtype=np.int64)[of], v[at + of]
                size = np.array([len(y) for y in piece], dtype=np.int64)
                names, spots = list(zip(h.tolist(), x.tolist(), piece, left.tolist(), strict=True)), zip(doc.tolist(), w.tolist(), pos.tolist(), strict=True)
                for k, (name, spot) in enumerate(zip(names, spots, strict=True)):
                    if name in least and least[name] <= spot:
                        piece[k] = None
                    else:
                        least[name] = spot
                if len(least) > 100_000:  # what it forgets is given twice, and no more
                    least.clear()
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), pa.array(piece, pa.binary()), pa.array(left.astype(np.int32)), pa.array(doc), pa.array(w), pa.array(pos), pa.array(pos - left), pa.array(pos - left + size + GRAM)], names=["h", "x", "piece", "left", "doc", "v", "pos", "begin", "end"])
                at += len(ids)

    shape, spans = "h long, x long, piece binary, left int, doc long, v long, pos long", "doc long, v long, begin long, end long"

    def compare(batches):
        for whole in groups_of(batches, 2, 50_000):
            yield _compare(whole)

    found = base.mapInArrow(pieces, shape).repartition(n, "h", "x").sortWithinPartitions("h", "x").mapInArrow(compare, spans).withColumn("kind", F.lit(GONE))
    if not any_hot:
        return found

    # hot grams: different pieces with their first occurrence
    hot = cut(base.mapInArrow(hot_pieces, f"{shape}, begin long, end long"))
    distinct = hot.where("piece is not null").groupBy("h", "x", "piece", "left").agg(F.min(F.struct("doc", "v", "pos")).alias("first"))
    distinct = cut(distinct.select("h", "x", "piece", "left", "first.doc", "first.v", "first.pos"))
    counts = distinct.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n"))

    start = F.col("pos") - F.col("left")
    firsts = distinct.select("doc", "v", start.alias("begin"), (start + F.length("piece") + GRAM).alias("end"), F.lit(FIRST).alias("kind"))
    found = found.union(hot.select("doc", "v", "begin", "end", F.lit(HELD).alias("kind"))).union(firsts)
    few = distinct.join(counts.where(F.col("n").between(2, HOT)), ["h", "x"], "left_semi")
    found = found.union(few.select("h", "x", "piece", "left", "doc", "v", "pos").repartition(n, "h", "x").sortWithinPartitions("h", "x").mapInArrow(compare, spans).withColumn("kind", F.lit(GONE)))

    many = counts.where(F.col("n") > HOT)
    if many.limit(1).count():

        def strings(batches):
            for b in batches:
                for h, x, text, a, doc, v, pos in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    k = range(len(text) - REACH + 1)
                    yield pa.RecordBatch.from_arrays([pa.array([_name(h, x, text[y : y + REACH], a - y) for y in k], pa.binary()), pa.array([doc] * len(k), pa.int64()), pa.array([v] * len(k), pa.int64()), pa.array([pos - a + y for y in k], pa.int64())], names=["name", "doc", "v", "begin"])

        each = distinct.join(many, ["h", "x"], "left_semi").select("h", "x", "piece", "left", "doc", "v", "pos").mapInArrow(strings, "name binary, doc long, v long, begin long")
        least = each.groupBy("name").agg(F.min(F.struct("doc", "v", "begin")).alias("first"))
        found = found.union(each.join(least, "name").where(F.struct("doc", "v", "begin") > F.col("first")).select("doc", "v", "begin", (F.col("begin") + LENGTH).alias("end"), F.lit(GONE).alias("kind")))
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary: the remaining bytes).

    A byte goes if a 100-byte string that covers it also begins earlier: in a row of smaller id, or earlier in the same text. A null
    text is empty. Rows with a null id come after all others; rows of one id are ordered by a hash of their texts, and
    equal rows count as one, so neither loses what the other holds.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), text.cast("binary").alias("text"), F.xxhash64(text).alias("v"), F.xxhash64(F.lit(1), text).alias("w"))
    # texts that several documents have, by 128 bits of hash, and the first of these
    copied = every.where(F.length("text") >= LENGTH).groupBy("v", "w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("v", "w", "first")
    copied = sized(cut(copied))
    every = every.join(copied, ["v", "w"], "left").select("id", "doc", "v", F.length("text").cast("long").alias("size"), (F.coalesce("first", "doc") < F.col("doc")).alias("again"), "text")
    long = every.where(~F.col("again") & (F.col("size") >= LENGTH)).select("doc", "text", "v")
    spans = repeated_spans(long).groupBy("doc", "v").agg(F.collect_set(F.struct("begin", "end", "kind")).alias("spans"))

    def work(batches):
        for batch in batches:
            out = {"n_removed": [], "n_spans": [], "kept": []}
            for t, size, again, found in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
                keep, gone, at = [], size if again else 0, 0
                merged = _merge(found) if found and not again else []
                for a, b in merged:
                    keep.append(t[at:a])
                    gone += b - a
                    at = b
                keep.append(t[at:])
                out["n_removed"].append(gone)
                out["n_spans"].append(len(merged) + again)
                out["kept"].append(b"".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    left = every.withColumn("text", F.when(F.col("again"), F.lit(b"")).otherwise(F.col("text")))
    done = left.join(spans, ["doc", "v"], "left").select("id", "text", "size", "again", "spans").mapInArrow(work, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", id_col)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`remove_repeats` of all documents, with the digest of what is kept."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
