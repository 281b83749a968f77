"""SimHash near-dedup: fingerprints of word shingles, linked when few bits differ.

Candidates meet in buckets. For few bits of 64 these are exact, by pigeonhole: the bits are cut into ``blocks`` parts, and fingerprints
at ``radius`` or fewer differing bits agree on some ``blocks - radius`` of them, which make the key of a bucket. For a similarity
of shingle sets, fingerprints have 256 bits, and buckets are bands of min-hashes, which near copies share and other texts do not, so that buckets
don't grow with the corpus. Within a bucket, bit planes are stored vertically (plane b holds bit b of 64 fingerprints a
word); for many queries at once the planes are XORed with the query's bit and counted by carry-save adders of bit planes that
begin so far from full that they overflow where the radius is passed; blocks of 64 fingerprints are abandoned as soon as all have overflowed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import Forest, as_bytes, bounds, components, cut, grid, groups_of, map_texts, slots, table

#: Bytes that part words: space and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_joined(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text, A-Z lower-cased and joined by single spaces, and where each begins and ends."""
    joined = b" ".join(text.lower().split())  # bytes.split() parts at exactly the bytes of SPACE, bytes.lower() changes A-Z alone
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    if not joined:
        return joined, gaps, gaps
    return joined, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set if set in over half the hashes of the text's shingles of ``width`` words; 0 without words."""
    joined, begin, end = words_joined(text)
    if not joined:
        return 0
    if len(begin) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    digest = xxhash.xxh64_digest
    # digests are big-endian, so unpacked bits run from the highest to the lowest
    h = b"".join([digest(joined[a:b], seed) for a, b in zip(begin[: 1 - width].tolist(), end[width - 1 :].tolist(), strict=True)])
    n, ones, raw = len(h) // 8, np.zeros(64, dtype=np.int64), np.frombuffer(h, dtype=np.uint8).reshape(-1, 8)
    for s in range(0, n, 4096):
        ones += np.unpackbits(raw[s : s + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp as a signed long, one row per row of ``docs``."""

    def work(ids, texts):
        fps = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64)
        return {"id": ids, "fp": fps.view(np.int64)}

    return map_texts(as_bytes(docs, id_col, text_col), work, "id long, fp long")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder of three planes: sum and carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near_pairs(fps: np.ndarray, radius: int, first: np.ndarray | None = None, chunk: int = 256):
    """Arrays (i, j) of positions in ``fps`` with ``radius`` or fewer differing bits, i != j.

    ``fps``: a uint64 array, or the bytes of wider fingerprints as rows of a uint8 matrix, a multiple of 8 bytes each.
    ``first``: the positions to take as i (all of them if None).
    """
    m = len(fps)
    rows = fps.astype(">u8").view(np.uint8).reshape(m, 8) if fps.dtype == np.uint64 else fps
    size = 8 * rows.shape[1]
    width = -(-m // 64)
    bits = np.zeros((size, width * 64), dtype=np.uint8)
    bits[:, :m] = np.unpackbits(rows, axis=1).T
    spread = bits[:, :m].sum(axis=1, dtype=np.int64)
    bits = bits[np.argsort(np.abs(2 * spread - m), kind="stable")]  # the planes that tell most apart come first
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    full = ~np.uint64(0)
    beyond = np.zeros(width, dtype=np.uint64)
    if m % 64:
        beyond[-1] = full << np.uint64(m % 64)
    levels = radius.bit_length()  # planes of the counter, which begins at what it lacks of overflowing just beyond the radius
    lacks = (1 << levels) - 1 - radius
    step = 8 if levels > 3 else 1
    stops = {x // step * step for x in (2 * radius + 6, 3 * radius + 9, 4 * radius + 12, size // 2, size * 11 // 16) if step <= x < size}
    asked = np.arange(m) if first is None else first
    for s in range(0, len(asked), chunk):
        q = asked[s : s + chunk]
        flip = np.where(bits[:, q] > 0, full, np.uint64(0))
        count = [np.full((len(q), width), full if lacks >> k & 1 else 0, dtype=np.uint64) for k in range(levels)]
        over = np.broadcast_to(beyond, (len(q), width)).copy()
        over[np.arange(len(q)), q // 64] |= np.uint64(1) << (q % 64).astype(np.uint64)
        row = col = None
        for p in range(0, size, step):
            if p in stops:
                live = over != full
                row, col = np.nonzero(live) if row is None else (row[live], col[live])
                over, count = over[live], [c[live] for c in count]
                if not len(row):
                    break
            d = [planes[x] ^ flip[x][:, None] if row is None else planes[x][col] ^ flip[x][row] for x in range(p, p + step)]
            level, more = 0, d[0]
            if step == 8:  # eight planes at once leave one of weight eight
                count[0], a = _add(count[0], d[0], d[1])
                count[0], b = _add(count[0], d[2], d[3])
                count[1], e = _add(count[1], a, b)
                count[0], a = _add(count[0], d[4], d[5])
                count[0], b = _add(count[0], d[6], d[7])
                count[1], f = _add(count[1], a, b)
                count[2], more = _add(count[2], e, f)
                level = 3
            for k in range(level, levels):
                more, count[k] = count[k] & more, count[k] ^ more
            over |= more
        if row is None:
            row, col = np.nonzero(over != full)
            over = over[row, col]
        if len(row):
            hit = np.unpackbits((~over).view(np.uint8).reshape(len(row), 8), axis=1, bitorder="little")
            at, bit = np.nonzero(hit)
            yield q[row[at]], col[at] * 64 + bit


def near_edges(keyed: DataFrame, radius: int, block: int) -> DataFrame:
    """Pairs (a, b) of ids that span, within each bucket (t, key) of rows (t, key, id, fp), what is linked at ``radius`` or fewer bits."""
    keys = ["t", "key", "__i", "__j"]
    dealt = grid(keyed, ["t", "key"], "id", block).select(*keys, "id", "fp")

    def compare(batches):
        for whole in groups_of(batches, len(keys), 1024):
            marks = bounds(whole, len(keys))
            several = np.diff(marks) > 1
            whole = whole.filter(pa.array(np.repeat(several, np.diff(marks))))
            marks = np.concatenate(([0], np.cumsum(np.diff(marks)[several])))
            begin = 0
            while begin < len(marks) - 1:  # whole buckets up to 1024 rows, or one larger bucket
                end = max(begin + 1, int(np.searchsorted(marks, marks[begin] + 1024, "right")) - 1)
                part = whole.slice(marks[begin], marks[end] - marks[begin])
                begin = end
                ids, column = part.column("id").to_numpy(), part.column("fp")
                wide = pa.types.is_binary(column.type)  # each with an id of its own; of 64 bits, several may share one
                fp = np.zeros(len(ids), dtype=np.int64) if wide else column.to_numpy()
                at = np.lexsort((fp, ids))  # what is in several of these buckets counts once
                at = at[np.concatenate(([True], (np.diff(ids[at]) != 0) | (np.diff(fp[at]) != 0)))]
                if len(at) < 2:
                    continue
                ids = ids[at]
                values = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(ids), -1) if wide else fp[at].view(np.uint64)
                forest = Forest(len(ids))
                for i, j in near_pairs(values, radius):
                    forest.join(i, j)
                root = ids[forest.all()]
                some = root != ids
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(root[some])], names=["a", "b"])

    return dealt.repartition(slots(keyed.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def near_components(fps: DataFrame, radius: int = 3, blocks: int | None = None, block: int = 16384) -> DataFrame:
    """(fp, component): of the distinct long ``fp`` with their smallest ``id``, the smallest id reachable by links at ``radius`` (3 at most) or fewer bits."""
    if not 0 <= radius <= 3:
        raise ValueError("blocks of 64 bits are exact for a radius of 0 to 3")
    reps = cut(fps.groupBy("fp").agg(F.min("id").alias("id")).where("id is not null"))
    if blocks is None:  # more blocks: more copies of each row, but longer keys
        n = reps.count()
        cost = lambda b: len(list(combinations(range(b), radius))) * n * (20 + n / 2.0 ** (64 * (b - radius) // b))
        blocks = min(range(radius + 1, radius + 4), key=cost)
    edge = [64 * k // blocks for k in range(blocks + 1)]
    ways = list(combinations(range(blocks), blocks - radius))
    masks = [sum((1 << edge[k + 1]) - (1 << edge[k]) for k in way) for way in ways]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    keyed = reps.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for t, x in enumerate(signed)])).alias("b"), "id", "fp").select("b.t", "b.key", "id", "fp")
    parts = components(near_edges(keyed, radius, block))
    # written, so that the table is a plain side of a join, of which a fingerprint that many rows have can be split
    return cut(reps.join(parts.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component")))


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable by links).

    A null or wordless text has fingerprint zero, which links like any other. A row with a null id starts no component
    but gets that of its fingerprint, null if no row with an id has a fingerprint equal to it.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    out = fps.join(near_components(fps, radius), "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Words of a shingle, bits of a wide fingerprint, and bands of min-hashes: a pair of Jaccard similarity 0.8 shares one of 8 bands of 4 with
#: probability 0.985, one of 0.3 with 0.06.
WIDTH, BITS, BANDS, ROWS = 5, 256, 8, 4
_ODDS = ((np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
#: For a byte, its bits as the bytes of a word, the highest first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def radius_of(similarity: float, bits: int = BITS) -> int:
    """Differing bits up to which two shingle sets count as of a Jaccard similarity of ``similarity`` or more: those expected, and one and a half standard
    deviations more, so that chance loses few pairs."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + 1.5 * np.sqrt(bits * p * (1 - p)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def wide_fingerprint(text: bytes, width: int = WIDTH, seed: int = 42) -> tuple[bytes, list[int]]:
    """256 bits, each set if set in over half the hashes of the text's shingles, and the keys of its bands; zeros without words."""
    joined, begin, end = words_joined(text)
    if not joined:
        return bytes(BITS // 8), [0] * BANDS
    last = max(1, len(begin) - width + 1)
    ends = end[width - 1 :] if len(begin) >= width else end[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(begin[:last].tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
    ones, least = np.zeros(BITS, dtype=np.int64), np.full(BANDS * ROWS, ~np.uint64(0))
    for s in range(0, last, 4096):
        x = h[s : s + 4096]
        raw = np.stack([_mixed(x, k) for k in range(BITS // 64)], axis=1).view(np.uint8)
        sums = np.add.reduceat(_LANES[raw], np.arange(0, len(x), 255), axis=0)  # a byte holds 255 at most
        ones += sums.view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (x[:, None] * _ODDS).min(axis=0))
    keys = least.reshape(BANDS, ROWS)
    key = np.zeros(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key ^ keys[:, k], k)
    return np.packbits(2 * ones > last).tobytes(), key.view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, hash, fp, bands), one row per row of ``docs``: Spark's xxhash64 of the text (null: empty), the wide fingerprint and the keys of its bands."""

    def work(ids, texts):
        fps, bands = zip(*(wide_fingerprint(t, width) for t in texts), strict=True)
        return {"id": ids, "hash": np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], dtype=np.uint64).view(np.int64), "fp": list(fps), "bands": list(bands)}

    return map_texts(as_bytes(docs, id_col, text_col), work, "id long, hash long, fp binary, bands array<long>")


def near_groups(rows: DataFrame, similarity: float = 0.8, block: int = 16384) -> DataFrame:
    """(id, hash, n) of the one row of each group of near copies that is to stay, and how often it is given; of rows of :func:`signatures`.

    Groups are what links reach. The row of least id and, within it, of least hash stands for a group. Fingerprints are reduced to
    different ones before they are compared, with sums that meet before the shuffle, so copies cost no comparisons.
    """
    each = rows.groupBy("fp", "id", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("bands").alias("bands"))
    reps = cut(each.groupBy("fp").agg(F.min(F.struct("id", "hash", "n")).alias("best"), F.min("bands").alias("bands")).withColumn("no", F.monotonically_increasing_id()))
    keyed = reps.select(F.posexplode("bands").alias("t", "key"), F.col("no").alias("id"), "fp")
    parts = components(near_edges(keyed, radius_of(similarity), block))
    named = reps.select("no", "best").join(parts.withColumnRenamed("node", "no"), "no", "left")
    return cut(named.groupBy(F.coalesce("component", "no").alias("c")).agg(F.min("best").alias("best")).select("best.*"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies, of the smallest id. Rows with a null id stay.

    Two texts are linked if their fingerprints differ in no more bits than texts with ``similarity`` (Jaccard, of shingles of ``width``
    words) do, and share a band. Rows are told apart by id and text: of an id that repeats, only the rows in a group with another row
    go. Where several rows of a group have its smallest id, one text of theirs (that of the least hash) stays, in one row.
    """
    stays = near_groups(signatures(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width), similarity)
    row = (F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))

    def those(n: Column) -> DataFrame:
        kept = stays.where(n).select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
        return docs.join(kept, (row[0] == F.col("__id")) & (row[1] == F.col("__hash")), "left_semi")

    out = those(F.col("n") == 1).union(docs.where(F.col(id_col).isNull()))
    if stays.where("n > 1").isEmpty():
        return out
    again = those(F.col("n") > 1).withColumns({"__id": row[0], "__hash": row[1]})
    return out.union(again.dropDuplicates(["__id", "__hash"]).select(*docs.columns))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_documents` of all documents: shingles of three words, links at three bits or fewer."""
    return near_documents(table(spark, sf_dir, "documents"))
