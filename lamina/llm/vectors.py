"""Embedding near-dedup: an exact metric range join.

Cosine c of two vectors is the distance sqrt(2 - 2c) of their unit vectors, so "cosine >= t" is a range join of
radius r = sqrt(2 - 2t). Per label and length, pivots are drawn from a bounded sample; a vector lives in the cell of
its nearest pivot and is replicated to another pivot's cell only if the triangle inequality allows a partner there:
a member x of cell i within r of q has d(q, p_i) <= d(x, p_i) + r <= d(x, p) + r <= d(q, p) + 2r, where p is q's own pivot;
and, sharper for unit vectors, q is within r of the plane between p and p_i: (d_i^2 - d^2) / (2 |p_i - p|) <= r.
Of two cells one alone sends to the other (:func:`_toward`), so a pair meets once. Cells join independently; those of over
``block`` rows are cut into chunks that send to each other likewise. A cell's own vectors stay in memory while what
was sent there passes by. Equal vectors are one, with the number of its ids.

In high dimensions few cells can be ruled out, and each further pivot then costs another copy of half the rows: the number of
pivots of a group is the one with the least estimated work on the sample, but two at least, and one for each ``part`` rows, as
cells are also what spreads a group over tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import ODD, Forest, bound_batches, bounds, components, cut, sized, slots, table

#: Rows and bytes of the sample that pivots are drawn from, pivots of all groups together, and groups that have any: the bounds on what is sent.
SAMPLE, SAMPLE_BYTES, PIVOTS, GROUPS = 16384, 16 << 20, 8192, 1024
#: Work of shuffling one replica, counted in comparisons of two vectors.
REPLICA = 1024
#: Bytes of a block's vectors, as doubles; numbers in a work array; rows and columns of a matrix of products.
BLOCK_BYTES, TILE, ROWS, COLUMNS = 32 << 20, 1 << 20, 512, 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _replicas(u: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and the Boolean matrix of the cells that may hold a partner, its home included."""
    d2 = np.maximum(2 - 2 * (u @ pivots.T), 0)
    home = d2.argmin(axis=1)
    own = d2[np.arange(len(u)), home]
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    eps = 1e-7
    sent = (np.sqrt(d2) <= np.sqrt(own)[:, None] + 2 * r + eps) & (d2 - own[:, None] <= 2 * apart * (r + eps) + eps)
    sent[np.arange(len(u)), home] = True
    return home, sent


def _toward(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether cell (or chunk) a is the one of the two that sends to b: about half of all, for each of them."""
    return (a != b) & (((a + b) % 2 == 1) == (a < b))


def _placed(u: np.ndarray, pivots: np.ndarray, r: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In pieces whose matrices are bounded: where a piece begins, its rows' homes, and the matrix of the cells that they are sent to."""
    step = max(1, TILE // len(pivots))
    for s in range(0, len(u), step):
        home, sent = _replicas(u[s : s + step], pivots, r)
        yield s, home, sent & _toward(home[:, None], np.arange(len(pivots)))


def _pivots(u: np.ndarray, n: int, r: float, least: int, most: int, block: int) -> np.ndarray:
    """Of the sample ``u`` of a group of ``n`` rows, at least ``least`` pivots, where there are as many, with the least estimated work. No two lie within 2r, so near copies share one.

    Work is estimated on rows that are no pivots, as a pivot has a cell of its own. More are tried until two doublings haven't helped.
    """
    chosen = [0]
    near = 2 - 2 * (u @ u[0])
    best, cost, worse, k = 1, float("inf"), 0, least
    while worse < 2:
        while len(chosen) < min(k, most) and near.max() > 4 * r * r:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, 2 - 2 * (u @ u[chosen[-1]]))
        now = min(k, len(chosen))
        others = np.delete(u, chosen[:now], axis=0)
        others = others if len(others) else u
        own, guests = np.zeros(now), np.zeros(now)
        for _, home, sent in _placed(others, u[chosen[:now]], r):
            own += np.bincount(home, minlength=now)
            guests += sent.sum(axis=0)
        own, guests = own * (n / len(others)), guests * (n / len(others))
        chunks = np.ceil(np.maximum(own, 1) / block)
        work = float((own * (own / 2 + guests)).sum() + REPLICA * (guests * chunks + own * (chunks - 1) / 2).sum())
        if work < cost:
            best, cost, worse = now, work, 0
        else:
            worse += 1
        if now < k or k >= most:
            break
        k = min(2 * k, most)
    return u[chosen[:best]]


def _rows_of_block(dim: int, block: int) -> int:
    """Rows of a block: ``block``, or as many as its bytes allow, but 256 at least."""
    return min(block, max(256, BLOCK_BYTES // (8 * dim)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, cell: int = 32, part: int = 32768, block: int = 32768) -> DataFrame:
    """One row per row of ``vectors``: the id, ``n_links`` (other vectors with equal label and cosine >= ``threshold``),
    ``component_id`` (smallest id reachable by links) and ``kept`` (id = component_id).

    A null label or id, a vector that is null, empty, all zero or holds a null or non-finite component links with nothing:
    n_links 0, component_id its own id (a null id: null, kept true). Vectors of unequal length aren't comparable. Exact
    repetitions of a row count as one vector; rows of one id with different vectors are as many vectors, each with its own
    links. Cosines are computed in double precision. Groups (of a label and a length) of over ``cell`` different vectors have pivots,
    one for each ``part`` vectors at least; cells of over ``block`` rows are cut.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    r = float(np.sqrt(2 - 2 * threshold))
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"  # floats stay floats where they are moved
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(F.col(vec_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind)).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine
    names = [F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")]  # 128 bits that name a vector in joins
    named = every.where(fine).select("id", "label", *names)
    again = cut(named.groupBy("id", "label", "a", "b").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0").groupBy("label", "a", "b").agg(F.sum("more").alias("more")))
    alike = every.where(fine).groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    alike = alike.select("label", F.size("v").alias("dim"), *names, "least", "n", "v").join(sized(again), ["label", "a", "b"], "left")
    good = cut(alike.select("label", "dim", "a", "b", "least", (F.col("n") - F.coalesce("more", F.lit(0))).alias("n"), "v").withColumn("id", F.monotonically_increasing_id()))

    # pivots: of the largest groups, from a sample that a hash draws; all bounded
    sizes = good.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).orderBy(F.desc("n"), "label", "dim").limit(GROUPS).collect()
    total = sum(x.n for x in sizes)
    pivots: dict[tuple[str, int], np.ndarray] = {}
    if total:
        most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * max(x.dim for x in sizes))))
        share = int(min(1.0, most / total) * (1 << 20)) or 1
        picked = good.join(F.broadcast(spark.createDataFrame([(x.label, x.dim) for x in sizes], "label string, dim int")), ["label", "dim"])
        picked = picked.where(F.pmod(F.xxhash64("a", F.lit(17)), F.lit(1 << 20)) < share).select("label", "dim", "a", "b", "v").limit(2 * most).toPandas()
        for key, rows in picked.groupby(["label", "dim"]):
            n = next(x.n for x in sizes if (x.label, x.dim) == key)
            least = max(2, -(-n // part))
            u = _unit(np.array(rows.sort_values(["a", "b"])["v"].tolist(), dtype=np.float64))
            pivots[key] = _pivots(u, n, r, least, max(least, min(PIVOTS * n // total, n // 2, len(u) // 2)), _rows_of_block(key[1], block))

    def placed(batch):
        """By group: rows of the batch, their homes, and the matrix of the cells that they are sent to."""
        members: dict[tuple[str, int], list[int]] = {}
        for k, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
            members.setdefault(key, []).append(k)
        for key, some in members.items():
            some, p = np.array(some), pivots.get(key)
            if p is None or len(p) == 1:
                yield key, some, np.zeros(len(some), dtype=np.int64), np.zeros((len(some), 1), dtype=bool)
                continue
            u = _unit(_matrix(batch.column("v").take(pa.array(some)), len(some)))
            for s, home, sent in _placed(u, p, r):
                yield key, some[s : s + len(home)], home, sent

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                found = Counter()
                for key, _, home, _ in placed(batch):
                    for c, n in zip(*np.unique(home, return_counts=True), strict=True):
                        found[(*key, int(c))] += int(n)
                label, dim, at = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(dim, pa.int32()), pa.array(at, pa.int32()), pa.array(list(found.values()), pa.int64())], names=["label", "dim", "cell", "n"])

    # cells to be cut; there are fewer than rows in a block's share of the table
    homes = good.select("label", "dim", "v").mapInArrow(count, "label string, dim int, cell int, n long").groupBy("label", "dim", "cell").agg(F.sum("n").alias("n"))
    limit = F.least(F.lit(block), F.greatest(F.lit(256), F.floor(F.lit(BLOCK_BYTES // 8) / F.col("dim"))))
    chunks = {(x.label, x.dim, x.cell): -(-x.n // _rows_of_block(x.dim, block)) for x in homes.where(F.col("n") > limit).collect()}

    def deal(batches):
        """Each row with its block (cell << 32 | chunk) and the other blocks that it is sent to."""
        for batch in batches:
            ids, held, size = batch.column("id").to_numpy().astype(np.uint64), [], 0
            for key, rows, home, sent in placed(batch):
                many = np.array([chunks.get((*key, c), 1) for c in range(sent.shape[1])], dtype=np.int64)
                own = ((ids[rows] * ODD >> np.uint64(40)) % many[home].astype(np.uint64)).astype(np.int64)
                here, to = np.nonzero(sent)
                row, block_of = [np.repeat(here, many[to])], [np.repeat(to << 32, many[to]) + _ranges(many[to])]
                if (cut_up := np.flatnonzero(many[home] > 1)).size:
                    wide = many[home[cut_up]]
                    k, at = _ranges(wide), np.repeat(cut_up, wide)
                    k, at = k[go := _toward(own[at], k)], at[go]
                    row.append(at)
                    block_of.append((home[at] << 32) + k)
                row, block_of = np.concatenate(row), np.concatenate(block_of)
                order = np.argsort(row, kind="stable")
                held.append((rows, (home << 32) + own, np.bincount(row, minlength=len(rows)), block_of[order]))
                size += len(row)
                if size > TILE:
                    yield _dealt(batch, held)
                    held, size = [], 0
            if held:
                yield _dealt(batch, held)

    keys = ["label", "dim", "cell", "guest"]
    dealt = good.select("label", "dim", "id", "n", "v").mapInArrow(deal, f"label string, dim int, id long, n long, at long, to array<long>, v array<{kind}>")
    dealt = dealt.select("label", "dim", F.explode(F.concat(F.array("at"), "to")).alias("cell"), "at", "id", "n", "v").select("label", "dim", "cell", (F.col("cell") != F.col("at")).alias("guest"), "id", "n", "v")

    def compare(batches):
        now, held = None, _Block(threshold)
        for batch in batches:
            marks = bounds(pa.Table.from_batches([batch]), len(keys))
            for a, b in zip(marks[:-1], marks[1:], strict=True):
                rows = batch.slice(a, b - a)
                *key, guest = (rows.column(k)[0].as_py() for k in range(len(keys)))
                if key != now:
                    yield from held.end()
                    now, held = key, _Block(threshold)
                x = _matrix(rows.column("v"), len(rows))
                if guest:
                    yield from held.meet(rows.column("id").to_numpy(), rows.column("n").to_numpy(), x)
                else:
                    held.add(rows.column("id").to_numpy(), rows.column("n").to_numpy(), x)
        yield from held.end()

    found = cut(dealt.repartition(slots(spark), *keys[:-1]).sortWithinPartitions(*keys).mapInArrow(compare, "id long, n_links long, root long"))
    links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    each = cut(good.select("id", "label", "a", "b", "least", "n").join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    first = cut(each.groupBy("component").agg(F.min("least").alias("first")))
    known = cut(each.join(first, "component").select("label", "a", "b", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first"))
    # written, so that a vector that many rows have is a key that the join can split
    rows = every.select("id", F.when(fine, F.col("label")).alias("label"), *names)
    out = rows.join(known, ["label", "a", "b"], "left")
    comp = F.coalesce("first", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``sizes``, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _dealt(batch: pa.RecordBatch, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    rows, at, sizes, to = (np.concatenate(x) for x in zip(*held, strict=True))
    out = batch.take(pa.array(rows))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(to, pa.int64()))
    return pa.RecordBatch.from_arrays([*(out.column(k) for k in ("label", "dim", "id", "n")), pa.array(at, pa.int64()), lists, out.column("v")], names=["label", "dim", "id", "n", "at", "to", "v"])


class _Block:
    """The vectors at home in one block; they are compared with each other, and with guests as these pass by.

    Yields id, links counted here, each for as many ids as the other vector has, and a root that every row linked here reaches.
    Products of unit vectors in single precision settle what is far from the threshold; the rest is computed in double precision.
    First come products in some directions alone: x.y is at most the product of the parts in these and of the lengths of the rest.
    Where that leaves many pairs, whole vectors are multiplied.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold, self.parts, self.ready, self.few, self.lots = threshold, [], False, 0, 0

    def add(self, ids: np.ndarray, many: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((ids.copy(), many.copy(), x.copy()))

    def _settle(self) -> None:
        """When all are at home: they meet each other."""
        if self.ready or not self.parts:
            return
        self.ids, self.many, self.x = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts, self.ready = [], True
        dim = self.x.shape[1]
        self.eps = (dim + 16) * 2.0**-23  # over the error of a sum of so many products in single precision, and of its factors
        k = math.ceil((1.6 + math.sqrt(2.56 + (1 - self.threshold) * dim)) ** 2)  # so many that vectors at random are ruled out
        self.turn = _directions(dim, k) if 2 * k < dim else None
        self.u, self.low = self._single(self.x)
        self.links, self.forest = np.zeros(len(self.ids), dtype=np.int64), Forest(len(self.ids))
        for s in range(0, len(self.ids), ROWS):
            for q, b in self._close(self.x[s : s + ROWS], self.u[s : s + ROWS], self.low[s : s + ROWS], s):
                later = b > q + s
                q, b = q[later] + s, b[later]
                np.add.at(self.links, q, self.many[b])
                np.add.at(self.links, b, self.many[q])
                self.forest.join(q, b)

    def _single(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and their parts in some directions with the length of the rest, if that is shorter."""
        out, step = np.empty(x.shape, dtype=np.float32), max(1, TILE // x.shape[1])
        low = out if self.turn is None else np.empty((len(x), self.turn.shape[1] + 1), dtype=np.float32)
        for s in range(0, len(x), step):
            u = _unit(x[s : s + step].astype(np.float64))
            out[s : s + step] = u
            if self.turn is not None:
                part = u @ self.turn
                low[s : s + step, :-1] = part
                low[s : s + step, -1] = np.sqrt(np.maximum(1 - (part * part).sum(axis=1), 0))
        return out, low

    def _close(self, x: np.ndarray, u: np.ndarray, low: np.ndarray, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of linked pairs of ``x`` (with unit vectors ``u`` and their parts ``low``) and of the block from ``begin`` on."""
        for s in range(begin, len(self.u), COLUMNS):
            mine, least, at = self.u[s : s + COLUMNS], self.threshold - self.eps, None
            if self.turn is not None and self.lots <= 16 + self.few:
                at = _where((low @ self.low[s : s + COLUMNS].T).ravel() >= least)
                if at.size > min(len(u) * len(mine) // 64, 4 * TILE // u.shape[1]):
                    self.lots, at = self.lots + 1, None
                else:
                    self.few += 1
                    near = np.einsum("ij,ij->i", u[at // len(mine)], mine[at % len(mine)])
                    at, near = at[near >= least], near[near >= least]
            if at is None:
                near = (u @ mine.T).ravel()
                at = _where(near >= least)
                near = near[at]
            if not at.size:
                continue
            q, b = np.divmod(at, len(mine))
            b += s
            sure = near >= self.threshold + self.eps
            unsure, piece = np.flatnonzero(~sure), max(1, TILE // x.shape[1])
            for t in range(0, len(unsure), piece):
                p = unsure[t : t + piece]
                sure[p] = _cosines(x[q[p]], self.x[b[p]]) >= self.threshold
            yield q[sure], b[sure]

    def meet(self, ids: np.ndarray, many: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._settle()
        if not self.ready:
            return
        u, low = self._single(x)
        links, first = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), -1, dtype=np.int64)
        for s in range(0, len(ids), ROWS):
            for q, b in self._close(x[s : s + ROWS], u[s : s + ROWS], low[s : s + ROWS], 0):
                q = q + s
                np.add.at(links, q, self.many[b])
                np.add.at(self.links, b, many[q])
                new = np.flatnonzero(first[q] < 0)[::-1]
                first[q[new]] = b[new]
                self.forest.join(first[q], b)
        some = first >= 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(self.ids[first[some]])], names=["id", "n_links", "root"])

    def end(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        if self.ready:
            some = self.links > 0
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.links[some]), pa.array(self.ids[self.forest.all()][some])], names=["id", "n_links", "root"])


def _where(mask: np.ndarray) -> np.ndarray:
    """Positions of a mask that is mostly false, looked at in words of eight."""
    whole = len(mask) // 8 * 8
    words = np.flatnonzero(mask[:whole].view(np.uint64) != 0)
    word, k = np.nonzero(mask[:whole].reshape(-1, 8)[words])
    return np.concatenate((words[word] * 8 + k, np.flatnonzero(mask[whole:]) + whole))


@lru_cache(4)
def _directions(dim: int, k: int) -> np.ndarray:
    """k orthonormal directions at random."""
    return np.linalg.qr(np.random.default_rng(7).normal(size=(dim, k)))[0]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, one by one, in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_vectors` of all embeddings at a cosine of 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
