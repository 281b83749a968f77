"""Quality classifier: importance resampling with hashed n-gram models.

A document's log importance weight is log p(text | target) - log p(text | raw): generative models of hashed n-grams of the target
(labelled good and not toxic) and of the raw text. Raw text is a mixture of whole documents, not of single words: its model is the sum, by
their shares, of the target's own model, those of the labelled kinds that are no target (junk, toxic), and one fitted on all documents.
Two models differ only in grams whose counts part them surely (G-test) and far (the ratio); all others weigh the same in both, so that what
many rare words of a long text say by chance doesn't add up. Grams: words, their first four and five bytes, pairs of words, and a
word said three times running. Labelled copies of one text count once where labelled kinds are compared.

Documents are then drawn without replacement by Gumbel top-k: the k largest of log weight plus Gumbel noise of scale one. k is fixed
before any weight is known: the share of the target among the labels, times the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import ODD, as_bytes, cut, pieces, powers, rows_of, table
from lamina.llm.simhash import SPACE

#: Documented bound of the labelled sample that the models are fitted on, in documents.
SAMPLE = 24_000
#: Buckets of words and of word pairs (target against raw text), and of the grams that part labelled kinds.
WORDS, PAIRS, KINDS = 1 << 17, 1 << 17, 1 << 20
#: Bytes of the beginnings of words that are grams of their own.
BEGINNINGS = (4, 5)
#: Log ratio and G statistic that a gram must reach to count.
FAR, SURE = 2.5, 12.0
#: Share of raw text that is taken to be of no labelled kind.
OTHER = 0.01
#: Bytes of text that are worked on at once.
PIECE = 1 << 18
LOWEST = -1e9
TARGET, JUNK, TOXIC = 0, 1, 2

_K = np.uint64(0xC2B2AE3D27D4EB4F)
_AGAIN = np.uint64(0x123456789ABCDEF1)


@dataclass
class Grams:
    """Of the joined texts: hashes of words and the text of each; of pairs (pair i is of words i and i + 1, 0 across texts); and of all grams that part kinds."""

    word: np.ndarray
    of: np.ndarray
    pair: np.ndarray
    every: np.ndarray
    every_of: np.ndarray


def grams(texts: list[bytes]) -> Grams:
    """A-Z lower-cased; words are parted by ASCII white space."""
    joined = b"\n".join(t.lower() for t in texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    up, down = powers(1 << len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw * up[: len(raw)], out=sums[1:])
    edge = np.diff(np.concatenate(([1], SPACE[raw].view(np.int8))))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)

    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (sums[b] - sums[a]) * down[a]
        return (h ^ (h >> np.uint64(32))) * _K

    h = mixed(begin, end)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    of = np.searchsorted(first, begin, "right") - 1
    pair = np.zeros_like(h)
    if len(h) > 1:
        x = (h[:-1] * ODD + h[1:]) * _K
        pair[:-1] = np.where(of[1:] == of[:-1], x | np.uint64(1), 0)
    every, every_of = [h], [of]
    for n in BEGINNINGS:
        long = end - begin > n
        every.append(mixed(begin[long], begin[long] + n) * ODD + np.uint64(n))
        every_of.append(of[long])
    thrice = np.flatnonzero((h[2:] == h[:-2]) & (h[1:-1] == h[:-2]) & (of[2:] == of[:-2])) + 2
    every.append(np.repeat(_AGAIN, len(thrice)))
    every_of.append(of[thrice])
    return Grams(h, of, pair, np.concatenate(every), np.concatenate(every_of))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def _counts(word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Counts of words, then of pairs, by bucket."""
    return np.concatenate((np.bincount(_bucket(word, WORDS), minlength=WORDS), np.bincount(_bucket(pair[pair > 0], PAIRS), minlength=PAIRS)))


def signature(g: Grams, texts: int) -> np.ndarray:
    """For each text the least hash of five words running (of all its words if there are fewer): near copies mostly share it, other texts hardly ever."""
    least = np.full(texts, ~np.uint64(0))
    five, n = g.word.copy(), len(g.word)
    for k in range(1, 5):
        more = np.zeros_like(five)
        more[: max(0, n - k)] = np.where(g.of[k:] == g.of[: max(0, n - k)], g.word[k:], 0)
        five = (five ^ (five >> np.uint64(29))) * ODD + more
    whole = np.ones(n, dtype=bool)
    whole[max(0, n - 4) :] = False
    whole[: max(0, n - 4)] = g.of[4:] == g.of[: max(0, n - 4)]
    starts = np.concatenate(([True], g.of[1:] != g.of[:-1])) if n else whole
    whole |= starts & ~whole  # a text of fewer words: what begins with its first
    np.minimum.at(least, g.of[whole], (five[whole] ^ (five[whole] >> np.uint64(32))) * _K)
    return least


def evidence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of how much likelier each gram is under the model of counts ``b`` than under that of ``a``; 0 where counts don't tell surely."""
    na, nb = a.sum(), b.sum()
    if not na or not nb:
        return np.zeros(len(a))
    mean = (a + b) / (na + nb)
    part = lambda x, n: x * np.log(np.maximum(x, 1) / np.maximum(n * mean, 1e-300))
    less = min(na, nb)  # on the scale of the smaller side, for half a count to weigh as much on both
    ratio = np.log((b / nb * less + 0.5) / (a / na * less + 0.5))
    return np.where((2 * (part(a, na) + part(b, nb)) > SURE) & (np.abs(ratio) > FAR), ratio, 0)


@dataclass
class Model:
    """``raw``: evidence for the model of all documents against the target's, by bucket of words and pairs. ``kinds``: of each labelled kind that is no
    target its share, the buckets that part it from the target, and their evidence. ``share``: that of the target."""

    raw: np.ndarray
    share: float
    kinds: list[tuple[float, np.ndarray, np.ndarray]] = field(default_factory=list)

    @cached_property
    def _dense(self) -> list[tuple[float, np.ndarray]]:
        """Share and evidence by bucket, spread out where weights are taken, as what is sent is sparse."""
        out = []
        for share, known, value in self.kinds:
            if share and len(known):
                out.append((share, np.zeros(KINDS, dtype=np.float32)))
                out[-1][1][known] = value
        return out

    def weights(self, texts: list[bytes]) -> np.ndarray:
        """Log importance weights; LOWEST for a text without words."""
        g, n = grams(texts), len(texts)
        total = np.full(n, np.log(self.share * (1 - OTHER)))
        each = self.raw[_bucket(g.word, WORDS)] + np.where(g.pair > 0, self.raw[WORDS + _bucket(g.pair, PAIRS)], 0)
        total = np.logaddexp(total, np.log(OTHER) + np.bincount(g.of, weights=each, minlength=n))
        bucket = _bucket(g.every, KINDS)
        for share, value in self._dense:
            total = np.logaddexp(total, np.log(share * (1 - OTHER)) + np.bincount(g.every_of, weights=value[bucket], minlength=n))
        return np.where(np.bincount(g.of, minlength=n) > 0, -total, LOWEST)


def _slices(rows: pa.RecordBatch, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows in batches that the JVM need not hold at once."""
    for k in range(0, max(1, rows.num_rows), most):
        yield rows.slice(k, most)


def _sums(counts: DataFrame, *columns: str) -> DataFrame:
    """Sums by ``k``; partial sums of each task meet in a shuffle. In pieces so small that the driver gets each directly."""
    return counts.groupBy("k").agg(*[F.sum(c).alias(c) for c in columns]).repartition(32, "k")


def _dense(counts: DataFrame, column: str, n: int) -> np.ndarray:
    """A column of counts by ``k``, of at most ``n`` rows whatever the input, as an array."""
    got = counts.select("k", column).toPandas()
    out = np.zeros(n)
    out[got["k"].to_numpy(dtype=np.int64)] = got[column]
    return out


def raw_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Bucket counts of all documents."""

    def run(batches):
        total = np.zeros(WORDS + PAIRS, dtype=np.int64)
        for batch in batches:
            for _, texts in rows_of(batch, PIECE):
                g = grams(texts)
                total += _counts(g.word, g.pair)
        k = np.flatnonzero(total)
        yield from _slices(pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k], pa.int64())], names=["k", "n"]))

    return _dense(_sums(as_bytes(docs, id_col, text_col).mapInArrow(run, "k int, n long"), "n"), "n", WORDS + PAIRS)


def _kind_evidence(counts: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """:func:`evidence` for a kind against the target, computed where the counts are; only the buckets that count come to the driver."""
    na, nb = (float(x or 0) for x in counts.agg(F.sum("good"), F.sum(kind)).first())
    if not na or not nb:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    a, b = F.col("good").cast("double"), F.col(kind).cast("double")
    mean = (a + b) / (na + nb)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (n * mean))).otherwise(0.0)
    less = min(na, nb)
    ratio = F.log((b / nb * less + 0.5) / (a / na * less + 0.5))
    got = counts.select("k", (2 * (part(a, na) + part(b, nb))).alias("g"), ratio.alias("x")).where((F.col("g") > SURE) & (F.abs("x") > FAR)).select("k", "x").toPandas().sort_values("k")
    return got["k"].to_numpy(dtype=np.int64), got["x"].to_numpy(dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """The models; None if no document is labelled good. Labels: 1 or 0, a null quality is no label, a null toxic is 0.

    Labelled kinds are counted on the ``sample`` labelled documents of least hash, shares on all labels, raw text on every document.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__i")).agg(F.min(quality_col).alias("q"), F.max(F.coalesce(F.col(toxic_col), F.lit(0))).alias("x"))
    marks = marks.select("__i", F.when(F.col("x") > 0, TOXIC).when(F.col("q") > 0, TARGET).otherwise(JUNK).alias("kind"))
    shares = dict.fromkeys((TARGET, JUNK, TOXIC), 0) | {r.kind: r["count"] for r in marks.groupBy("kind").count().collect()}
    if not shares[TARGET]:
        return None
    labelled = sum(shares.values())
    drawn = marks.orderBy(F.xxhash64("__i", F.lit("quality")), "__i").limit(sample)
    rows = as_bytes(docs, id_col, text_col).join(F.broadcast(drawn), F.col("__id") == F.col("__i"))  # bounded by ``sample``

    def sign(batches):
        for batch in batches:
            kinds, at = batch.column(2).to_numpy(), 0
            for ids, texts in rows_of(batch, PIECE):
                s = signature(grams(texts), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds[at : at + len(ids)], pa.int32()), pa.array(s.view(np.int64))], names=["i", "kind", "s"])
                at += len(ids)

    firsts = rows.select("__id", "__text", "kind").mapInArrow(sign, "i long, kind int, s long").groupBy("kind", "s").agg(F.min("i").alias("__f")).select("__f").distinct()
    every = rows.join(F.broadcast(firsts), F.col("__id") == F.col("__f"), "left").select((F.col("kind") * 2 + F.col("__f").isNotNull().cast("int")).alias("kind"), "__text")
    size = WORDS + PAIRS

    def count(batches):
        """By bucket: the target's words and pairs; then the grams of each kind's different texts."""
        target, kinds = np.zeros(size, dtype=np.int64), np.zeros((3, KINDS), dtype=np.int32)
        for batch in batches:
            for code, texts in rows_of(batch, PIECE):
                g, code = grams(texts), np.array(code)
                good = code[g.of] // 2 == TARGET
                target += _counts(g.word[good], g.pair[good])
                of = code[g.every_of]
                for k in range(3):
                    kinds[k] += np.bincount(_bucket(g.every[of == 2 * k + 1], KINDS), minlength=KINDS).astype(np.int32)
        a, b = np.flatnonzero(target), np.flatnonzero(kinds.any(axis=0))
        none = np.zeros(len(a), dtype=np.int64)
        yield from _slices(pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, b + size)), pa.int32()), pa.array(np.concatenate((target[a], kinds[TARGET][b]))), *(pa.array(np.concatenate((none, kinds[k][b]))) for k in (JUNK, TOXIC))], names=["k", "good", "junk", "toxic"]))

    counts = cut(_sums(every.mapInArrow(count, "k int, good long, junk long, toxic long"), "good", "junk", "toxic"))
    target = _dense(counts.where(F.col("k") < size), "good", size)
    if not target.any():
        return None
    raw = raw_counts(docs, id_col, text_col)
    against = np.concatenate([evidence(target[a:b], raw[a:b]) for a, b in ((0, WORDS), (WORDS, size))]).astype(np.float32)
    each = counts.where(F.col("k") >= size).select((F.col("k") - size).alias("k"), "good", "junk", "toxic")
    return Model(against, shares[TARGET] / labelled, [(shares[k] / labelled, *_kind_evidence(each, name)) for k, name in ((JUNK, "junk"), (TOXIC, "toxic"))])


def weigh(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, log_weight), a row per row of ``docs``; 0 for all without a model, LOWEST for a text without words."""

    def run(batches):
        for batch in batches:
            for ids, texts in rows_of(batch, PIECE):
                w = np.zeros(len(ids)) if model is None else model.weights(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(w, pa.float64())], names=["__id", "log_weight"])

    return as_bytes(docs, id_col, text_col).mapInArrow(run, "__id long, log_weight double").withColumnRenamed("__id", id_col)


def kth_largest(values: DataFrame, col: str, k: int) -> float:
    """The k-th largest of a double column, exactly, by histograms that narrow in on it: each round sends a row per bin to the driver."""
    low, high = values.agg(F.min(col), F.max(col)).first()
    while low < high:
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        bins = {r.b: (r.n, r.lo, r.hi) for r in values.where(F.col(col).between(low, high)).groupBy(F.floor((F.col(col) - low) / width).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            n, lo, hi = bins[b]
            if n >= k:
                low, high = lo, hi
                break
            k -= n
        if len(bins) == 1:
            break
    return low


def _gumbel(weight: Column, id_col: str, seed: int) -> Column:
    """The weight plus standard Gumbel noise that is a function of id and seed."""
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(u))


def _bar(keyed: DataFrame, model: Model | None, k: int | None) -> float:
    """What the Gumbel keys of the ``k`` kept reach at least."""
    n = keyed.count()
    if k is None:
        k = n if model is None else round(model.share * n)
    return float("inf") if k <= 0 else float("-inf") if k >= n else kth_largest(keyed, "gumbel", k)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 42, **columns) -> DataFrame:
    """Per row of ``docs``: the id, ``log_weight``, ``gumbel`` (weight plus noise) and ``kept``: whether it is among the ``k`` largest.

    ``k`` is by default the target's share of the labels times the number of rows (if no model could be fitted: all). The noise is
    a function of id and seed, so results repeat; rows tied with the k-th are kept. A text without words has the lowest weight.
    """
    model = fit(docs, labels, id_col, text_col, **columns)
    keyed = cut(weigh(docs, model, id_col, text_col).withColumn("gumbel", _gumbel(F.col("log_weight"), id_col, seed)))
    return keyed.withColumn("kept", F.col("gumbel") >= F.lit(_bar(keyed, model, k)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 42, **columns) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps, weighed where they are read, so that no text is shuffled."""
    model = fit(docs, labels, id_col, text_col, **columns)
    keyed = cut(weigh(docs, model, id_col, text_col).withColumn("gumbel", _gumbel(F.col("log_weight"), id_col, seed)))
    bar = _bar(keyed, model, k)

    @F.arrow_udf("double")  # texts stay in the Arrow batch: as Python objects there is one piece at a time
    def weight(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        if model is not None:
            for begin, end in pieces(texts, PIECE):
                out[begin:end] = model.weights(texts.slice(begin, end - begin).to_pylist())
        return pa.array(out)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.where(_gumbel(weight(text), id_col, seed) >= F.lit(bar))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`resample` of all documents toward those labelled good: doc_id, log_weight, gumbel, kept."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
