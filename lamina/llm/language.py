"""Language ID: scripts narrow the candidates of each word, then Viterbi over per-word scores labels spans of one language.

A word (a run of letters) scores, in each language, the sum of log probabilities of its hashed character trigrams. Only
languages in whose training text the word's script has a share may take it. Changing the language from one word to
the next costs ``penalty``, so that short borrowings don't break a span. A text's language is the one with most letters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import as_bytes, map_texts, rows_of, table

#: Documented bounds of training: characters of text counted for each language, rows of it that are counted in any case, and buckets of trigrams.
SAMPLE_CHARS, SAMPLE_ROWS, BUCKETS = 4_000_000, 20, 1 << 16
#: Share of a language's letters that a script needs to be one of its scripts.
SCRIPT_SHARE = 0.005


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """By code point: the script (0: no letter) and the lower-case form; the scripts' names. A script is the first word of a letter's name."""
    script, low, names = np.zeros(0x110000, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32), {"": 0}
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            name = unicodedata.name(c, "UNNAMED").split()[0].split("-")[0]
            script[k] = names.setdefault(name, len(names)) if len(names) < 255 else names.setdefault("OTHER", 255)
            if len(c.lower()) == 1:
                low[k] = ord(c.lower())
    return script, low, list(names)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a list of texts: trigram buckets of all letters, where each word begins among them, its text, its script, and its begin and end in code points of its text."""
    script, low, _ = letters()
    whole = [t.decode("utf-8", "replace") for t in texts]
    sizes = np.array([len(t) + 1 for t in whole])
    first = np.concatenate(([0], np.cumsum(sizes)))
    points = np.frombuffer(("\n".join(whole) + "\n").encode("utf-32-le", "replace"), dtype="<u4")
    kind = script[points]
    alpha = kind > 0
    edge = np.diff(np.concatenate(([0], alpha.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p = np.where(alpha, low[points], 0).astype(np.uint64)
    before, after = np.concatenate(([0], p[:-1])).astype(np.uint64), np.concatenate((p[1:], [0])).astype(np.uint64)
    h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (p * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 16)
    at = np.concatenate(([0], np.cumsum(end - begin)))[:-1]
    of = np.searchsorted(first, begin, "right") - 1
    return h[alpha].astype(np.int64), at, of, kind[begin], begin - first[of], end - first[of]


class Model:
    """Log probabilities of trigrams by language, and the languages that each script allows."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray) -> None:
        """``grams``: counts by bucket and language; ``scripts``: letters by script and language."""
        self.langs = langs
        self.logp = np.empty(grams.shape, dtype=np.float32)
        for c in range(0, len(langs), 64):  # a few languages at a time, as their number isn't bounded
            x = grams[:, c : c + 64] + 0.1
            self.logp[:, c : c + 64] = np.log(x / x.sum(axis=0))
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        bars = np.where(share >= SCRIPT_SHARE, 0.0, -1e6)
        bars[~(bars == 0).any(axis=1)] = 0  # a script of no language bars none
        self.bars = bars.astype(np.float32)

    def scores(self, grams: np.ndarray, at: np.ndarray, kind: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """Of each word in each language, from about ``most`` letters by languages at a time."""
        out = self.bars[kind]
        step = max(1, most // max(1, len(self.langs)))
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + step)))
            last = at[end] if end < len(at) else len(grams)
            out[begin:end] += np.add.reduceat(self.logp[grams[at[begin] : last]], at[begin:end] - at[begin], axis=0)
            begin = end
        return out

    def labels(self, scores: np.ndarray, of: np.ndarray, n: int, penalty: float) -> np.ndarray:
        """The language of each word: the best path of each of ``n`` texts. Texts run side by side, the longest first."""
        count = np.bincount(of, minlength=n)
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        out = np.zeros(len(scores), dtype=np.int64)
        if not len(scores):
            return out
        live = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")  # texts with a word number p
        v = scores[first[: live[0]]].copy()
        stay, best = np.zeros(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int16)
        for p in range(1, count[0]):
            k = live[p]
            x = v[:k]
            top = x.max(axis=1) - penalty
            at = first[:k] + p
            best[at] = x.argmax(axis=1)
            stay[at] = x >= top[:, None]
            v[:k] = np.maximum(x, top[:, None]) + scores[at]
        tag = v.argmax(axis=1)
        for p in range(count[0] - 1, -1, -1):
            k = live[p]
            at = first[:k] + p
            out[at] = tag[:k]
            if p:
                tag[:k] = np.where(stay[at, tag[:k]], tag[:k], best[at])
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of the rows of ``docs`` with a non-null text and language, of every language there is; empty if there are none.

    Counts come from a sample that a hash of the id draws, of about SAMPLE_CHARS characters for each language (all rows of
    a language with fewer, and SAMPLE_ROWS rows at least), so the work doesn't grow with the corpus; the result has BUCKETS rows a language.
    """
    good = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    sizes = good.groupBy("l").agg(F.sum(F.length("t")).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    langs = sorted(x.l for x in sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((256, 0)))
    part = {x.l: min(1 << 30, int((1 << 30) * SAMPLE_CHARS / max(1, x.n))) for x in sizes}
    lang = {x: k for k, x in enumerate(langs)}
    good = good.withColumn("h", F.pmod(F.xxhash64("i", F.lit("language")), F.lit(1 << 30)))
    # of languages that might draw too few rows, those of the least hashes are drawn in any case
    few = [x.l for x in sizes if part[x.l] < 1 << 30 and x.rows * part[x.l] < 10 * SAMPLE_ROWS << 30]
    if few:
        ranked = good.where(F.col("l").isin(few)).select("l", "h", F.row_number().over(Window.partitionBy("l").orderBy("h")).alias("rank"))
        for x in ranked.where(F.col("rank") <= SAMPLE_ROWS).groupBy("l").agg(F.max("h").alias("h")).collect():
            part[x.l] = max(part[x.l], x.h + 1)
    share = F.broadcast(docs.sparkSession.createDataFrame(list(part.items()), "l string, share long"))
    picked = good.join(share, "l").where("h < share").select("l", F.col("t").cast("binary"))

    def rows(got: dict[int, tuple[np.ndarray, np.ndarray]]):
        for c, (g, s) in got.items():
            x = np.concatenate((g, s))
            k = np.flatnonzero(x)
            yield pd.DataFrame({"c": c, "k": k, "n": x[k]})

    def count(batches):
        got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for names, texts in rows_of(batch):
                grams, at, of, kind, begin, end = words_of(texts)
                code = np.array([lang[x] for x in names])
                by_gram, by_word = np.repeat(code[of], end - begin), code[of]
                for c in np.unique(code):
                    g, s = got.setdefault(int(c), (np.zeros(BUCKETS, np.int64), np.zeros(256, np.int64)))
                    g += np.bincount(grams[by_gram == c], minlength=BUCKETS)
                    s += np.bincount(kind[by_word == c], weights=(end - begin)[by_word == c], minlength=256).astype(np.int64)
                if len(got) > 64:
                    yield from rows(got)
                    got = {}
        yield from rows(got)

    def run(batches):
        import pyarrow as pa

        for f in count(batches):
            yield pa.RecordBatch.from_pandas(f.astype("int64"), preserve_index=False)

    counts = picked.mapInArrow(run, "c long, k long, n long").groupBy("c", "k").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros((BUCKETS + 256, len(langs)))
    full[counts["k"], counts["c"]] = counts["n"]
    return Model(langs, full[:BUCKETS], full[BUCKETS:])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0) -> DataFrame:
    """Per row of ``docs``: the id, ``lang_pred``, ``score`` (share of the text's letters in that language) and ``spans``
    (``lang:start:end``, code points, comma-joined; from a span's first letter to its last).

    ``und`` with score 0 and no spans for a text that is null or has no letters, or if the model knows no language. Ties go to the
    first language by name.
    """

    def work(ids, texts):
        out = {"id": ids, "lang_pred": ["und"] * len(ids), "score": [0.0] * len(ids), "spans": [""] * len(ids)}
        if not model.langs:
            return out
        grams, at, of, kind, begin, end = words_of(texts)
        if not len(at):
            return out
        tag = model.labels(model.scores(grams, at, kind), of, len(texts), penalty)
        size = np.bincount(of * len(model.langs) + tag, weights=end - begin, minlength=len(texts) * len(model.langs)).reshape(len(texts), -1)
        total, top = size.sum(axis=1), size.argmax(axis=1)
        new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (tag[1:] != tag[:-1]))))
        last = np.append(new[1:], len(of)) - 1
        spans: dict[int, list[str]] = {}
        for d, t, a, b in zip(of[new].tolist(), tag[new].tolist(), begin[new].tolist(), end[last].tolist(), strict=True):
            spans.setdefault(d, []).append(f"{model.langs[t]}:{a}:{b}")
        for d in np.flatnonzero(total).tolist():
            out["lang_pred"][d] = model.langs[top[d]]
            out["score"][d] = float(size[d, top[d]] / total[d])
            out["spans"][d] = ",".join(spans[d])
        return out

    return map_texts(as_bytes(docs, id_col, text_col), work, "id long, lang_pred string, score double, spans string", max(1 << 16, (2 << 20) * 16 // max(16, len(model.langs)))).withColumnRenamed("id", id_col)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`predict` of all documents by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = predict(docs, train(docs.where(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
