"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

The index stores postings of the training text: a term of up to three running words that some item holds, the text (named by 128 bits of
hash, so that copies of a text are one) and the position. A near window has at most ``window - near`` words out of place, so cut into one cell more than
that, one cell is whole (with 13 and 10: four cells of three or four words). Each window is looked up by the rarest term of every
cell; a posting less the term's offset in the item is an alignment of the item with a text, and no near or exact window is
missed. The lists of the item's other terms are then intersected with these alignments: three words out of place leave two of eleven terms
of three words whole, so most chance meetings go. Only texts with an alignment left are read again: each alignment takes from the text the words
that it puts beside the item's, which gives exact phrases (all words of a window) and near ones (``near`` or more of its words in place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import cut, sized, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The array of a text's words, A-Z lower-cased; empty for null. Letters beyond ASCII keep their case."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def name_of(text: Column) -> list[Column]:
    """``__a`` and ``__b``, two hashes that name a text."""
    return [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(1), text).alias("__b")]


def items_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, near: int) -> DataFrame:
    """(item, item_words, n, size, cells, length, no): the different items that have words, named by a hash (items of one name are compared with a text each, so that equal hashes do no harm). ``size`` words are a window, cut into
    ``cells`` of which one is whole wherever ``near`` words are in place; grams of ``length`` words, three at most, fit into any cell."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("item_words")).distinct()
    known = items.withColumn("n", F.size("item_words")).where("n > 0").withColumn("size", F.least("n", F.lit(window)))
    cells = known.withColumn("cells", F.col("size") - F.least("size", F.lit(near)) + 1)
    return cells.withColumn("length", F.least(F.lit(3), F.floor(F.col("size") / F.col("cells"))).cast("int")).withColumn("no", F.xxhash64("item", "item_words"))


def gram(first: Column, second: Column, third: Column, length: Column) -> Column:
    """A hash of the first ``length`` of three words. Alignments are compared with the text, so equal hashes do no harm."""
    return F.xxhash64(first, F.when(length > 1, second), F.when(length > 2, third))


def grams(items: DataFrame) -> DataFrame:
    """(no, p, key): all grams of each item."""
    at = lambda k: F.get("item_words", F.col("p") + k)
    placed = items.select("no", "item_words", "length", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))).alias("p"))
    return placed.select("no", "p", gram(at(0), at(1), at(2), F.col("length")).alias("key"))


def pivots(items: DataFrame, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Of :func:`grams`, those that are the rarest of a cell of some window by their ``count`` in the training text (ties: the first).

    A cell whose rarest gram never occurs is whole nowhere, and needs no look-up.
    """
    starts = items.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    edge = lambda i: F.col("s") + F.floor(i * F.col("size") / F.col("cells")).cast("int")
    cells = starts.select("no", edge(F.col("i")).alias("first"), (edge(F.col("i") + 1) - F.col("length")).alias("last")).distinct()
    ranked = rows.join(counts, "key", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    best = cells.withColumn("p", F.explode(F.sequence("first", "last"))).join(ranked, ["no", "p"]).groupBy("no", "first", "last").agg(F.min(F.struct("count", "p", "key")).alias("best"))
    return best.where("best.count > 0").select("no", "best.p", "best.key").distinct()


def postings(texts: DataFrame, terms: DataFrame, lengths: list[int]) -> DataFrame:
    """The index (__a, __b, pos, key) of the texts (__a, __b, __text), of those terms that ``terms`` holds in ``key``; ``lengths``: theirs, in words.

    Position p has the terms that begin with word p (those cut short by the end equal shorter ones, and only cost a comparison).
    """
    w = F.col("w")
    zipped = texts.select("__a", "__b", words(F.col("__text")).alias("w"))
    placed = zipped.select("__a", "__b", F.posexplode(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.size(w)).alias("b"), F.slice(w, F.lit(3), F.size(w)).alias("c"))).alias("pos", "x"))
    keys = [gram(F.col("x.a"), F.col("x.b"), F.col("x.c"), F.lit(n)) for n in lengths]
    every = placed.select("__a", "__b", "pos", (keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).alias("key"))
    return every.join(sized(terms), "key", "left_semi")


def compared(texts: DataFrame, aligned: DataFrame, items: DataFrame, near: int) -> DataFrame:
    """(__a, __b, n_words, item, hit) of those alignments (__a, __b, no, at) that put a near window in place; ``hit`` are the positions that whole windows cover."""
    by_text = cut(aligned.join(sized(items.select("no", "n")), "no").groupBy("__a", "__b").agg(F.collect_list(F.struct("no", "at", "n")).alias("found")))
    named = sized(by_text.select("__a", "__b"))
    read = texts.join(named, ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"]).select("__a", "__b", words(F.col("__text")).alias("w"))
    beside = lambda c: F.slice("w", F.greatest(c["at"], F.lit(0)) + 1, F.least(c["n"], c["n"] + c["at"]))
    each = read.join(by_text, ["__a", "__b"]).select("__a", "__b", F.size("w").cast("long").alias("n_words"), F.explode(F.transform("found", lambda c: F.struct(c["no"].alias("no"), c["at"].alias("at"), beside(c).alias("x")))).alias("c"))
    each = each.select("__a", "__b", "n_words", "c.no", "c.at", "c.x").join(sized(items.select("no", "item", "item_words", "n", "size"), 64 + F.aggregate("item_words", F.lit(0), lambda t, x: t + 16 + F.octet_length(x))), "no")
    # per word of the item whether it is in place; those before or after the text are not
    skip = F.greatest(-F.col("at"), F.lit(0))
    same = F.transform("item_words", lambda y, k: F.coalesce(F.get("x", k - skip) == y, F.lit(False)).cast("int"))
    least = F.least("size", F.lit(near))
    total = F.aggregate("same", F.lit(0), lambda t, x: t + x)
    # most alignments are chance meetings, which go before their windows are summed
    enough = each.withColumn("same", same).where(total >= least)
    scores = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda s: F.struct(s.alias("s"), F.aggregate(F.slice("same", s + 1, F.col("size")), F.lit(0), lambda t, x: t + x).alias("score")))
    out = enough.withColumn("scores", scores).where(F.exists("scores", lambda x: x["score"] >= least))
    whole = F.filter("scores", lambda x: x["score"] == F.col("size"))
    hit = F.array_distinct(F.flatten(F.transform(whole, lambda x: F.sequence(F.col("at") + x["s"], F.col("at") + x["s"] + F.col("size") - 1))))
    return out.select("__a", "__b", "n_words", "item", hit.alias("hit"))


def gapped(texts: DataFrame, spots: DataFrame, items: DataFrame, near: int, gap: int) -> DataFrame:
    """(__a, __b, n_words, item, hit) of near windows in two parts, up to ``gap`` words further apart, or closer, in the text than in the item.

    ``spots``: (__a, __b, no, at, p), an alignment and where in the item a whole term stands along it. Each part holds such a term.
    """
    each = spots.groupBy("__a", "__b", "no", "at").agg(F.collect_set("p").alias("ps"))
    moved = each.select("__a", "__b", "no", F.col("at").alias("at1"), F.col("ps").alias("ps1"), F.explode(F.array(*[F.lit(g) for g in range(-gap, gap + 1) if g])).alias("g")).withColumn("at", F.col("at1") + F.col("g"))
    pairs = moved.join(each, ["__a", "__b", "no", "at"]).where(F.array_min("ps1") < F.array_max("ps"))
    pairs = cut(pairs.join(sized(items.select("no", "item", "item_words", "n", "size", "length"), 64 + F.aggregate("item_words", F.lit(0), lambda t, x: t + 16 + F.octet_length(x))), "no"))
    read = texts.join(sized(pairs.select("__a", "__b").distinct()), ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"]).select("__a", "__b", words(F.col("__text")).alias("w"))
    same = lambda at: F.transform("item_words", lambda y, k: F.when(F.col(at) + k >= 0, F.coalesce(F.get("w", F.col(at) + k) == y, F.lit(False))).otherwise(F.lit(False)).cast("int"))
    both = read.join(pairs, ["__a", "__b"]).withColumn("same1", same("at1")).withColumn("same2", same("at"))
    size, length = F.col("size"), F.col("length")
    total = lambda c, a, b: F.aggregate(F.slice(c, a + 1, b - a), F.lit(0), lambda t, x: t + x)
    found = F.exists(
        F.sequence(F.lit(0), F.col("n") - size),
        lambda s: F.exists(
            F.sequence(s + length, F.greatest(s + length, s + size - length)),
            lambda m: F.exists("ps1", lambda p: (p >= s) & (p + length <= m)) & F.exists("ps", lambda p: (p >= m) & (p + length <= s + size)) & (total("same1", s, m) + total("same2", m, s + size) >= F.least(size, F.lit(near))),
        ),
    )
    return both.where(found).select("__a", "__b", F.size("w").cast("long").alias("n_words"), "item", F.array().cast("array<int>").alias("hit")).distinct()


def contamination_of(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, near: int, gap: int = 0) -> DataFrame:
    """(__a, __b, n_words, n_hit, items, n_near) of the texts (__a, __b, __text) that hold a near window; written, and few as they are."""
    items = items_of(benchmark, item_col, item_text_col, window, near)  # few, as the benchmark is, and made anew for each use
    rows = grams(items)
    lengths = sorted(r.length for r in items.select("length").distinct().collect()) or [3]
    index = cut(postings(texts, rows.select("key").distinct(), lengths).distinct())  # copies of a text are one
    counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    rare = pivots(items, rows, counts)
    spot = ["__a", "__b", "no", "at"]
    less = lambda terms: index.join(sized(terms), "key").select("__a", "__b", "no", (F.col("pos") - F.col("p")).alias("at"))
    found = less(rare).distinct()
    # terms of a near window that are whole at least, as each word out of place breaks as many as a term has words
    least = F.greatest(F.lit(1), F.col("size") - F.col("length") + 1 - (F.col("size") - F.least("size", F.lit(near))) * F.col("length")).alias("least")
    whole = less(rows).join(found, spot, "left_semi").groupBy(*spot).agg(F.count(F.lit(1)).alias("whole"))
    aligned = whole.join(sized(items.select("no", least)), "no").where("whole >= least").select(*spot)
    scored = compared(texts, aligned, items, near)
    if gap:
        spots = index.join(sized(rows), "key").select("__a", "__b", "no", (F.col("pos") - F.col("p")).alias("at"), "p")
        scored = scored.union(gapped(texts, spots, items, near, gap))
    by_text = scored.groupBy("__a", "__b", "n_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.when(F.size("hit") > 0, F.col("item")))).alias("items"),
        F.size(F.collect_set("item")).cast("long").alias("n_near"),
    )
    return cut(by_text)


def contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, near: int = 10, share: int = 20, gap: int = 0) -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``n_hit`` (words within an occurrence of a window), ``n_items`` (items with one),
    ``items_sha256`` (of their ids, sorted as strings, comma-joined), ``contaminated`` (n_hit > 0 and share * n_hit >= n_words) and
    ``n_near`` (items with at least ``near`` words of a window in place along one alignment, exact ones included). With a ``gap``, a
    window may also be in two parts, with up to as many words put in between them in the text or left out: words before along one alignment,
    words after along the other, each part with a whole term (three running words, fewer where short items have shorter ones).

    A null text has no words, and neither it nor an empty table of either kind gives hits. An item of fewer words than a window is one
    window; an item with no words or a null id is none. Rows of one item id with different texts count as one item. Null and
    repeated document ids are fine: what is found belongs to a text, and every row with it gets it.
    """
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).alias("__id"), *name_of(text), text.alias("__text"))
    found = contamination_of(named.select("__a", "__b", "__text"), benchmark, item_col, item_text_col, window, near, gap).drop("n_words")
    out = named.select("__id", "__a", "__b", F.size(words(F.col("__text"))).cast("long").alias("n_words")).join(found, ["__a", "__b"], "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_near": F.coalesce("n_near", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(F.col("__id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated(share).alias("contaminated"), "n_near")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, near: int = 10, share: int = 20) -> DataFrame:
    """``docs`` without the rows whose text is contaminated. Rows with a null id stay."""
    text = F.col(text_col).cast("string")
    texts = docs.where(F.col(id_col).isNotNull()).select(*name_of(text), text.alias("__text"))
    gone = contamination_of(texts, benchmark, item_col, item_text_col, window, near).where(contaminated(share)).select("__a", "__b")
    a, b = name_of(text)
    return docs.join(sized(gone), (a == F.col("__a")) & (b == F.col("__b")) & F.col(id_col).isNotNull(), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`mark` of all documents by all items: windows of 13 words, near ones with 10 in place, contaminated from a twentieth on."""
    return mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
