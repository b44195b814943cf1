"""Benchmark decontamination with DataFrame functions only.

Words are lower-cased runs of letters and digits. A window can only reach the
similarity with an item if it holds so many of the item's shingles that one of
its rarest few must be among them (a prefix filter, which loses no pair). For
documents and items that meet there, windows as long as the item are taken
wherever they share a shingle, and the exact weighted Jaccard similarity of the
shingle bags decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm._spark import NO_ID, Scratch, keyed

SHINGLE, PERCENT = 5, 75
BITS = 64
#: Fingerprints of windows of 20 words and more that differ in one word are so near; distances are reported and drop no pair.
RADIUS = 15
#: Up to so many distinct item shingles are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_SHINGLES = 2_000_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def placed_grams(words: str, sizes: list[int]) -> Column:
    """(gram, at, width) of the shingles of these sizes."""
    one = [F.expr(f"if(size({words}) < {k}, array(), transform(sequence(1, size({words}) - {k - 1}), i -> struct(xxhash64(slice({words}, i, {k})) as gram, i - 1 as at, {k} as width)))") for k in sizes]
    return one[0] if len(one) == 1 else F.concat(*one)


def simhash(words: str) -> Column:
    """A 64-bit fingerprint: the sign of every bit's sum over the words' hashes."""
    sums = f"transform(sequence(0, {BITS - 1}), b -> aggregate(transform({words}, w -> xxhash64(w)), 0, (s, h) -> s + cast(shiftright(h, b) & 1L as int) * 2 - 1))"
    return F.expr(f"aggregate(transform({sums}, (s, b) -> if(s > 0, shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)")


def bag_similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two shingle arrays, a shingle weighing as often as it occurs."""
    count = "size(filter({}, y -> y = x))"
    both = f"aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least({count.format(a)}, {count.format(b)}))"
    return F.expr(f"if(size({a}) + size({b}) = 0, 0D, cast({both} as double) / (size({a}) + size({b}) - {both}))")


def shingles(words: str, size: str) -> Column:
    return F.expr(f"if(size({words}) < {size}, array({words}), transform(sequence(1, size({words}) - {size} + 1), i -> slice({words}, i, {size})))")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, similarity, start, n_words, distance.

    start is the window's first word (from 0), the most similar window counts,
    the first of several; distance is that of the fingerprints. Items of fewer
    than five words count as one shingle. Documents shorter than an item give one
    window. Defined results: null and empty texts and items match nothing; null
    ids pass through; rows that repeat a doc_id with another text are judged one by
    one and give rows of their own, equal rows give one; repeated items count
    apart; other columns are ignored.
    Empty tables give an empty result.
    """
    distance = F.bit_count(simhash("window").bitwiseXOR(simhash("item")))
    found = _matches(docs, benchmark, percent).withColumn("distance", distance)
    return found.select(F.nullif("_d", F.lit(NO_ID)).alias("doc_id"), "item_id", "similarity", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), "distance")


def rarest(of_items: DataFrame, percent: int) -> DataFrame:
    """(gram, no): so many of each item's rarest shingles that a similar window holds one of them.

    A union is never smaller than the item's bag, so a similar window holds at
    least `percent` of its shingles; the least similarity is that before rounding.
    """
    own = of_items.where("own")
    often = own.groupBy("gram").agg(F.count("*").alias("often"))
    least = F.greatest(F.lit(1), F.ceil(F.col("grams") * (percent / 100 - 1e-6)))
    rank = F.row_number().over(Window.partitionBy("no").orderBy("often", "gram", "item_at"))
    return own.join(often, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("grams") - least + 1).select("gram", "no").distinct()


def _matches(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts = keyed(docs).where("_t != ''").select("_d", "_h", word_list(F.col("_t")).alias("words"))
    items = benchmark.select("item_id", word_list(F.coalesce("text", F.lit(""))).alias("item")).where("size(item) > 0")
    items = items.select(F.monotonically_increasing_id().alias("no"), "item_id", "item", F.size("item").alias("length"), F.least(F.size("item"), F.lit(SHINGLE)).alias("size"))
    items = scratch.keep(items)
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()] or [SHINGLE]  # 1 to SHINGLE

    of_items = items.select("no", "length", "size", F.explode(placed_grams("item", sizes)).alias("g")).select("no", "length", "g.gram", F.col("g.at").alias("item_at"), (F.col("g.width") == F.col("size")).alias("own"), (F.col("length") - F.col("size") + 1).alias("grams"))
    of_items = scratch.keep(of_items)
    wanted = of_items.select("gram").distinct()
    if wanted.count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)
    hits = texts.select("_d", "_h", F.size("words").alias("n"), F.explode(placed_grams("words", sizes)).alias("g")).select("_d", "_h", "n", "g.gram", "g.at").join(wanted, "gram")
    hits = scratch.keep(hits)
    met = hits.join(rarest(of_items, percent), "gram").select("_d", "_h", "no").distinct()
    shared = hits.join(met.join(of_items, "no"), ["_d", "_h", "gram"])
    starts = shared.select("_d", "_h", "no", "length", F.greatest(F.lit(0), F.least(F.col("at") - F.col("item_at"), F.col("n") - F.col("length"))).alias("start")).distinct()

    wide = scratch.keep(texts.join(starts, ["_d", "_h"]).select("_d", "_h", "no", "start", F.slice("words", F.col("start") + 1, F.col("length")).alias("window")))
    pairs = wide.join(items.select("no", "item_id", "item", "size"), "no")
    scored = pairs.select("_d", "_h", "no", "item_id", "start", F.size("window").alias("n_words"), "window", "item", shingles("window", "size").alias("a"), shingles("item", "size").alias("b"))
    scored = scored.withColumn("similarity", F.round(bag_similarity("a", "b"), 6)).where(F.col("similarity") * 100 >= percent).drop("a", "b")
    best = Window.partitionBy("_d", "_h", "no").orderBy(F.desc("similarity"), "start")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = _matches(docs, benchmark, percent).select("_d", "_h").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), F.hash(text).alias("_h"))
    return rows.join(found, ["_d", "_h"], "left_anti").select("_row.*")
