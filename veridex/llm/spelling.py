"""Spelling variants: anagram keys find words that differ by one letter, and variants point to the form that is written most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm._spark import Scratch

#: Fixed values of the contract: what a run is, and which runs are misread (one in DAMAGED, by the hash of id and run).
RUN = r"([A-Za-zÀ-ÿ]++)"
DAMAGED = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A letter's value is this power of its code point; keys are sums modulo a prime, so that words of any length have one.
POWER, MODULUS = 5, (1 << 61) - 1
#: Words that a key joins without looking at the order of their letters; keys with more are joined letter place by letter place.
FEW = 32
#: A form is written so many times as often as its variant, at least.
TIMES = 2


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def read_words(docs: DataFrame) -> DataFrame:
    """The words of the texts with their counts n: runs of letters, A-Z in lower case, one in DAMAGED without one of its letters."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(RUN), F.lit(1))).alias("_run"))
    hashed = runs.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run")).alias("_h"), F.length("_run").alias("_length"))
    at = (F.col("_h") % F.col("_length")).cast("int")
    less = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.col("_length")))
    words = hashed.select(F.when(F.col("_h") % DAMAGED == 0, less).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def anagram_key(word: Column) -> Column:
    """The sum of the letters' values: equal for words of the same letters, and what a letter adds or takes is its value."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda key, letter: F.pmod(key + F.when(letter != "", _value(letter)).otherwise(0), F.lit(MODULUS)))


def _entries(words: DataFrame) -> DataFrame:
    """Every word under its own key (letter '') and under its key less the value of each of its letters.

    Two words whose keys differ by a letter's value (one more letter) or by the difference of two (one exchanged) share such a key.
    """
    letters = F.array_union(F.array(F.lit("")), F.array_distinct(F.split("word", "")))
    return words.select("word", "n", "key", F.explode(letters).alias("letter")).select("word", "n", "letter", F.pmod(F.col("key") - F.when(F.col("letter") != "", _value(F.col("letter"))).otherwise(0), F.lit(MODULUS)).alias("key"))


def _sides(left: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """The pairs of entries that share the columns `on`, as (one, n_one, two, n_two)."""
    other = lambda side: left.select(*on, F.col("word").alias(side), F.col("n").alias(f"n_{side}"), F.col("letter").alias(f"letter_{side}"))
    return other("one").join(other("two"), on).where(condition).select("one", "n_one", "two", "n_two")


def near_pairs(words: DataFrame, few: int = FEW) -> DataFrame:
    """Each pair of words (word, n, key) that one inserted, deleted or replaced code point makes equal, once, as (one, n_one, two, n_two).

    Keys that up to `few` entries share are joined as they are, and the order of
    the letters is verified on the pairs. More entries on one key, as anagrams of
    many syllables give, are joined on what their word is without the letter as
    well (and on the letter's place, for an exchange), which only near words share.
    """
    entries = _entries(words)
    busy = entries.groupBy("key").agg(F.count("*").alias("_size")).where(F.col("_size") > few).select("key")
    differ = F.col("letter_one") < F.col("letter_two")
    plain = _sides(entries.join(busy, "key", "left_anti"), ["key"], differ).where(F.levenshtein("one", "two", 1) == 1)
    crowded = entries.join(busy, "key", "left_semi")
    size = F.length("word")
    without = lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, size))
    places = F.filter(F.sequence(F.lit(1), size), lambda i: F.substring("word", i, F.lit(1)) == F.col("letter"))
    exchanged = crowded.where("letter != ''").select("word", "n", "letter", "key", F.explode(places).alias("place")).withColumn("rest", without(F.col("place")))
    whole = crowded.where("letter = ''").withColumn("rest", F.col("word"))
    shorter = crowded.where("letter != ''").withColumn("rest", F.explode(F.array_distinct(F.transform(places, without))))
    longer = whole.select("key", "rest", F.col("word").alias("one"), F.col("n").alias("n_one")).join(shorter.select("key", "rest", F.col("word").alias("two"), F.col("n").alias("n_two")), ["key", "rest"]).select("one", "n_one", "two", "n_two")
    return plain.unionByName(_sides(exchanged, ["key", "rest", "place"], differ)).unionByName(longer)


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and the last of its forms, for the words that have a form: every round doubles the steps, until none is left."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = scratch.keep(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        scratch.drop(now)
        if not step.where("_moved").limit(1).count():
            return step.select("word", "root")
        now = step.drop("_moved")


def spelling_variants(docs: DataFrame, few: int = FEW) -> DataFrame:
    """A row per word: n, its near words' number n_near, its form with form_n (null without one), and root, the last of its forms.

    A form is the near word that is written most, ties by code-point order, where
    that is at least TIMES as often; so counts at least double along forms, which
    therefore end.
    Defined results: null and empty texts have no words; a null id counts as an
    empty one in the hash; repeated rows count again; other columns are ignored;
    an empty table gives an empty result. A run of any length is one word.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(read_words(docs).withColumn("key", anagram_key(F.col("word"))))
    pairs = scratch.keep(near_pairs(words, few))
    both = pairs.select(F.col("one").alias("word"), F.col("two").alias("other"), F.col("n_two").alias("m")).unionByName(pairs.select(F.col("two").alias("word"), F.col("one").alias("other"), F.col("n_one").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    likely = -F.col("best.m") >= TIMES * F.col("n")
    found = scratch.keep(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.other")).alias("form"), F.when(likely, -F.col("best.m")).alias("form_n")))
    roots = _roots(found.where("form is not null"), scratch)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
