"""Rankers: BM25 inside a row's candidates and over a corpus, hashed n-gram cosine, embeddings, token overlap, deterministic random."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from veridex.functions.text import content_tokens, normalize_ascii, tokens
from veridex.plans.scratch import Scratch

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _score(tf: Column, length: Column, mean_length: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / F.greatest(mean_length, F.lit(1.0))))


def _ranked(df: DataFrame, query: str, score: str, candidate: str) -> DataFrame:
    """Rank by score (9 places, so that the order of sums can't break ties) and id."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), candidate)
    return df.withColumn("rank", F.row_number().over(order))


def bm25_local(pairs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 with N, document frequencies and mean length over each query's own candidates.

    pairs: query_id, query, candidate_id, document. Repeated query terms count
    repeatedly; a candidate without any shared term scores 0 and is still ranked.
    """
    rows = pairs.select("query_id", "candidate_id", tokens(F.col("query")).alias("q"), tokens(F.coalesce("document", F.col("candidate_id").cast("string"))).alias("d"))
    size = rows.withColumn("length", F.size("d"))
    stats = size.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    terms = rows.select("query_id", "candidate_id", "q", F.size("d").alias("length"), F.explode("d").alias("term"))
    wanted = terms.where(F.array_contains("q", F.col("term"))).withColumn("times", F.size(F.filter("q", lambda t: t == F.col("term"))))
    tf = wanted.groupBy("query_id", "candidate_id", "term", "length", "times").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    scored = tf.join(df, ["query_id", "term"]).join(stats, "query_id")
    one = F.col("times") * idf(F.col("n"), F.col("df")) * _score(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b)
    total = scored.groupBy("query_id", "candidate_id").agg(F.sum(one).alias("score"))
    out = pairs.select("query_id", "candidate_id").join(total, ["query_id", "candidate_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return _ranked(out, "query_id", "score", "candidate_id")


#: Distinct query terms (strings) that are sent to every task while documents are read; beyond, tokens are joined with them.
BROADCAST_TERMS = 500_000
#: The first scores come from each query's rarest terms, with so many times k postings.
FIRST_POSTINGS = 8
_ROUNDING = 1e-6


def _postings(documents: DataFrame, terms: DataFrame, k1: float, b: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """(term, candidate_id, impact) of every document that holds a query term, and the number of documents.

    Documents are read once: all other tokens of one count together, beside a
    token of its own that every document gets, which gives the number and the mean
    length of all documents.
    """
    words = documents.select("candidate_id", tokens(F.col("document")).alias("d")).select("candidate_id", F.size("d").alias("length"), F.explode(F.array_append(F.col("d"), F.lit(None))).alias("term"))
    known = words.join(terms.withColumn("_known", F.lit(True)), "term", "left").select("candidate_id", "length", F.when(F.col("_known"), F.col("term")).alias("term"))
    counted = scratch.keep(known.groupBy("candidate_id", "length", "term").agg(F.count("*").alias("tf")))
    own = F.col("term").isNull()
    totals = counted.agg(F.sum("tf").alias("tokens"), F.count_if(own).alias("n")).first()
    n, tokens_in_all = totals["n"], (totals["tokens"] or 0) - totals["n"]
    mean = F.lit(float(tokens_in_all / n if n else 1.0))
    return counted.where("term is not null").select("term", "candidate_id", _score(F.col("tf"), F.col("length"), mean, k1, b).alias("impact")), n


def _shortlist(weighted: DataFrame, postings: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, candidate_id) pairs that can be among a query's first k, a superset of these.

    A query's rarest terms give first scores; the k-th of them is a floor, since
    other terms only add. Terms whose greatest contributions add up to less than
    the floor can't bring a document in on their own, so only the postings of the
    others are read, and of their documents those stay that reach the floor with
    the greatest contribution of every term not read.
    """
    by_rarity = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = weighted.withColumn("before", before).where(F.col("before") < FIRST_POSTINGS * k)
    scores = lambda asked: asked.join(postings, "term").groupBy("query_id", "candidate_id").agg(F.sum(F.col("w") * F.col("impact")).alias("s"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))
    floor_of = lambda scored: scored.withColumn("r", place).where(F.col("r") == k).select("query_id", (F.col("s") - _ROUNDING).alias("floor"))
    reach = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    split = weighted.join(floor_of(scores(rare)), "query_id", "left").withColumn("needed", reach >= F.coalesce("floor", F.lit(0.0)))
    split = scratch.keep(split)
    rest = split.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    part = scratch.keep(scores(split.where("needed")))
    floors = rest.join(floor_of(part), "query_id", "left")  # at least as high as the first
    return part.join(floors, "query_id").where(F.col("s") + F.col("rest") >= F.coalesce("floor", F.lit(0.0))).select("query_id", "candidate_id")


def bm25_global(queries: DataFrame, documents: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The top k documents for each query, over the whole corpus; documents without any shared term are left out.

    queries: query_id, query; documents: candidate_id, document. Exact: pairs that
    can't reach a query's first k are never scored in full (see _shortlist), and
    pairs that share nothing never meet. Null texts are empty; rows that repeat a
    query count its terms again; a repeated candidate counts as one document with
    the tokens of all rows of the same length.
    """
    scratch = Scratch(queries.sparkSession, "bm25")
    asked = scratch.keep(queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    terms = scratch.keep(asked.select("term").distinct())
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    found, n = _postings(documents, terms, k1, b, scratch)
    postings = scratch.keep(found)
    by_term = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("best"))
    weighted = asked.join(by_term, "term").withColumn("w", F.col("times") * idf(F.lit(n), F.col("df")))
    weighted = scratch.keep(weighted.select("query_id", "term", "df", "w", (F.col("w") * F.col("best")).alias("bound")))
    pairs = scratch.keep(_shortlist(weighted, postings, k, scratch))
    scored = pairs.join(weighted.select("query_id", "term", "w"), "query_id").join(postings, ["term", "candidate_id"]).groupBy("query_id", "candidate_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    return _ranked(scored, "query_id", "score", "candidate_id").where(F.col("rank") <= k)


@lru_cache(1 << 20)
def _bucket(gram: str) -> int:
    """gram_bucket of a gram, remembered: few grams make up most texts."""
    return int.from_bytes(hashlib.sha256(gram.encode()).digest()[:8], "big") & (BUCKETS - 1)


BUCKETS = 2048


def _vector(text: str) -> np.ndarray:
    padded = f"  {text}  "
    return np.bincount([_bucket(padded[i : i + n]) for n in (2, 3, 4) for i in range(len(padded) - n + 1)], minlength=BUCKETS).astype(float)


@pandas_udf(DoubleType())
def _gram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """The cosine of two texts' hashed n-gram counts, row by row."""
    seen: dict[str, np.ndarray] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if x not in seen:
            seen = {x: _vector(x)}  # a query's candidates come one after the other
        p, q = seen[x], _vector(y)
        out.append(float(p @ q / (np.linalg.norm(p) * np.linalg.norm(q))))
    return pd.Series(out)


def ngram_cosine(pairs: DataFrame) -> DataFrame:
    """Rank candidates by the cosine of hashed character n-gram counts; counts stay inside each row, only the final rank shuffles."""
    score = _gram_cosine(normalize_ascii(F.col("query")), normalize_ascii(F.col("document")))
    return _ranked(pairs.select("query_id", "candidate_id", score.alias("score")), "query_id", "score", "candidate_id")


def token_overlap(pairs: DataFrame) -> DataFrame:
    """Rank candidates by the number of shared content words."""
    shared = F.size(F.array_intersect(content_tokens(F.col("query")), content_tokens(F.col("document"))))
    return _ranked(pairs.select("query_id", "candidate_id", shared.cast("double").alias("score")), "query_id", "score", "candidate_id")


def random_order(pairs: DataFrame, seed: int) -> DataFrame:
    """A random order that seed, query and candidate fix, by hash."""
    key = F.sha2(F.concat_ws("\u0001", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("candidate_id").cast("string")), 256)
    order = Window.partitionBy("query_id").orderBy(key, "candidate_id")
    return pairs.select("query_id", "candidate_id", F.row_number().over(order).alias("rank"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroid_ranking(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Labels ranked for every vector by the cosine to the label's mean vector; labels are the small side."""
    parts = vectors.select(F.col(label).alias("candidate_id"), F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("candidate_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = mean.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    pairs = vectors.select(F.col("vec_id").alias("query_id"), "embedding").join(centroids, F.lit(True))  # vectors x labels
    return _ranked(pairs.select("query_id", "candidate_id", cosine(F.col("embedding"), F.col("centroid")).alias("score")), "query_id", "score", "candidate_id")


def as_rankings(ranked: DataFrame) -> DataFrame:
    """query_id and its candidates in order."""
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("candidate_id").cast("string").alias("c")))), lambda s: s["c"]).alias("ranking"))
