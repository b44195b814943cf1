"""Language identification: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm._arrays import Slice, slices

#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ur", "ne", "ta", "te"),
    "celtic": ("ga", "gd", "cy", "br"),
}
#: Labelled documents of a language that the model is fitted on, the first by hash of their id. Every language is learned; where PER_LANGUAGE
#: of each would be more than SAMPLE documents in all, each has its share of those, but not fewer than LEAST_EACH: the bound of the sample.
PER_LANGUAGE, SAMPLE, LEAST_EACH = 400, 12_800, 50
#: Documents longer than this are left out of the fit (never of the prediction).
LONGEST_FIT = 20_000
DIMENSIONS = 1 << 12
HELD_OUT, MODULUS = 2, 4
_DOCS_AT_ONCE = 256
#: Tasks that the duels are dealt over.
MOST_TASKS = 256
_LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 32, np.uint32)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(part: Slice) -> np.ndarray:
    """A row per text: hashed counts of byte 1- to 4-grams, letters folded and other signs a blank each, log-scaled, of length 1."""
    n, m = len(part.lo), len(part.data)
    out = np.zeros(n * DIMENSIONS)
    own = np.repeat(np.arange(n), part.hi - part.lo)
    b = _FOLD[part.data]
    gram = np.zeros(m, np.uint32)
    for size in range(1, 5):
        if m < size:
            break
        gram = gram[: m - size + 1] * np.uint32(257) + b[size - 1 :] + np.uint32(size)
        at = ((gram * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
        whole = own[: m - size + 1] == own[size - 1 :]
        out += np.bincount((own[: m - size + 1] * DIMENSIONS + at)[whole], minlength=n * DIMENSIONS)
    rows = np.log1p(out.reshape(n, DIMENSIONS))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def small(column: pa.Array) -> Iterator[tuple[int, Slice]]:
    """Slices of few documents, so that their dense features stay small."""
    for start in range(0, len(column), _DOCS_AT_ONCE):
        for part in slices(column.slice(start, _DOCS_AT_ONCE)):
            yield start + part.first, part


def _fit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features that a document has, by place and value."""
    for batch in batches:
        for first, part in small(batch.column("text")):
            rows = features(part).astype(np.float32)
            has = [np.flatnonzero(x) for x in rows]
            made = [pa.array([h.astype(np.uint16).tobytes() for h in has], pa.binary()), pa.array([x[h].tobytes() for x, h in zip(rows, has, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(rows)) for k in ("doc_id", "lang")), *made], names=["doc_id", "lang", "place", "value"])


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """A linear SVM (squared hinge, balanced classes, last weight the bias) by accelerated gradient descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    share = share.astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    ahead, step = w.copy(), 0.25
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = penalty * ahead - 2 * x.T @ (share * slack * y)
        new = ahead - step * grad
        ahead = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


def family(lang: str) -> str:
    return next((k for k, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), f"alone:{lang}")


@dataclass
class Model:
    """Votes between families, then between the languages of each."""

    families: list[str]
    languages: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray]

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], between: dict[tuple[str, str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each row's duels (most wins, then margins, then order), and how sure its closest duel was."""
        wins, margin, least = (np.zeros((len(x), len(names))) for _ in range(3))
        least += 1.0
        for i, j in combinations(range(len(names)), 2):
            w = between[names[i], names[j]]
            f = x @ w[:-1] + w[-1]
            p = 1 / (1 + np.exp(-3 * f))
            for k, sign, q in ((i, 1, p), (j, -1, 1 - p)):
                wins[:, k] += sign * f > 0
                margin[:, k] += sign * f
                least[:, k] = np.minimum(least[:, k], q)
        best = np.argmax(wins + 1e-3 * np.tanh(margin), axis=1)
        return best, least[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        group, sure = self._vote(x, self.families, self.between)
        names, score = np.empty(len(x), object), sure.copy()
        for g, name in enumerate(self.families):
            rows = np.flatnonzero(group == g)
            if len(rows):
                best, own = self._vote(x[rows], self.languages[name], self.between)
                names[rows] = [self.languages[name][b] for b in best]
                score[rows] *= own
        return names.tolist(), score


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % MODULUS == HELD_OUT, F.lit(False))


def _hash(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(_HASHES))


_HASHES = 1 << 40


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, text) that may be learned from: the first by hash of doc_id of every language, as many of each as the bounds give it.

    Counts come first; they tell up to which hash about twice as many as wanted
    lie, so that only those are ranked and no language gathers in a task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    known = rows.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= LONGEST_FIT) & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    each = min(per_language, max(LEAST_EACH, total // max(len(counts), 1)))
    wanted = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * each + 50) / r["n"]) * _HASHES) for r in counts], "lang string, upto double")
    few = known.select("doc_id", "lang").join(F.broadcast(wanted), "lang").where(_hash("doc_id") <= F.col("upto"))
    first = Window.partitionBy("lang").orderBy(_hash("doc_id"), "doc_id")
    chosen = few.withColumn("r", F.row_number().over(first)).where(F.col("r") <= each).select("doc_id", "lang").distinct()
    return known.join(F.broadcast(chosen), ["doc_id", "lang"])


@dataclass
class Sample:
    """The features of the sample: document i has value[ptr[i]:ptr[i + 1]] at place[...], and those of a language stand at rows[language]."""

    ptr: np.ndarray
    place: np.ndarray
    value: np.ndarray
    rows: dict[str, np.ndarray]

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), DIMENSIONS), np.float32)
        for k, i in enumerate(rows):
            out[k, self.place[self.ptr[i] : self.ptr[i + 1]]] = self.value[self.ptr[i] : self.ptr[i + 1]]
        return out


def _fit_duels(frames: Iterator[pd.DataFrame], shared: Broadcast, sides: dict[str, list[str]]) -> Iterator[pd.DataFrame]:
    """The weights of each duel between two families or languages."""
    have: Sample = shared.value
    for frame in frames:
        for a, b in zip(frame["a"], frame["b"], strict=True):
            left, right = (np.concatenate([have.rows[k] for k in sides[side]]) for side in (a, b))
            y = np.concatenate([np.ones(len(left), np.float32), -np.ones(len(right), np.float32)])
            yield pd.DataFrame({"a": [a], "b": [b], "weights": [fit_svm(have.dense(np.concatenate([left, right])), y).tobytes()]})


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = SAMPLE) -> Model:
    """Learn from text and non-null lang of documents that aren't held out: a bounded sample (see `sample`), sent once to the tasks that fit the duels.

    All languages are learned, however many; the model has a row of weights for
    each pair of families and for each pair of languages of one family.
    """
    spark = docs.sparkSession
    table = sample(docs, per_language, total).mapInArrow(_fit_features, "doc_id long, lang string, place binary, value binary").toArrow()
    table = table.sort_by([(k, "ascending") for k in ("lang", "doc_id", "place", "value")])
    place, value = ([np.frombuffer(x, t) for x in table.column(k).to_pylist()] for k, t in (("place", np.uint16), ("value", np.float32)))
    langs = np.array(table.column("lang").to_pylist(), object)
    names = sorted(set(langs))
    of = {k: family(k) for k in names}
    families = sorted(set(of.values()))
    known = {f: [k for k in names if of[k] == f] for f in families}
    duels = [*combinations(families, 2), *(pair for f in families for pair in combinations(known[f], 2))]
    if not duels:
        return Model(families, known, {})
    have = Sample(np.concatenate([[0], np.cumsum([len(x) for x in place])]), np.concatenate(place), np.concatenate(value), {k: np.flatnonzero(langs == k) for k in names})
    sides = {k: [k] for k in names} | known
    pairs = spark.createDataFrame(duels, "a string, b string").repartition(min(len(duels), MOST_TASKS))
    fitted = pairs.mapInPandas(partial(_fit_duels, shared=spark.sparkContext.broadcast(have), sides=sides), "a string, b string, weights binary").collect()
    return Model(families, known, {(r["a"], r["b"]): np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in fitted})


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in small(batch.column("_t")):
            n = len(part.lo)
            names, score = model.predict(features(part)) if model.families else (["und"] * n, np.zeros(n))
            for i in range(n):
                if not _LETTER.search(part.text(i).decode("utf-8", "replace")):
                    names[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(names), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) from the text alone.

    Defined results: null texts and texts without a letter are `und` with score
    0, and so is everything where nothing could be learned; null ids and repeated
    rows give one row each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    return rows.mapInArrow(partial(_predict, model=model), "doc_id long, lang_pred string, score double")
