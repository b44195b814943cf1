"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

Statistics are computed in Arrow batches where the documents lie. The trees are
fitted on a bounded sample of labelled documents, a few hundred kilobytes of bin
numbers, and applied to all documents: a few array lookups per level and tree,
for a whole slice of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm._arrays import SPACE, Rolling, mix, slices, word_hashes, words

STATISTICS = (
    "words", "word_length", "word_length_spread", "distinct_words", "commonest_word", "repeats_last", "repeated_triples", "lines", "repeated_lines", "upper", "digits", "symbols",
    "exclaims", "stops", "other_marks", "accented", "symbol_words", "mark_only_words", "upper_words", "capital_words", "one_letter_words", "sentence_ends", "byte_entropy", "spaces",
)
#: Labelled documents that the trees are fitted on, the first by hash of their id: the bound of the sample.
FIT_DOCUMENTS = 30_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
#: Least sum of second derivatives in a leaf, and what is added to it.
LEAST_WEIGHT, PENALTY = 2.0, 1.0
#: Documents whose hash leaves this remainder are never learned from.
PARTS, HELD = 3, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % PARTS == HELD, F.lit(False))


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


UPPER, DIGIT, SYMBOL, EXCLAIM, STOP = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#*$%&|<>"), _class(b"!"), _class(b".,;:?")
LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)))
HEAD = ~_class(bytes(range(0x80, 0xC0)))
OTHER = ~(LETTER | DIGIT | SYMBOL | EXCLAIM | STOP | SPACE) & HEAD


def _within(own: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the keys of each owner: how many differ, how often the commonest stands, and how many stand there more than once."""
    _, first, count = np.unique(mix(keys ^ mix(own.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    of = own[first]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=n), most, np.bincount(of, np.where(count > 1, count, 0), n)


def statistics(texts: pa.Array) -> np.ndarray:
    """The statistics of every text, a row each; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float32)
    for part in slices(texts):
        n, found, data = len(part.lo), words(part), part.data
        edges = np.concatenate([part.lo[:1], part.hi])

        def total(x: np.ndarray, edges: np.ndarray = edges) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(x)])[edges])

        n_words = found.hi - found.lo
        count = np.maximum(n_words, 1)
        own = np.repeat(np.arange(n), n_words)
        per_word = lambda x: np.bincount(own, x, n) / count  # noqa: E731, B023
        inside = lambda members: np.diff(np.concatenate([[0], np.cumsum(members[data])])[np.stack([found.start, found.end])], axis=0)[0]  # noqa: E731, B023
        chars, letters = np.maximum(total(HEAD[data]), 1), np.maximum(total(LETTER[data]), 1)
        length = inside(HEAD)
        hashes = word_hashes(data, found)
        distinct, commonest, _ = _within(own, hashes, n)
        again = np.zeros(len(own), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
        triples = np.zeros(n)
        if len(hashes) > 2:
            whole = own[2:] == own[:-2]
            triples = _within(own[:-2][whole], mix(Rolling(hashes).windows(3))[whole], n)[2]
        lines = [part.text(i).split(b"\n") for i in range(n)]
        n_lines = np.array([len(x) for x in lines])
        mean = per_word(length)
        flags = np.bincount(data.astype(np.int64) + 256 * np.repeat(np.arange(n), part.hi - part.lo), minlength=256 * n).reshape(n, 256) / np.maximum(part.hi - part.lo, 1)[:, None]
        last = data[found.end - 1] if len(found.end) else data[:0]
        first = data[found.start] if len(found.start) else data[:0]
        columns = (
            np.log1p(n_words), mean, np.sqrt(np.maximum(per_word(length.astype(float) ** 2) - mean**2, 0)), distinct / np.sqrt(count), commonest / count, per_word(again), triples / count, n_lines / count,
            1 - np.array([len(set(x)) for x in lines]) / n_lines, total(UPPER[data]) / letters, total(DIGIT[data]) / chars, total(SYMBOL[data]) / chars, total(EXCLAIM[data]) / chars, total(STOP[data]) / chars,
            total(OTHER[data]) / chars, total(data >= 0xC2) / letters, per_word(inside(SYMBOL) > 0), per_word(inside(LETTER | DIGIT) == 0), per_word((inside(UPPER) > 1) & (inside(UPPER) >= inside(LETTER))),
            per_word(UPPER[first]), per_word(length == 1), per_word(_class(b".!?")[last]), -(flags * np.log2(np.where(flags > 0, flags, 1))).sum(1), total(SPACE[data]) / chars,
        )
        out[part.first : part.first + n] = np.where((part.hi > part.lo)[:, None], np.stack(columns, 1), 0)
    return out


@dataclass
class Trees:
    """All trees in arrays: node k splits `feature` at `threshold` to children `left` and left + 1 (leaves point at themselves), or adds `value`."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: every tree goes down one level at a time, for all rows together."""
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                step = x[row, self.feature[node]] > self.threshold[node]
                node = self.left[node] + step
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _best_splits(bins: np.ndarray, node: np.ndarray, n: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node the gain, feature and last bin of its left side, from histograms of first and second derivatives; and the nodes' sums."""
    features = bins.shape[1]
    at = ((node[:, None] * features + np.arange(features)) * BINS + bins).ravel()
    hist = [np.bincount(at, np.repeat(w, features), n * features * BINS).reshape(n, features, BINS) for w in (g, h)]
    left_g, left_h = (np.cumsum(x, 2)[:, :, :-1] for x in hist)
    all_g, all_h = (x[:, 0].sum(1) for x in hist)
    right_g, right_h = all_g[:, None, None] - left_g, all_h[:, None, None] - left_h
    gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - (all_g**2 / (all_h + PENALTY))[:, None, None]
    gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = -np.inf
    flat = gain.reshape(n, -1)
    best = flat.argmax(1)
    return flat[np.arange(n), best], best // (BINS - 1), best % (BINS - 1), all_g, all_h


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Gradient boosting of the logistic loss; values are binned once at their quantiles, trees grow level by level."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    feature, threshold, left, value, roots = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        place = np.full(len(y), len(feature))
        roots.append(len(feature))
        level = [len(feature)]
        feature.append(0), threshold.append(np.inf), left.append(level[0]), value.append(0.0)
        for deep in range(depth + 1):
            of = np.searchsorted(level, place)
            open_rows = np.flatnonzero((of < len(level)) & (np.array(level)[np.minimum(of, len(level) - 1)] == place))
            gain, by, last, all_g, all_h = _best_splits(bins[open_rows], of[open_rows], len(level), g[open_rows], h[open_rows])
            grown = []
            for k, node in enumerate(level):
                value[node] = rate * all_g[k] / (all_h[k] + PENALTY)
                if deep < depth and gain[k] > 1e-6 and last[k] < len(edges[by[k]]):
                    feature[node], threshold[node], left[node] = int(by[k]), float(edges[by[k]][last[k]]), len(feature)
                    rows = open_rows[of[open_rows] == k]
                    place[rows] = len(feature) + (bins[rows, by[k]] > last[k])
                    for child in (len(feature), len(feature) + 1):
                        grown.append(child)
                    for _side in range(2):
                        feature.append(0), threshold.append(np.inf), left.append(len(left)), value.append(0.0)
            level = grown
            if not level:
                break
        score += np.array(value)[place]
    return Trees(base, np.array(roots), np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(value), depth)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("_t"))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(x[:, k]) for k in range(len(STATISTICS)))], names=["quality", *STATISTICS])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> DataFrame:
    """quality and statistics of the documents of at most `limit` labels, the first by hash of their id; held-out and null ids and labels other than 0 and 1 are left out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = usable.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    return texts.join(F.broadcast(chosen), "doc_id").select("quality", "_t").mapInArrow(_statistics, "quality int, " + ", ".join(f"{k} float" for k in STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> Trees:
    """Trees of the labelled sample; without labels a single even guess, with one label only that one."""
    table = labelled_sample(docs, labels, limit).toArrow()
    x = np.stack([table.column(k).to_numpy() for k in STATISTICS], 1) if table.num_rows else np.zeros((0, len(STATISTICS)), np.float32)
    y = table.column("quality").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the order of the rows decides nothing
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Trees(float(np.log(share / (1 - share))), *(np.zeros(0, t) for t in (int, int, np.float32, int, float)), 0)
    return boost(x[order], y[order])


def _score(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.scores(statistics(batch.column("_t"))))], names=["doc_id", "score"])


def quality_scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, the probability (0 to 1) that the document is good, and whether that is a half or more.

    Only the text is read. Defined results: null and empty texts have statistics
    of zero and get the score of those; null ids and repeated rows give one row
    each; other columns are ignored; an empty table gives an empty result. Texts
    of any length are taken whole, half a megabyte of texts or one text at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    scored = rows.mapInArrow(partial(_score, trees=trees), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
