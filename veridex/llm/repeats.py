"""Exact removal of long repeated passages: suffix-array dedup over bytes and substring dedup over words.

Both operators look for windows of fixed length (400 bytes; 50 words) that
start more than once in the corpus. Writing out every window (or suffix)
would multiply the corpus by eight and more, so windows are first bucketed by
an anchor that their own content chooses (the least-hashed short substring
inside, see `_arrays.window_runs`). Equal windows always meet in one bucket.
Then:

1. the anchor's hash is the first key: buckets with a single member hold no repeat;
2. members that agree on all that a run of neighbouring windows covers settle
   every window of the run at once;
3. runs that differ somewhere (the ends of a passage, an edited word) although
   their anchor agrees are cut into blocks of neighbouring windows, placed
   relative to the anchor: a block is dropped if what all its windows share is
   unique, and settled if all that its windows cover agrees;
4. what is left of such blocks is compared window by window.

Substring dedup counts the hash of what a block shares, or of a window, at once.
Suffix-array dedup sorts instead: the suffixes that start a block's windows, and
then every single suffix, go through most-significant-digit passes. A digit is
the next third of the depth, each pass splits the groups of the one before by it
and drops suffixes that are alone, and the groups that are left at full depth
are the repeated windows. No pass looks deeper than the threshold, and none
orders groups among themselves, which no result needs.

Hash keys are compared only inside a bucket, that is on 128 bits together.
No bucket is ever gathered: each pass is a partially aggregated count and an
equi-join, whose hot keys adaptive execution can split. Of members that agree
only one goes on to the next pass; where the first document keeps its passage,
all members of that document do, as agreeing settles none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm._arrays import BYTE_VALUE, SLICE_BYTES, Rolling, Slice, mix, signed, slices, window_runs, word_hashes, words
from veridex.llm._spark import Scratch, keyed

ROWS = "_d long, _h int, bucket long, content long, anchor int, first int, last int"
#: Windows to a block in pass 3.
BLOCK = 16
Symbols = Callable[[Slice], tuple[np.ndarray, np.ndarray, np.ndarray]]


def byte_symbols(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return BYTE_VALUE[part.data], part.lo, part.hi


def word_symbols(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = words(part)
    return word_hashes(part.data, found), found.lo, found.hi


def _owner(lo: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The text that each position belongs to; texts without symbols own none."""
    some = np.flatnonzero(n)
    return some[np.searchsorted(lo[some], first, "right") - 1]


def _rows(d: np.ndarray, h: np.ndarray, bucket: np.ndarray, content: np.ndarray, *places: np.ndarray, digits: tuple[np.ndarray, ...] = ()) -> pa.RecordBatch:
    columns = [d, h, signed(bucket), signed(content), *(x.astype(np.int32) for x in places), *map(signed, digits)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["_d", "_h", "bucket", "content", "anchor", "first", "last", *(f"digit{k}" for k in range(len(digits)))])


def _scan(batches: Iterator[pa.RecordBatch], symbols: Symbols, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("_d", "_h"))
        for part in slices(batch.column("_t")):
            values, lo, hi = symbols(part)
            runs = window_runs(Rolling(values), lo, hi, length, gram)
            if len(runs.first):
                own = _owner(lo, runs.first, hi - lo)
                yield _rows(d[part.first + own], h[part.first + own], runs.gram, runs.content, *(x - lo[own] for x in (runs.anchor, runs.first, runs.last)))


def _expand(batches: Iterator[pa.RecordBatch], symbols: Symbols, length: int, block: int, depths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The blocks of the runs that are asked about: windows whose distance to the anchor has the same quotient by `block`.

    `digit0`, ... name the group of the block's last window, as a suffix, at each of the depths before the full one.
    """
    for batch in batches:
        d, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("_d", "_h"))
        asked = batch.column("runs")
        at, flat = asked.offsets.to_numpy(), asked.values
        bucket, anchor, first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("bucket", "anchor", "first", "last"))
        for part in slices(batch.column("_t"), SLICE_BYTES // (2 if block == 1 else 1)):
            values, lo, hi = symbols(part)
            rolling = Rolling(values)
            k = slice(at[part.first], at[part.first + len(lo)])
            text = np.repeat(np.arange(len(lo)), np.diff(at[part.first : part.first + len(lo) + 1]))
            low, high = (anchor[k] - last[k]) // block, (anchor[k] - first[k]) // block
            n = high - low + 1
            run = np.repeat(np.arange(len(n)), n)
            number = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            text, where = text[run], anchor[k][run]
            end = where - number * block  # the last window start of the whole block, in the text
            start = end - block + 1
            base = lo[text]
            core = rolling.hash(base + end, base + start + length)
            whole = (start >= 0) & (end + length <= hi[text] - base)
            content = mix(rolling.hash(base + np.where(whole, start, end), base + end + np.where(whole, length, 1)) + np.uint64(1))
            alone = mix(mix(d[part.first + text].view(np.uint64)) ^ mix(h[part.first + text].astype(np.int64).view(np.uint64)) ^ (end + 7).astype(np.uint64))
            name = lambda x: mix(mix(x + number.astype(np.uint64)) ^ bucket[k][run].view(np.uint64))  # noqa: E731, B023
            digits = tuple(name(rolling.hash(base + end, base + end + depth)) for depth in depths)
            yield _rows(d[part.first + text], h[part.first + text], name(core), np.where(whole, content, alone), where, np.maximum(start, first[k][run]), np.minimum(end, last[k][run]), digits=digits)


class _Passes:
    """The passes; `later_only` as in repeated_spans."""

    def __init__(self, scratch: Scratch, later_only: bool):
        self.scratch = scratch
        self.later_only = later_only
        self.shared = "low < high" if later_only else "n > 1"
        self.kinds = "low < high" if later_only else "kinds > 1"
        self.goes = "_d > least" if later_only else "true"

    def settle(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Spans that agree with another member of their bucket, and of each kind of member in buckets with several kinds one, or with later_only all that stay open."""
        shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("_d").alias("low"), F.max("_d").alias("high")).where(self.shared)
        shared = self.scratch.keep(shared.select("bucket"))  # a plain table on each side lets hot buckets be split
        members = self.scratch.keep(rows.join(shared, "bucket"))
        one = F.min(F.struct("_d", "_h", "anchor", "first", "last")).alias("one")
        kinds = self.scratch.keep(members.groupBy("bucket", "content").agg(F.count("*").alias("n"), one))
        mixed = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("one._d").alias("low"), F.max("one._d").alias("high")).where(self.kinds)
        equal = kinds.where("n > 1").select("bucket", "content", F.col("one._d").alias("least"))
        spans = members.join(equal, ["bucket", "content"]).where(self.goes).select("_d", "_h", "first", "last")
        mixed = self.scratch.keep(mixed.select("bucket"))
        some = kinds.join(mixed, "bucket")
        if not self.later_only:
            return spans, some.select("one.*", "bucket")
        several = self.scratch.keep(some.where("n > 1").select("bucket", "content", F.col("one._d").alias("least")))
        first = members.join(several, ["bucket", "content"]).where("_d = least").select("_d", "_h", "anchor", "first", "last", "bucket").distinct()
        return spans, some.where("n = 1").select("one.*", "bucket").unionByName(first)

    def refine(self, rows: DataFrame) -> DataFrame:
        """The radix passes before the last digit: suffixes that are alone in their group at some depth go."""
        for digit in [c for c in rows.columns if c.startswith("digit")]:
            shared = rows.groupBy(digit).agg(F.count("*").alias("n")).where("n > 1").select(digit)
            after = self.scratch.keep(rows.join(self.scratch.keep(shared), digit).drop(digit))
            self.scratch.drop(rows)
            rows = after
        return rows

    def last(self, rows: DataFrame) -> DataFrame:
        """The same for single windows, where nothing stays open."""
        agg = (F.count("*").alias("n"), F.min("_d").alias("least"), F.min("_d").alias("low"), F.max("_d").alias("high"))
        equal = rows.groupBy("bucket", "content").agg(*agg).where(self.shared).select("bucket", "content", "least")
        return rows.join(self.scratch.keep(equal), ["bucket", "content"]).where(self.goes).select("_d", "_h", "first", "last")


def repeated_spans(docs: DataFrame, scratch: Scratch, symbols: Symbols, length: int, gram: int, later_only: bool, digit: int) -> DataFrame:
    """(_d, _h, spans: array of (first, last) window starts to remove) of texts that have any.

    later_only: a window goes if it also starts in a text of smaller id;
    otherwise if it starts anywhere else as well. digit: symbols to a digit of
    the radix passes.
    """
    passes = _Passes(scratch, later_only)
    texts = docs.select("_d", "_h", "_t")
    block = min(BLOCK, length // 4)

    def asked(texts: DataFrame, runs: DataFrame) -> DataFrame:
        by_text = runs.groupBy("_d", "_h").agg(F.collect_list(F.struct("bucket", "anchor", "first", "last")).alias("runs"))
        return texts.join(by_text, ["_d", "_h"]).select("_d", "_h", "_t", "runs")

    def expand(asked: DataFrame, block: int) -> DataFrame:
        depths = tuple(range(digit, length - block, digit))
        schema = ", ".join([ROWS, *(f"digit{k} long" for k in range(len(depths)))])
        return passes.refine(scratch.keep(asked.mapInArrow(partial(_expand, symbols=symbols, length=length, block=block, depths=depths), schema)))

    rows = scratch.keep(texts.mapInArrow(partial(_scan, symbols=symbols, length=length, gram=gram), ROWS))
    spans, some = passes.settle(rows)
    scratch.drop(rows)
    texts = scratch.keep(asked(texts, some))
    rows = expand(texts, block)
    more, some = passes.settle(rows)
    scratch.drop(rows)
    rows = expand(asked(texts.drop("runs"), some), 1)
    spans = spans.unionByName(more).unionByName(passes.last(rows))
    return spans.groupBy("_d", "_h").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def covered(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches [start, end) that windows starting in [first, last] cover."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    start, end = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + length)
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    return start[head], end[np.append(np.flatnonzero(head)[1:], len(start)) - 1]


Cut = Callable[[bytes, np.ndarray, np.ndarray], tuple[int, int, int, bytes]]


def _cut_bytes(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, bytes]:
    keep, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        keep.append(text[at:s])
        at = e
    keep.append(text[at:])
    return len(text), int((end - start).sum()), len(start), b"".join(keep)


def _cut_words(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, bytes]:
    own, keep, at = text.split(), [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        keep += own[at:s]
        at = e
    return len(own), int((end - start).sum()), len(start), b" ".join(keep + own[at:])


OUT = "doc_id long, n_all long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>"


def _apply(batches: Iterator[pa.RecordBatch], cut: Cut, length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_all", "n_removed", "n_spans")), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    for batch in batches:
        ids, spans = batch.column("doc_id"), batch.column("spans")
        at, first, last = spans.offsets.to_numpy(), *(spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
        known = spans.is_valid().to_numpy(zero_copy_only=False)
        for part in slices(batch.column("_t")):
            rows = []
            for i in range(len(part.lo)):
                r = part.first + i
                own = slice(at[r], at[r + 1]) if known[r] else slice(0, 0)
                start, end = covered(first[own], last[own], length)
                n, gone, k, kept = cut(part.text(i), start, end)
                rows.append((n, gone, k, hashlib.sha256(kept).hexdigest().encode() if digest else kept, start, end))
            yield pa.RecordBatch.from_arrays([ids.slice(part.first, len(rows)), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)


def remove_repeats(docs: DataFrame, unit: str, length: int, gram: int, later_only: bool, digit: int, digest: bool = False) -> DataFrame:
    """Remove every symbol that a repeated window covers.

    Returns a row per input row: doc_id, n_all (symbols), n_removed, n_spans
    (maximal removed runs), kept (remaining text as UTF-8, or the lowercase hex
    of its SHA-256 where `digest` is set) and the runs' starts and ends.
    unit: "byte" or "word" (maximal runs of other characters than space and
    \\x09-\\x0D; kept words are joined by one space).
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = keyed(docs)
    symbols, cut = (byte_symbols, _cut_bytes) if unit == "byte" else (word_symbols, _cut_words)
    spans = repeated_spans(rows, scratch, symbols, length, gram, later_only, digit)
    return rows.join(spans, ["_d", "_h"], "left").select("doc_id", "_t", "spans").mapInArrow(partial(_apply, cut=cut, length=length, digest=digest), OUT)


def suffix_array_dedup(docs: DataFrame, threshold: int = 400, digest: bool = False) -> DataFrame:
    """Remove each byte covered by a `threshold`-byte string that also starts anywhere else, same document included.

    Depth-limited: suffixes are told apart only through their first `threshold`
    bytes, a third of them at a time (see the module's text). Defined results: null text is empty; texts shorter than the threshold
    keep everything; exact copies and repeated rows lose all their bytes (each is
    the other's repeat); rows that repeat a doc_id with other texts count apart;
    rows with a null doc_id are matched like others; other columns are ignored.
    An empty table gives an empty result.
    """
    return remove_repeats(docs, "byte", threshold, min(128, max(1, threshold // 3)), False, max(1, -(-threshold // 3)), digest)


def substring_dedup(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """Remove each word covered by a `window`-word sequence that also starts in a document of smaller doc_id.

    The first document that holds a passage keeps it. Defined results: null text
    has no words; texts shorter than the window keep everything; rows with equal
    doc_id never remove from each other; a null doc_id counts as larger than all
    others; other columns are ignored. An empty table gives an empty result.
    """
    return remove_repeats(docs, "word", window, min(16, max(1, window // 3)), True, window, digest)
