"""Secret scans: fixed patterns plus sliding-window Shannon entropy with allow-list suppression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
CUES = ("passw", "secret", "token", "api")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")

#: Characters of a class, window length and least bits a character; the first class that holds all characters of a candidate counts.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+\Z"), 20, 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]+\Z"), 20, 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 24, 3.8),
)
LEAST_WINDOW = min(c[2] for c in CLASSES)
#: Candidates, or parts of them between filler, that look random but are public by nature, or filler.
ALLOW = (
    re.compile(r"[0-9+/_=-]+\Z"),  # numbers and rules
    re.compile(r"[A-Za-z+/_=-]+\Z"),  # words, paths and identifiers without a digit
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z"),  # UUIDs
    re.compile(r"(?i)(?:[a-z]+|[0-9]{1,4})(?:[/_=-]+(?:[a-z]+|[0-9]{1,4}))*\Z"),  # slugs and dated names
)
#: Filler: no window over it counts, but what stands beside it does.
FILLER = re.compile(r"(?i)example|placeholder|changeme|your[_-]|dummy|sample|xxxx+|0123456789|abcdefgh")
_PLOG = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def high_entropy(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged windows whose Shannon entropy is at least `bits`; counts move by one character in and one out."""
    if len(text) < window:
        return []
    counts: dict[str, int] = {}
    total, found = 0.0, []
    most = window * (math.log2(window) - bits) + 1e-9  # entropy = log2(window) - total / window
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        total += _PLOG[c + 1] - _PLOG[c]
        counts[ch] = c + 1
        if i >= window:
            old = text[i - window]
            c = counts[old]
            total += _PLOG[c - 1] - _PLOG[c]
            counts[old] = c - 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as listed."""
    spans: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(cue in low for cue in CUES):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = list(CANDIDATE.finditer(text))
    for run in runs:
        spans += [("hex", *m.span()) for m in HEX.finditer(text, *run.span())]
    spans += [("entropy", s, e) for s, e in outside(spans, [x for run in runs for x in random_parts(run.group(), run.start())])]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def random_parts(word: str, at: int) -> Iterator[tuple[int, int]]:
    """The merged high-entropy windows of a candidate that starts at `at`: of all that no allow-list entry explains, between filler."""
    cuts = [0, *(x for m in FILLER.finditer(word) for x in m.span()), len(word)]
    for start, end in zip(cuts[::2], cuts[1::2], strict=True):
        part = word[start:end]
        if end - start < LEAST_WINDOW or any(a.match(part) for a in ALLOW):
            continue
        _, _, window, bits = next(c for c in CLASSES if c[1].match(part))
        for s, e in high_entropy(part, window, bits):
            yield at + start + s, at + start + e


def outside(base: list[tuple[str, int, int]], found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans of `found` that no base span holds; both are walked once, by start."""
    ordered, k, reach = sorted((s, e) for _, s, e in base), 0, 0
    for s, e in found:
        while k < len(ordered) and ordered[k][0] <= s:
            reach = max(reach, ordered[k][1])
            k += 1
        if e > reach:
            yield s, e


SPANS = "array<struct<kind:string,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t)] for t in batch.column("_t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _TYPE)], names=["doc_id", "spans"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of likely secrets in every whole text (code points, end exclusive).

    Kinds: assign, access and hex by pattern; entropy by windows over candidate
    strings that are random enough for their character class, unless an
    allow-list entry explains the string, the window touches filler words, or a
    pattern span holds them already.
    Defined results: null and empty texts have no spans; null ids and repeated
    rows pass through, one result row each; other columns are ignored. Only one
    text at a time is in work, in time linear in its length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    return rows.mapInArrow(_scan, f"doc_id long, spans {SPANS}")


def joined(kinds: tuple[str, ...], by_kind: bool = False) -> Column:
    """kind:start:end of the `spans` of these kinds, comma-joined, by start then kind or by kind then start."""
    ranked = F.transform("spans", lambda x: _ranked(x, kinds, by_kind))
    chosen = F.array_sort(F.filter(ranked, lambda x: x["rank"].isNotNull()))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def _ranked(x: Column, kinds: tuple[str, ...], by_kind: bool) -> Column:
    rank = F.lit(None).cast("int")
    for i, kind in enumerate(kinds):
        rank = F.when(x["kind"] == kind, i).otherwise(rank)
    keys = (rank.alias("rank"), x["start"].alias("start")) if by_kind else (x["start"].alias("start"), rank.alias("rank"))
    return F.struct(*keys, x["kind"].alias("kind"), x["end"].alias("end"))

