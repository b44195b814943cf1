"""Quality rules: word and line counts, and how a public tokeniser takes the text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm._arrays import SPACE, Rolling, mix, slices, word_hashes, words
from veridex.llm._spark import Scratch

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_pieces", "n_fallback", "n_chars")
#: What the tokenisers tell of a text, and whether too little and too much of it speak against it.
MEASURES = {"chars_per_token": (True, True), "chars_per_piece": (True, True), "entropy": (True, False), "fallback_share": (False, True)}
#: A band reaches so many robust standard deviations (quartile distance / 1.349, never under a share of the median) below its group's median, and twice as many above.
REACH = 4.0
LEAST_SPREAD = {"chars_per_token": 0.02, "chars_per_piece": 0.02, "entropy": 0.02, "fallback_share": 0.3}
#: A group of fewer documents sets no band.
LEAST_GROUP = 30
#: Up to so many groups (a dozen numbers each) are broadcast; beyond, the join shuffles.
FEW_GROUPS = 10_000
#: The script of a text by the lead bytes of its characters.
SCRIPTS = ("none", "latin", "latin_accented", "greek", "cyrillic", "semitic", "indic", "cjk", "hangul", "other")
_SCRIPT_OF = np.zeros(256, np.uint8)
for _low, _high, _s in ((0x41, 0x5B, 1), (0x61, 0x7B, 1), (0xC3, 0xCE, 2), (0xCE, 0xD0, 3), (0xD0, 0xD5, 4), (0xD6, 0xDC, 5), (0xE0, 0xE1, 6), (0xE1, 0xE3, 9), (0xE3, 0xEA, 7), (0xEA, 0xEE, 8), (0xEE, 0xF8, 9)):
    _SCRIPT_OF[_low:_high] = _s


def ranks(vocabulary: str) -> dict[bytes, int]:
    """The tokens of a ranks file."""
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@cache
def encoding(vocabulary: str):
    """A byte-level vocabulary from its ranks file."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


@cache
def piece_model(path: str):
    """A vocabulary of pieces with byte fallback, and which of its ids are bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    return again


def _repeated_words(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per text, the words that 3-word windows found twice or more in it cover."""
    out = np.zeros(len(lo), np.int64)
    if len(hashes) < 3:
        return out
    n = len(hashes)
    triples = mix(Rolling(hashes).windows(3))
    own = np.repeat(np.arange(len(lo)), hi - lo)
    inside = own[: n - 2] == own[2:]
    key = mix(triples ^ mix(own[: n - 2].astype(np.uint64) + np.uint64(1)))[inside]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(inside)[count[back] > 1]
    word = np.zeros(n, bool)
    for k in range(3):
        word[twice + k] = True
    return np.bincount(own[word], minlength=len(lo))


def _measure(batches: Iterator[pa.RecordBatch], vocabulary: str, pieces: str) -> Iterator[pa.RecordBatch]:
    codec, (model, is_byte) = encoding(vocabulary), piece_model(pieces)
    for batch in batches:
        names = [k for k in batch.schema.names if k != "_t"]
        rest = [batch.column(k) for k in names]
        texts = batch.column("_t") if "_t" in batch.schema.names else batch.column("_row").field("text").fill_null("")
        for part in slices(texts):
            n, found = len(part.lo), words(part)
            head = (part.data & 0xC0) != 0x80
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([part.lo[:1], part.hi])])  # noqa: E731, B023
            made = {
                "n_words": found.hi - found.lo,
                "word_chars": total(head & ~SPACE[part.data]),
                "n_symbols": total(SYMBOLS[part.data]),
                "n_chars": total(head),
                "n_repeat_words": _repeated_words(word_hashes(part.data, found), found.lo, found.hi),
            }
            lines, tokens, fallback, entropy, script, n_pieces = (np.zeros(n, t) for t in (np.int64, np.int64, np.int64, np.float64, np.int64, np.int64))
            for i in range(n):
                raw = part.text(i)
                text = raw.decode("utf-8", "replace")
                ids, parts = codec.encode_to_numpy(text, disallowed_special=()), np.array(model.encode(text, num_threads=1), np.int64)
                lines[i], tokens[i], n_pieces[i], fallback[i] = duplicate_lines(raw), len(ids), len(parts), is_byte[parts].sum()
                if len(ids):
                    share = np.unique(ids, return_counts=True)[1] / len(ids)
                    entropy[i] = float(-(share * np.log2(share)).sum())
                    script[i] = np.argmax(np.bincount(_SCRIPT_OF[part.data[part.lo[i] : part.hi[i]]], minlength=len(SCRIPTS))[1:]) + 1
            made |= {"n_dup_lines": lines, "n_tokens": tokens, "n_pieces": n_pieces, "n_fallback": fallback}
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(part.first, n) for c in rest), *(pa.array(np.asarray(made[k], np.int64)) for k in COUNTS), pa.array(entropy), pa.array([SCRIPTS[s] for s in script])],
                names=[*names, *COUNTS, "entropy", "script"],
            )


def measure(rows: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    """Every count of the text, token entropy (bits) and script, beside the other columns.

    The text is the column _t (without nulls), or the field `text` of _row.
    """
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_t"]
    return rows.mapInArrow(partial(_measure, vocabulary=vocabulary, pieces=pieces), ", ".join([*kept, *(f"{k} long" for k in COUNTS), "entropy double", "script string"]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, reach: float = REACH) -> DataFrame:
    """A row per document: its counts, base_failed, and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated
    3-word windows. The tokenisers' verdict then compares characters per token
    of a byte-level vocabulary and of a piece vocabulary, token entropy and the
    share of byte-fallback pieces with bands. Bands are fitted on all documents
    that pass the base rules, around the median of texts like it: those of its
    language (or script, where that is null) and of its length, as powers of two
    of the token count, since short texts can't have much entropy. A length with
    fewer than LEAST_GROUP documents takes the language's bands, a language with
    fewer rejects nothing. Measures are rounded to 3 places, so that a group has
    a bounded number of values.
    Defined results: null text counts as empty, has no words and fails; null ids
    and repeated rows give one row each; documents without a lang column are
    grouped by script; other columns are ignored. An empty table gives an empty
    result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lang(docs), F.coalesce("text", F.lit("")).alias("_t"))
    return judged(rows, vocabulary, pieces, reach)


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("_lang")


def _bands(stats: DataFrame, keys: list[str], scratch: Scratch, reach: float, prefix: str) -> DataFrame:
    """Least and most of every measure for each group of LEAST_GROUP documents and more."""
    quartiles = stats.where(~F.col("base_failed")).groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile(k, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(k) for k in MEASURES))
    columns = []
    for k, (low, high) in MEASURES.items():
        spread = F.greatest((F.col(k)[2] - F.col(k)[0]) / 1.349, LEAST_SPREAD[k] * F.col(k)[1])
        columns += [(F.col(k)[1] - reach * spread if low else F.lit(float("-inf"))).alias(f"{prefix}least_{k}"), (F.col(k)[1] + 2 * reach * spread if high else F.lit(float("inf"))).alias(f"{prefix}most_{k}")]
    found = scratch.keep(quartiles.where(F.col("n") >= LEAST_GROUP).select(*keys, *columns))
    return F.broadcast(found) if found.count() <= FEW_GROUPS else found


def judged(rows: DataFrame, vocabulary: str | None, pieces: str | None, reach: float) -> DataFrame:
    share = lambda a, b: F.round(F.col(a) / F.greatest(b, F.lit(1)), 3)
    stats = measure(rows, vocabulary or default_vocabulary(), pieces or default_pieces()).withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "group": F.coalesce("_lang", F.concat(F.lit("script:"), "script")),
        "length": F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))),
        "chars_per_token": share("n_chars", "n_tokens"),
        "chars_per_piece": share("n_chars", "n_pieces"),
        "fallback_share": share("n_fallback", "n_pieces"),
        "entropy": F.round("entropy", 3),
    })
    scratch = Scratch(rows.sparkSession, "quality")
    stats = scratch.keep(stats)
    joined = stats.join(_bands(stats, ["group", "length"], scratch, reach, "near_"), ["group", "length"], "left").join(_bands(stats, ["group"], scratch, reach, "all_"), "group", "left")
    inside = F.lit(True)
    for k in MEASURES:
        inside &= F.col(k).between(F.coalesce(f"near_least_{k}", f"all_least_{k}", F.lit(float("-inf"))), F.coalesce(f"near_most_{k}", f"all_most_{k}", F.lit(float("inf"))))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def keep_good(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, reach: float = REACH) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _lang(docs))
    return judged(rows, vocabulary, pieces, reach).where("kept").select("_row.*")
