"""Lexical retrieval packing: token sequences filled with each seed's BM25 neighbours."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm._arrays import mix, slices
from veridex.llm._spark import Scratch
from veridex.llm.quality import ranks

WINDOW = 2048
END_ID = 1
#: Documents of one shard of the inverted index.
SHARD = 512
#: Bits of a sequence id that number the sequences of one task.
_TASK_BITS = 40
K1, B = 1.2, 0.75
TAILS = "_d long, _n boolean, doc_tokens long, start long, ids binary, near long, full_crc array<long>"


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def codec(vocabulary: str):
    """The tokenizers file as its library loads it (added tokens in a text are single ids), in the faster form of its ranks, which lie beside it."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary.removesuffix(".json") + ".tiktoken"), special_tokens=added)


def _near(ids: np.ndarray) -> int:
    """A min-hash of the tokens: lexically close texts often have the same, and so sort next to each other."""
    return int(mix(np.unique(ids).astype(np.uint64) + np.uint64(11)).min() >> np.uint64(1)) if len(ids) else 0


def _tokenise(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int) -> Iterator[pa.RecordBatch]:
    encode = codec(vocabulary).encode_to_numpy
    schema = pa.schema([("_d", pa.int64()), ("_n", pa.bool_()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("near", pa.int64()), ("full_crc", pa.list_(pa.int64()))])
    for batch in batches:
        doc = batch.column("doc_id")
        for part in slices(batch.column("_t")):
            rows = []
            for i in range(len(part.lo)):
                text = part.text(i).decode("utf-8", "replace")
                ids = np.append(encode(text, allowed_special="all"), END_ID).astype("<u4")
                whole = len(ids) // window
                crcs = [zlib.crc32(ids[k * window : (k + 1) * window]) for k in range(whole)]
                tail = ids[whole * window :]
                at = doc[part.first + i].as_py()
                rows.append((at or 0, at is None, len(ids), whole * window, tail.astype("<u2" if int(ids.max()) < 65536 else "<u4").tobytes(), _near(tail), crcs))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Shard:
    """An inverted index over one shard's pieces: for each token the pieces that hold it, with their BM25 weight."""

    def __init__(self, pieces: list[np.ndarray]):
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        key = np.concatenate(pieces).astype(np.int64) * n + np.repeat(np.arange(n), size)
        key, tf = np.unique(key, return_counts=True)
        token, self.piece = key // n, key % n
        self.token, first, df = np.unique(token, return_index=True, return_counts=True)
        self.first = np.append(first, len(key))
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)  # a token of most pieces tells nothing
        norm = K1 * (1 - B + B * size / max(size.mean(), 1))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.piece])
        self.useful = idf > 0
        self.n = n

    def scores(self, seed: np.ndarray) -> np.ndarray:
        """BM25 of every piece for the seed's distinct tokens."""
        at = np.searchsorted(self.token, np.unique(seed))
        at = at[self.useful[at]]
        lo, n = self.first[at], self.first[at + 1] - self.first[at]
        place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.piece[place], self.weight[place], self.n)


Piece = tuple[int, bool, int, int, np.ndarray]  # doc, its id is null, doc_tokens, start, ids


def pack_shard(pieces: list[Piece], window: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and what is left over when no more can be filled; with `last` that is packed too.

    The longest unused piece seeds a sequence; its neighbours follow by score
    (then by order in the shard), the last one cut to fill the window, and what
    is cut off stays a candidate.
    """
    if not pieces:
        return [], []
    index = Shard([p[4] for p in pieces])
    left = sum(len(p[4]) for p in pieces)
    free = np.ones(len(pieces), bool)
    order = sorted(range(len(pieces)), key=lambda i: (-len(pieces[i][4]), i))
    out: list[list[Piece]] = []
    for seed in order:
        if not free[seed]:
            continue
        if left < window and not last:
            break
        row, room = [pieces[seed]], window - len(pieces[seed][4])
        free[seed] = False
        if room and free.any():
            scores = np.where(free, index.scores(pieces[seed][4]), -1.0)
            for k in np.argsort(-scores, kind="stable"):
                if not room or scores[k] < 0:
                    break
                doc, null, total, start, ids = pieces[k]
                if len(ids) <= room:
                    row.append(pieces[k])
                    free[k] = False
                else:
                    row.append((doc, null, total, start, ids[:room]))
                    pieces[k] = (doc, null, total, start + room, ids[room:])
                room -= len(row[-1][4])
        left -= window - room
        out.append(row)
    return out, [p for p, f in zip(pieces, free, strict=True) if f]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], window: int, shard: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << _TASK_BITS
    waiting: list[Piece] = []

    def emit(sequences: list[list[Piece]]) -> pa.RecordBatch:
        nonlocal number
        rows = []
        for row in sequences:
            offset = 0
            for doc, null, total, start, ids in row:
                rows.append((None if null else doc, start, len(ids), zlib.crc32(ids.astype("<u4")), total, number, offset))
                offset += len(ids)
            number += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 7)], names=names)

    for batch in batches:
        doc, null, total, start, ids, crcs = (batch.column(k).to_pylist() for k in ("_d", "_n", "doc_tokens", "start", "ids", "full_crc"))
        whole = []
        for i in range(len(doc)):
            for k, crc in enumerate(crcs[i]):
                whole.append((None if null[i] else doc[i], k * window, window, crc, total[i], number, 0))
                number += 1
            if ids[i]:
                kind = "<u2" if len(ids[i]) == 2 * (total[i] - start[i]) else "<u4"
                waiting.append((doc[i], null[i], total[i], start[i], np.frombuffer(ids[i], kind)))
            if len(waiting) >= shard:
                full, waiting = pack_shard(waiting, window, False)
                yield emit(full)
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*whole, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    full, waiting = pack_shard(waiting, window, True)
    yield emit(full)


def retrieval_packing(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """A row per piece of a document: where its ids lie in the document and in a sequence of at most `window` ids.

    A document's ids are those of the byte-level vocabulary (its added token
    <|endoftext|> in a text is one id), then id 1. Whole
    windows of a document are sequences of their own. The rest of each document
    is dealt to tasks by a range of its tokens' min-hash, so that lexically close
    texts meet; there, shards of `shard` pieces get an inverted BM25 index, every
    seed draws its unused neighbours in order of score, and the last is cut to
    fill the window. What a shard can't fill passes to the next one, so a task
    leaves at most one sequence that isn't full.
    Defined results: a null or empty text has the single id 1; null ids and
    repeated rows are packed one by one; other columns are ignored. An empty
    table gives an empty result. The ranges also split on doc_id, so no group of
    copies gathers in one task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    tails = rows.mapInArrow(partial(_tokenise, vocabulary=vocabulary or byte_bpe(), window=window), TAILS)
    tails = Scratch(docs.sparkSession, "packing").keep(tails)  # ranges are found by a sample, which must not tokenise again
    dealt = tails.repartitionByRange("near", "_d", "start").sortWithinPartitions("near", "_d", "start", "ids")
    return dealt.mapInArrow(partial(_pack, window=window, shard=shard), PIECES)
