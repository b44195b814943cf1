"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often each pair of ids is linked.

Texts are cut before every space that follows another character than white
space. No token of either vocabulary reaches over such a cut, so a text's tokens
are those of its chunks, and a batch tokenises and aligns each distinct chunk
once. Inside a batch DuckDB holds both sides as interval tables: window sums
number the groups, an ASOF join finds the token that covers each token's start,
a range join those that start inside it. What batches count is summed in Spark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm._spark import Scratch
from veridex.llm.packing import byte_bpe
from veridex.llm.quality import default_pieces, encoding, piece_model

#: Characters of text that one batch aligns; a longer text is a batch of its own.
BATCH_CHARS = 4 << 20
#: Characters of distinct chunks that the tokenisers take at a time.
CALL_CHARS = 1 << 16
#: Bits of a batch's number that number the batches of one task.
_TASK_BITS = 32
SPACE_MARK = "▁"
CUT = re.compile(r"(?<=\S)(?= )")
ODD_CUT = re.compile(r"\s ")

#: Window sums number the groups: one begins where tokens of both sides begin.
GROUPS = """create or replace temp table {mine} as select i, lo, hi, id, head, sum(head::int) over (order by i rows unbounded preceding) - 1 as grp
    from (select m.*, o.lo is not null as head from {mine}_tokens m left join (select lo from {other}_tokens) o on m.lo = o.lo)"""
#: Every A token with the B token that covers its start, and every B token that starts inside an A token with that one.
LINKS = """create or replace temp table links as
    select a.id as a, b.id as b, a.lo as lo from a asof join b on a.lo >= b.lo
    union all
    select a.id, b.id, b.lo from a join (select id, lo from b where not head) b on b.lo > a.lo and b.lo < a.hi"""
PAIRS = "create or replace temp table pairs as select a, b, row_number() over (order by n desc, a, b) - 1 as pair from (select a, b, count(*) as n from links group by a, b)"


@cache
def byte_tables(a_file: str, b_file: str) -> tuple[list[bytes], list[bytes]]:
    """The bytes of every id of both vocabularies."""
    ranks = encoding(_ranks_file(a_file))._mergeable_ranks
    a = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        a[i] = token
    model, is_byte = piece_model(b_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    b = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE_MARK, " ").encode() for p, byte in zip(pieces, is_byte, strict=True)]
    if any(re.search(rf"[^\s{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces) or any(re.search(r"\S ", x.decode("utf-8", "replace")) for x in a):
        raise ValueError("a token reaches over a word's end")
    return a, b


def _ranks_file(a_file: str) -> str:
    """The ranks that lie beside a tokenizers file: the same vocabulary, in a form that is faster to apply."""
    return a_file.removesuffix(".json") + ".tiktoken"


def chunks(text: str) -> list[str]:
    """The chunks of space + text, each without the space that it begins with."""
    if ODD_CUT.search(f" {text}"):
        return [c[1:] for c in CUT.split(f" {text}")]
    return text.split(" ")


class Tokens:
    """Interval tables of both tokenisations of distinct chunks, and which chunks neither side changes; others have no tokens."""

    def __init__(self, found: list[str], a_file: str, b_file: str):
        encode, model = encoding(_ranks_file(a_file)).encode_ordinary, piece_model(b_file)[0]
        self.raw = [f" {c}".encode() for c in found]
        sizes = np.array([len(r) for r in self.raw], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.whole = np.ones(len(found), bool)
        self.calls = list(self._calls(found))
        a_bytes, b_bytes = byte_tables(a_file, b_file)
        sides = [
            self._side(found, a_bytes, lambda part: encode(f" {part}")),
            self._side(found, b_bytes, lambda part: model.encode(part, num_threads=1) if part else [model.piece_to_id(SPACE_MARK)]),
        ]
        self.a, self.b = (self._table(*side) for side in sides)

    def _calls(self, found: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches of chunks that are tokenised in one call: those that end in white space stand alone."""
        first, size = 0, 0
        for i, c in enumerate(found):
            alone = not c or c[-1].isspace()
            if i > first and (alone or size + len(c) > CALL_CHARS):
                yield first, i
                first, size = i, 0
            size += len(c) + 1
            if alone:
                yield first, i + 1
                first, size = i + 1, 0
        if first < len(found):
            yield first, len(found)

    def _side(self, found: list[str], table: list[bytes], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id, start and end of every token, by chunks where a call's tokens don't have its bytes; chunks whose own don't are marked."""
        sizes = np.array([len(x) for x in table], np.int64)
        made = []

        def add(first: int, end: int) -> bool:
            ids = encode(" ".join(found[first:end]))
            same = b"".join([table[i] for i in ids]) == b"".join(self.raw[first:end])
            if same:
                ids = np.array(ids, np.int64)
                hi = self.starts[first] + np.cumsum(sizes[ids])
                made.append((ids, hi - sizes[ids], hi))
            return same

        for first, end in self.calls:
            if not add(first, end):
                for c in range(first, end):
                    self.whole[c] &= add(c, c + 1)
        return tuple(np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int64) for k in range(3))

    def _table(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
        if not self.whole.all():
            good = self.whole[np.searchsorted(self.starts, lo, "right") - 1]
            ids, lo, hi = ids[good], lo[good], hi[good]
        return pa.table({"i": np.arange(len(ids)), "lo": lo, "hi": hi, "id": ids})


@dataclass
class Aligned:
    """What is known of each distinct chunk: counts, its groups as text, and its links as numbers of pairs [ptr[c], ptr[c + 1])."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    ptr: np.ndarray
    pair: np.ndarray
    pair_a: np.ndarray
    pair_b: np.ndarray


def _group_texts(a: dict, b: dict, a_at: np.ndarray, b_at: np.ndarray, n: int) -> list[str]:
    """Per chunk its groups `a1,a2|b1` joined by ;, from the ids in order and their groups."""
    na, nb = len(a["id"]), len(b["id"])
    total = int(a["grp"][-1]) + 1 if na else 0
    of_a, of_b = np.bincount(a["grp"], minlength=total), np.bincount(b["grp"], minlength=total)
    before_a, before_b = np.concatenate([[0], np.cumsum(of_a)]), np.concatenate([[0], np.cumsum(of_b)])
    texts = np.empty(na + nb, object)
    last_a = np.arange(na) == before_a[a["grp"] + 1] - 1
    last_b = np.arange(nb) == before_b[b["grp"] + 1] - 1
    texts[np.arange(na) + before_b[a["grp"]]] = [f"{i}|" if end else f"{i}," for i, end in zip(a["id"].tolist(), last_a.tolist(), strict=True)]
    texts[np.arange(nb) + before_a[b["grp"] + 1]] = [f"{i};" if end else f"{i}," for i, end in zip(b["id"].tolist(), last_b.tolist(), strict=True)]
    cut = (a_at + b_at).tolist()
    pieces = texts.tolist()
    return ["".join(pieces[cut[c] : cut[c + 1]])[:-1] for c in range(n)]


def align(found: list[str], a_file: str, b_file: str) -> Aligned:
    """Groups and links of distinct chunks."""
    import duckdb

    tokens, n = Tokens(found, a_file, b_file), len(found)
    with duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"}) as con:
        con.register("a_tokens", tokens.a)
        con.register("b_tokens", tokens.b)
        for mine, other in ("ab", "ba"):
            con.execute(GROUPS.format(mine=mine, other=other))
        con.execute(LINKS)
        con.execute(PAIRS)
        sides = [con.execute(f"select id, grp::bigint as grp, lo from {k} order by i").fetchnumpy() for k in "ab"]
        links = con.execute("select lo, pair from links join pairs using (a, b)").fetchnumpy()
        pairs = con.execute("select a, b from pairs order by pair").fetchnumpy()
    a, b = ({k: np.asarray(v) for k, v in x.items()} for x in sides)
    edge = np.append(tokens.starts, np.iinfo(np.int64).max)
    a_at, b_at = np.searchsorted(a["lo"], edge), np.searchsorted(b["lo"], edge)
    heads = np.concatenate([[0], np.cumsum(np.diff(a["grp"], prepend=-1))]) if len(a["grp"]) else np.zeros(1, np.int64)
    order = np.argsort(links["lo"], kind="stable")
    return Aligned(
        tokens.whole, np.diff(a_at), np.diff(b_at), np.diff(heads[a_at]), _group_texts(a, b, a_at, b_at, n),
        np.searchsorted(np.asarray(links["lo"])[order], edge), np.asarray(links["pair"])[order].astype(np.int64), np.asarray(pairs["a"]), np.asarray(pairs["b"]),
    )


BATCH = "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"
_LONGS = pa.list_(pa.int64())
_BATCH = pa.schema([("batch", pa.int64()), *((k, _LONGS) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.list_(pa.string())), ("links", pa.binary()), ("pair_a", pa.list_(pa.int32())), ("pair_b", pa.list_(pa.int32())), ("pair_n", _LONGS)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])


def _aligned_batch(number: int, ids: list[int | None], texts: list[str], a_file: str, b_file: str) -> pa.RecordBatch:
    codes: dict[str, int] = {}
    of_text: dict[str, np.ndarray] = {}
    for t in texts:
        if t and t not in of_text:
            of_text[t] = np.array([codes.setdefault(c, len(codes)) for c in chunks(t)], np.int64)
    made = align(list(codes), a_file, b_file)
    pair_n = np.zeros(len(made.pair_a), np.int64)
    done: dict[str, tuple] = {"": (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))}
    rows = []
    n_links = np.diff(made.ptr)
    for t in texts:
        if t not in done:
            c = of_text[t]
            if made.whole[c].all():
                links = np.bincount(made.pair[_ranges(made.ptr[c], n_links[c])])
                has = np.flatnonzero(links)
                sha = hashlib.sha256(";".join([made.groups[x] for x in c]).encode()).hexdigest()
                done[t] = (int(made.n_a[c].sum()), int(made.n_b[c].sum()), int(made.n_groups[c].sum()), int(n_links[c].sum()), sha, has, links[has])
            else:
                done[t] = done[""]
        rows.append(done[t])
        pair_n[done[t][5]] += done[t][6]
    lists = [np.array([len(r[5]) for r in rows], np.int32), np.concatenate([np.diff(r[5], prepend=0) for r in rows]).astype(np.int32), np.concatenate([r[6] for r in rows]).astype(np.int32)]
    blob = zstandard.compress(b"".join(x.tobytes() for x in lists), 3)
    columns = [ids, *([r[k] for r in rows] for k in range(5))]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([number, *columns, blob, made.pair_a, made.pair_b, pair_n], _BATCH, strict=True)], schema=_BATCH)


def _align_batches(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str, batch_chars: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << _TASK_BITS
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("_t").to_pylist(), strict=True):
            if texts and size + len(t) > batch_chars:
                yield _aligned_batch(number, ids, texts, a_file, b_file)
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield _aligned_batch(number, ids, texts, a_file, b_file)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OUT = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in OUT.split(", ")])


def _scored(key: tuple, batch: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one batch, their links scored by the counts of the corpus."""
    if not batch.num_rows:
        return _OUT.empty_table()
    row = batch.to_pylist()[0]
    at = pairs.column("pair").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    count[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    flat = np.frombuffer(zstandard.decompress(row["links"]), np.int32).astype(np.int64)
    docs = len(row["doc_id"])
    sizes = flat[:docs]
    steps, times = np.split(flat[docs:], 2)
    n_best, count_sum, first = [], [], 0
    for k in sizes.tolist():
        pair, t = np.cumsum(steps[first : first + k]), times[first : first + k]
        n_best.append(int(t[best[pair]].sum()))
        count_sum.append(int((t * count[pair]).sum()))
        first += k
    made = {k: row[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": n_best, "count_sum": count_sum}
    return pa.table([pa.array(made[f.name], f.type) for f in _OUT], schema=_OUT)


def align_batches(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per batch of documents: per document the counts, per batch its id pairs (a, b, times linked), and which pairs each document links how often."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    return rows.mapInArrow(partial(_align_batches, a_file=a_file or byte_bpe(), b_file=b_file or default_pieces(), batch_chars=batch_chars), BATCH)


def batch_pairs(batches: DataFrame) -> DataFrame:
    """(batch, pair, a, b, n): the id pairs of every batch by their number there."""
    zipped = F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("pair", "_p")
    return batches.select("batch", zipped).select("batch", "pair", F.col("_p.pair_a").alias("a"), F.col("_p.pair_b").alias("b"), F.col("_p.pair_n").alias("n"))


def pair_counts(batches: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold an id pair."""
    return batch_pairs(batches).groupBy("a", "b").agg(F.sum("n").alias("n"))


def token_alignment(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """A row per document: tokens of both vocabularies, groups, links, how they score by the corpus's pair counts, and the groups' digest.

    Defined results: null and empty texts have no tokens, and neither has a text
    that a vocabulary changes (its tokens' bytes aren't space + text): zeros and
    an empty digest; null ids and repeated rows give one row each, and repeated
    rows count again; other columns are ignored; an empty table gives an empty
    result. One batch of texts is in work at a time, a long text being a batch of
    its own. Pair counts move once per batch and pair, never per document.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    batches = scratch.keep(align_batches(docs, a_file, b_file, batch_chars))
    counts = scratch.keep(pair_counts(batches))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of the second vocabulary, so it may be broadcast
    scored = counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    back = batch_pairs(batches).drop("n").join(scored, ["a", "b"]).select(F.col("batch").alias("of"), "pair", "n", "best")
    kept = batches.drop("pair_a", "pair_b", "pair_n")
    return kept.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(_scored, OUT)
