"""Exact n-gram Jaccard join, answered as components: prefix filtering with set-relation skipping.

Sets are ordered by one global order of shingles (corpus-frequent ones last,
otherwise by hash). Two sets that reach the threshold share a shingle in their
prefixes, so only prefixes are indexed. Skipping works on two levels:

* index level: an entry carries its shingle's position, its set's size and the
  place where the prefix ends. Position and size tell how large a partner may be
  at most. Long lists are kept in blocks by size and by that reach, and an entry
  is joined with the blocks that can hold a partner only: the rest of the list is
  never read. Of the pairs that meet, those whose parity bitmaps differ in more
  bits than the sets may differ in shingles go, and what prefixes share and the
  shorter one's remainder bounds the overlap once more before a set is read.
  Lists whose members are known to belong together are skipped whole.
* answer level: equal sets are one set from the start; then each list's first
  set answers for the sets that look alike. A set that is confirmed so has that
  leader, and their exact overlap is kept. Other pairs are answered through their
  leaders: the overlap of two sets is at most that of their leaders and what each
  set has that its leader lacks. So the leaders' overlap is computed once for all
  their followers, links them all or rules most pairs out, and only pairs that
  this difference leaves open are asked on their own sets.

Every pair across components that the bound lets through is verified on the
whole sets, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm._arrays import LOWER, Rolling, Slice, mix, signed, slices, word_hashes, words
from veridex.llm._spark import NO_ID, Scratch, keyed
from veridex.operators.graph import connected_components

SHINGLE, PERCENT = 5, 75
#: The most shingles that the list of frequent ones holds; it only orders sets, nothing is dropped by it.
FREQUENT = 500_000
_TOKENS_AT_ONCE = 1 << 20
_U = np.uint64
_TOP = _U(1) << _U(63)


def shingle_sets(part: Slice, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes below 2**63; with fewer words the whole sequence is one."""
    found = words(part)
    rolling = Rolling(word_hashes(LOWER[part.data], found))
    windows = mix(rolling.windows(size) + _U(size)) & (_TOP - _U(1))
    out = []
    for lo, hi in zip(found.lo.tolist(), found.hi.tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(windows[lo : hi - size + 1]))
        elif hi > lo:
            out.append(mix(rolling.hash(np.array([lo]), np.array([hi])) + _U(hi - lo)) & (_TOP - _U(1)))
        else:
            out.append(np.zeros(0, _U))
    return out


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """The least overlap with any set, for a set of n: ceil(PERCENT * n / 100)."""
    return -(-PERCENT * n // 100)


def prefix(x: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order; frequent ones carry the top bit, so they sort last."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        late = frequent[at] == x
        x = np.concatenate([x[~late], x[late] | _TOP])
    return x[: len(x) - needed(len(x)) + 1]


#: Longs of a parity bitmap: each shingle flips one bit, so two bitmaps differ in at most as many bits as the sets in shingles.
MAP = 8
BITS = [f"b{k}" for k in range(MAP)]
META = "doc_id long, _d long, _h int, n long, f1 long, f2 long, end long, " + ", ".join(f"{b} long" for b in BITS)


def parity(x: np.ndarray) -> np.ndarray:
    odd = np.bincount((mix(x) & _U(64 * MAP - 1)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch], size: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A set's size, two fingerprints, and where its prefix ends (as a signed number that sorts like the global order)."""
    for batch in batches:
        for part in slices(batch.column("_t")):
            sets = shingle_sets(part, size)
            n = len(sets)
            maps = np.array([parity(x) for x in sets], np.int64)
            end = np.array([prefix(x, frequent)[-1] if len(x) else 0 for x in sets], _U) ^ _TOP
            prints = np.array([[x.sum(), np.bitwise_xor.reduce(mix(x))] if len(x) else [_U(0), _U(0)] for x in sets], _U)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(part.first, n) for k in ("doc_id", "_d", "_h")), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(signed(np.ascontiguousarray(prints[:, k]))) for k in (0, 1)), pa.array(signed(end)), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(MAP))],
                names=["doc_id", "_d", "_h", "n", "f1", "f2", "end", *BITS],
            )


def _often(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many of some hundred documents in a row hold a shingle, for those that two or more hold."""
    for batch in batches:
        sets: list[np.ndarray] = []
        for part in slices(batch.column("_t")):
            sets += shingle_sets(part, size)
            last = part.first + len(part.lo) == len(batch)
            if last or sum(map(len, sets)) >= _TOKENS_AT_ONCE:
                token, count = np.unique(np.concatenate(sets), return_counts=True)
                some = count > 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(token[some])), pa.array(count[some])], names=["token", "n"])
                sets = []


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("_d", "_h"))
        for part in slices(batch.column("_t")):
            found = [(part.first + i, prefix(x, frequent)) for i, x in enumerate(shingle_sets(part, size)) if len(x)]
            if found:
                rows = np.repeat([i for i, _ in found], [len(x) for _, x in found])
                at = np.concatenate([np.arange(1, len(x) + 1, dtype=np.int32) for _, x in found])
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([x for _, x in found]))), pa.array(d[rows]), pa.array(h[rows]), pa.array(at)], names=["token", "_d", "_h", "at"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column("_t")):
            sets = shingle_sets(part, size)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(part.first, len(sets)) for k in ("_d", "_h")), pa.array([x.tobytes() for x in sets], pa.binary())], names=["_d", "_h", "items"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact overlap of two sets, and whether it links them."""
    for batch in batches:
        both, linked = [], []
        for a, b in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
            both.append(len(np.intersect1d(x, y, assume_unique=True)))
            linked.append(100 * both[-1] >= PERCENT * (len(x) + len(y) - both[-1]))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in PAIR), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], names=[*PAIR, "both", "linked"])


PAIR = ("a_d", "a_h", "b_d", "b_h")
#: Lists of more entries are read in blocks.
BLOCK = 16


def _prefix_length(n: Column) -> Column:
    return n - F.ceil(F.lit(PERCENT) * n / 100) + 1


def _can_reach(shared: Column, na: Column, ea: Column, nb: Column, eb: Column) -> Column:
    """Whether sets of these sizes can still reach the threshold.

    The prefix that ends first is seen whole by the other: what it shares is
    known, and the overlap is at most that and its set's remainder.
    """
    rest = F.when(ea <= eb, na - _prefix_length(na)).otherwise(nb - _prefix_length(nb))
    return (F.lit(100 + PERCENT) * (shared + rest) >= F.lit(PERCENT) * (na + nb)) & (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb))


class _Join:
    def __init__(self, docs: DataFrame, size: int):
        self.spark, self.size = docs.sparkSession, size
        self.scratch = Scratch(self.spark, "jaccard")
        self.rows = keyed(docs)
        self.texts = self.rows.select("_d", "_h", "_t")
        self.frequent = self._frequent()
        described = self.rows.mapInArrow(partial(_describe, size=size, frequent=self.frequent), META)
        self.meta = self.scratch.keep(described)

    def _frequent(self) -> np.ndarray:
        """At most FREQUENT shingles that many documents hold, sorted: the tail of the global order."""
        found = self.texts.mapInArrow(partial(_often, size=self.size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        top = found.where("n >= 8").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
        return np.sort(top.column("token").to_numpy().view(_U))

    def entries(self) -> DataFrame:
        """The index: token, set, size, prefix end and the token's position, of one set for each class of equal sets, in lists of two and more."""
        found = self.texts.mapInArrow(partial(_prefixes, size=self.size, frequent=self.frequent), "token long, _d long, _h int, at int")
        often = found.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
        listed = self.scratch.keep(found.join(often, "token"))
        one = self.meta.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct("_d", "_h")).alias("one"), F.max("end").alias("end"))
        some = listed.join(one.select("one.*", "n", "end"), ["_d", "_h"])
        again = some.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
        index = self.scratch.keep(some.join(again, "token").select("token", F.struct("_d", "_h").alias("s"), "n", "end", "at"))
        self.scratch.drop(listed)
        return index

    def answers(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both, linked) of distinct pairs (a, b): the exact overlap of their whole sets."""
        pairs = self.scratch.keep(pairs)
        asked = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().select("k._d", "k._h")
        sets = self.scratch.keep(self.texts.join(asked, ["_d", "_h"]).mapInArrow(partial(_sets, size=self.size), "_d long, _h int, items binary"))
        x = sets.select(F.struct("_d", "_h").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.struct("_d", "_h").alias("b"), F.col("items").alias("y"))
        rows = pairs.join(x, "a").join(y, "b").select(*(F.col(f"{k[0]}._{k[2]}").alias(k) for k in PAIR), "x", "y")
        found = rows.mapInArrow(_overlap, "a_d long, a_h int, b_d long, b_h int, both long, linked boolean")
        found = self.scratch.keep(found.select(F.struct(F.col("a_d").alias("_d"), F.col("a_h").alias("_h")).alias("a"), F.struct(F.col("b_d").alias("_d"), F.col("b_h").alias("_h")).alias("b"), "both", "linked"))
        self.scratch.drop(pairs, sets)
        return found


def _edges(answers: DataFrame) -> DataFrame:
    return answers.where("linked").select(F.col("a._d").alias("u"), F.col("b._d").alias("v"))


def _band(n: Column) -> Column:
    """Sizes in classes: the largest partner of a set is at most one class above it."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / PERCENT)))


def _reach(n: Column, at: Column) -> Column:
    """The largest partner that a set can meet at this position: beyond, the shingles from here on are too few."""
    return F.least(F.floor(100 * n / PERCENT), F.floor((100 + PERCENT) * (n - at + 1) / PERCENT) - n)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries of one list whose size and position allow it; of long lists only blocks that can hold a partner are joined.

    A block holds entries of one size class that reach one size class. An entry
    asks for the classes between its least and its largest partner that reach its
    own class.
    """
    a_reach, b_reach = _reach(F.col("a_n"), F.col("a_at")), _reach(F.col("b_n"), F.col("b_at"))
    room = (F.col("b_n") <= a_reach) & (F.col("a_n") <= b_reach)
    short = left.where(F.col("a_k") <= BLOCK).join(right.where(F.col("b_k") <= BLOCK), "token")
    fewest = F.ceil(F.lit(PERCENT) * F.col("a_n") / 100)
    asks = left.where((F.col("a_k") > BLOCK) & (a_reach >= fewest)).withColumn("size", F.explode(F.sequence(_band(fewest), _band(a_reach))))
    asks = asks.withColumn("reach", F.explode(F.sequence(F.least(_band(F.col("a_n")), F.col("size") + 1), F.col("size") + 1)))
    blocks = right.where((F.col("b_k") > BLOCK) & (b_reach >= 1)).withColumn("size", _band(F.col("b_n"))).withColumn("reach", F.least(_band(b_reach), F.col("size") + 1))
    return short.unionByName(asks.join(blocks, ["token", "size", "reach"]).drop("size", "reach")).where(room)


def jaccard_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """A row per input row: doc_id, n_shingles and component_id.

    Documents link when 100 * intersection >= 75 * union of their distinct
    `size`-word shingles (words lower-cased in A-Z; with fewer words the whole
    sequence is one shingle). component_id is the smallest doc_id that links
    reach. Defined results: null, empty and blank texts have no shingles and link
    with nothing; rows that repeat a doc_id are one document with several texts,
    any of which can link; rows with a null doc_id count as one document that
    sorts last, and are their own component (null) unless linked; other columns
    are ignored. An empty table gives an empty result.
    """
    job = _Join(docs, size)
    entries = job.entries()

    # answer level, first: every list's least set answers for the sets that share enough lists with it
    heads = entries.groupBy("token").agg(F.min(F.struct("s", "n", "end")).alias("head"))
    votes = entries.join(heads, "token").where(F.col("s") != F.col("head.s"))
    votes = votes.groupBy(F.col("s").alias("b"), F.col("head.s").alias("a")).agg(F.count("*").alias("shared"), F.first("n").alias("nb"), F.first("end").alias("eb"), F.first("head.n").alias("na"), F.first("head.end").alias("ea"))
    likely = votes.where(_can_reach(F.col("shared"), F.col("na"), F.col("ea"), F.col("nb"), F.col("eb")))
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    led = job.answers(likely.withColumn("r", F.row_number().over(best)).where("r <= 2").select("a", "b"))
    links = _edges(led)
    leader = job.scratch.keep(led.where("linked").groupBy(F.col("b").alias("s")).agg(F.max_by(F.struct(F.col("a").alias("leader"), "both"), F.struct("both", "a")).alias("top")).select("s", "top.leader", "top.both"))

    # then all pairs across components
    groups = connected_components(links)
    labelled = entries.withColumn("_d", F.col("s._d")).join(groups.select(F.col("node").alias("_d"), F.col("component")), "_d", "left")
    labelled = job.scratch.keep(labelled.select("token", "s", "n", "end", "at", F.coalesce("component", "_d").alias("label")))
    job.scratch.drop(entries)
    by_label = labelled.groupBy("token", "label").agg(F.count("*").alias("k"))
    lists = by_label.groupBy("token").agg(F.count("*").alias("labels"), F.sum("k").alias("k"), F.max(F.struct("k", "label")).alias("top")).where("labels > 1")
    mixed = labelled.drop("end").join(lists.select("token", "k", F.col("top.label").alias("top")), "token")
    mixed = job.scratch.keep(mixed.join(job.meta.select(F.struct("_d", "_h").alias("s"), *BITS).dropDuplicates(["s"]), "s"))
    fields = ("s", "n", "at", "label", "k", *BITS)
    left = mixed.where("label != top").select("token", *(F.col(k).alias(f"a_{k}") for k in fields))
    right = mixed.select("token", (F.col("label") == F.col("top")).alias("in_top"), *(F.col(k).alias(f"b_{k}") for k in fields))
    apart = (F.col("a_label") != F.col("b_label")) & (F.col("in_top") | (F.col("a_s") < F.col("b_s")))
    differ = sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in BITS), F.lit(0))
    close = F.lit(100 + PERCENT) * differ <= F.lit(100 - PERCENT) * (F.col("a_n") + F.col("b_n"))
    met = _met(left, right).where(apart & close & (100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n")))
    met = met.select(F.least("a_s", "b_s").alias("a"), F.greatest("a_s", "b_s").alias("b")).distinct()
    held = labelled.groupBy("s").agg(F.first("n").alias("n"), F.first("end").alias("end"), F.collect_list("token").alias("tokens"))  # at most a set's prefix
    held = job.scratch.keep(held)
    one, two = (held.select(F.col("s").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("n", "end", "tokens"))) for k in ("a", "b"))
    counted = met.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("a_tokens", "b_tokens")))
    open_ = counted.where(_can_reach(F.col("shared"), F.col("a_n"), F.col("a_end"), F.col("b_n"), F.col("b_end"))).select("a", "b", "a_n", "b_n")

    # answered through the leaders first, then on their own sets where the difference leaves a pair open
    for k in ("a", "b"):
        mine = leader.select(F.col("s").alias(k), F.col("leader").alias(f"{k}_leader"), F.col("both").alias(f"{k}_both"))
        open_ = open_.join(mine, k, "left").withColumn(f"{k}_more", F.coalesce(F.col(f"{k}_n") - F.col(f"{k}_both"), F.lit(0))).withColumn(f"{k}_leader", F.coalesce(f"{k}_leader", k))
    open_ = open_.withColumns({"la": F.least("a_leader", "b_leader"), "lb": F.greatest("a_leader", "b_leader")}).where("la != lb")
    open_ = job.scratch.keep(open_.select("a", "b", "la", "lb", (F.col("a_n") + F.col("b_n")).alias("sizes"), (F.col("a_more") + F.col("b_more")).alias("more")))
    first = job.answers(open_.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    derived = open_.where("struct(a, b) != struct(la, lb)").join(first.select(F.col("a").alias("la"), F.col("b").alias("lb"), "both", "linked"), ["la", "lb"])
    unsure = derived.where(~F.col("linked") & ((100 + PERCENT) * (F.col("both") + F.col("more")) >= PERCENT * F.col("sizes")))
    second = job.answers(unsure.select("a", "b"))
    more = _edges(first).unionByName(_edges(second))

    job.scratch.drop(mixed, held, labelled)

    # equal sets, and what both rounds confirmed
    classes = job.scratch.keep(job.meta.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("_d").alias("u"), F.count("*").alias("k")).where("k > 1").drop("k"))
    equal = job.meta.join(classes, ["n", "f1", "f2"]).where("_d != u").select("u", F.col("_d").alias("v"))
    final = connected_components(links.unionByName(more).unionByName(equal))
    job.scratch.drop(classes, led, leader, open_, first, second)
    out = job.meta.join(final.select(F.col("node").alias("_d"), "component"), "_d", "left")
    component = F.nullif(F.coalesce("component", "_d"), F.lit(NO_ID))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_representatives(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group of linked documents, that of the smallest doc_id, with all columns.

    Rows that repeat a doc_id are one document: they stay or go together, and so
    do rows with a null doc_id.
    """
    comp = jaccard_components(docs, size)
    gone = comp.where("component_id < coalesce(doc_id, component_id + 1)").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"))
    return rows.join(gone, "_d", "left_anti").select("_row.*")
