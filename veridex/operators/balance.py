"""Splits of whole groups that match sizes and label shares: an optimiser over group profiles.

Groups with the same counts of every label are interchangeable, so the search
never looks at groups, only at profiles: how many groups of a profile stand in
which split. A profile's groups are first dealt at the splits' shares. What is
far from its target then moves by shares: Spark adds up what every two splits
would exchange, the driver finds the shares that lower the cost most, and every
profile gives these shares of its groups, so that such a round moves any number
of groups. Rounds of single moves follow: Spark scores moving one group of every
profile between every two splits against the state of all splits (splits x
labels numbers), the best of these come to the driver, and moves and swaps that
lower the cost are applied there. Groups are dealt to splits once, at the end,
by their hash.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.plans.scratch import Scratch

#: The state has splits x labels numbers and goes to every task; more labels than this are refused.
MOST_LABELS = 2_000
#: Moves that a round brings to the driver, for each pair of splits.
MOVES = 64
#: Groups that a round by shares moves at least; fewer are left to single moves.
BULK = 2 * MOVES
#: Up to so many groups are dealt one after the other, the largest first, instead of at the splits' shares.
FEW_GROUPS = 4_096


@dataclass(frozen=True)
class Objective:
    """What an assignment costs: for every split, size and labels by their squared distance from the target, relative to it.

    size_weight: of the size against a label. floor: least divisor of a label's
    distance. exact: the size that splits must have, instead of their share of
    the rows. least: rows of every label that a split needs, where the label has
    `least_of` rows and more; each missing one costs MISSING. stay: cost of moving
    all rows of an assignment that is rebalanced.
    """

    ratios: dict[str, float] = field(default_factory=lambda: {"train": 0.8, "dev": 0.1, "test": 0.1})
    size_weight: float = 4.0
    floor: float = 1.0
    exact: dict[str, int] = field(default_factory=dict)
    least: dict[str, int] = field(default_factory=dict)
    least_of: int = 20
    stay: float = 0.0


#: The weights of the benchmark's releases; labels are columns that the caller names, single fields or cells of several.
OBJECTIVES = {
    "plain": Objective(),
    "cells": Objective(size_weight=8.0, floor=5.0, least={"test": 5}),
    "proportional": Objective(size_weight=20.0, floor=3.0),
    "representative": Objective(size_weight=1.0, floor=1e6, least={"test": 5}),
}
MISSING = 10_000.0
#: An exact size outweighs labels, but not needed rows.
EXACT_WEIGHT = 100.0


@dataclass
class State:
    """Rows of every split by label (the last is the size), and the cost's terms: weight * (now - target)^2 + MISSING * what is missing to `least`."""

    splits: list[str]
    now: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    least: np.ndarray

    def cost_of(self, now: np.ndarray, s: int | slice = slice(None)) -> np.ndarray:
        """The cost of rows by label in the splits s, for any leading axes."""
        return (self.weight[s] * (now - self.target[s]) ** 2 + MISSING * np.maximum(0, self.least[s] - now)).sum(-1)

    @property
    def cost(self) -> float:
        return float(self.cost_of(self.now).sum())


def label_state(all_rows: np.ndarray, objective: Objective) -> State:
    """The empty state for rows by label, the size last."""
    splits = list(objective.ratios)
    ratios = np.array([objective.ratios[s] for s in splits])
    target = ratios[:, None] * all_rows
    weight = 1 / np.maximum(target, objective.floor) ** 2
    weight[:, -1] = objective.size_weight / np.maximum(target[:, -1], 1) ** 2
    least = np.zeros_like(target)
    for k, s in enumerate(splits):
        if s in objective.exact:
            target[k, -1], weight[k, -1] = objective.exact[s], EXACT_WEIGHT
        least[k, :-1] = np.where(all_rows[:-1] >= objective.least_of, objective.least.get(s, 0), 0)
    return State(splits, np.zeros_like(target), target, weight, least)


def profiles_of(rows: DataFrame, group: str, labels: list[str], was: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(group, was, n, profile, vector) of every group, and the labels by their number in the vectors.

    vector: (d, v) pairs, v rows of label d, the size being the last label. Counts
    are taken per group and label before anything is gathered, so a group's rows
    may be any number; its vector is as long as its labels.
    """
    named = F.array(*(F.struct(F.lit(k).alias("field"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in labels))
    split = F.col(was) if was else F.lit(None).cast("string")
    counts = rows.select(F.col(group).alias("group"), split.alias("was"), F.explode(named).alias("x")).groupBy("group", "x.field", "x.value").agg(F.count("*").alias("v"), F.min("was").alias("was"))
    counts = Scratch(rows.sparkSession, "profiles").keep(counts)
    found = [(r["field"], r["value"]) for r in counts.select("field", "value").distinct().orderBy("field", "value").limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    numbers = rows.sparkSession.createDataFrame([(f, v, d) for d, (f, v) in enumerate(found)], "field string, value string, d int")
    vectors = counts.join(F.broadcast(numbers), ["field", "value"]).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("vector"), F.sum(F.when(F.col("field") == labels[0], F.col("v")).otherwise(0)).alias("n"), F.min("was").alias("was"))
    whole = F.concat("vector", F.array(F.struct(F.lit(len(found)).alias("d"), F.col("n").alias("v"))))
    return vectors.select("group", "was", "n", F.sha2(F.to_json("vector"), 256).alias("profile"), whole.alias("vector")), found


def _counts(splits: list[str]) -> list[str]:
    return [f"now_{s}" for s in splits]


def _dealt(k: Column, profile: Column, ratios: dict[str, float]) -> list[Column]:
    """How many of k groups go to each split: within one of its share, and on average over profiles just that."""
    offset = F.pmod(F.xxhash64(profile), F.lit(1 << 20)) / (1 << 20)
    high, edges = 0.0, [F.lit(0)]
    for r in list(ratios.values())[:-1]:
        high += r
        edges.append(F.floor(k * high + offset))
    return [b - a for a, b in zip(edges, [*edges[1:], k], strict=True)]


def _moved(c: np.ndarray, first: np.ndarray, s: int, t: int) -> np.ndarray:
    """How many more groups stand in another split than at first when one of each profile goes from s to t: 1, 0 or -1."""
    return (c[:, s] <= first[:, s]).astype(int) - (c[:, t] < first[:, t])


def _change(state: State, s: int, t: int) -> Column:
    """What the labels' cost changes by when one group with `vector` leaves split s for t: for v rows of a label v * along + v * v * across, and rows that are missing then."""
    labels = state.now.shape[1]

    def term(x: Column) -> Column:
        at = x["d"] + 1
        out = x["v"] * (F.element_at("along", at) + x["v"] * F.element_at("across", at))
        for k, step in ((s, -1), (t, 1)):
            if state.least[k].any():
                spare = F.element_at("spare", at + k * labels)
                out = out + MISSING * (F.greatest(F.lit(0.0), -spare - step * x["v"]) - F.greatest(F.lit(0.0), -spare))
        return out

    return F.aggregate("vector", F.lit(0.0), lambda so_far, x: so_far + term(x))


def _candidates(table: DataFrame, state: State, stay: float) -> DataFrame:
    """The MOVES best moves of one group for each pair of splits."""
    spark, width, out = table.sparkSession, len(state.splits), None
    slope = 2 * state.weight * (state.now - state.target)
    for s in range(width):
        for t in range(width):
            if s == t:
                continue
            known = spark.createDataFrame([tuple(x.ravel().tolist() for x in (slope[t] - slope[s], state.weight[s] + state.weight[t], state.now - state.least))], "along array<double>, across array<double>, spare array<double>")
            a, b = state.splits[s], state.splits[t]
            again = F.when(F.col(f"now_{a}") <= F.col(f"first_{a}"), 1).otherwise(0) - F.when(F.col(f"now_{b}") < F.col(f"first_{b}"), 1).otherwise(0)
            change = (_change(state, s, t) + stay * again * F.col("n")).alias("change")
            scored = table.where(F.col(f"now_{a}") > 0).join(F.broadcast(known), F.lit(True)).select(F.lit(s).alias("s"), F.lit(t).alias("t"), "profile", "vector", "n", *_counts(state.splits), *(f"first_{x}" for x in state.splits), change)  # one row
            best = scored.orderBy("change", "profile").limit(MOVES)
            out = best if out is None else out.unionByName(best)
    return out


def _improve(state: State, rows: list, stay: float, least_gain: float = 1e-9) -> dict[str, np.ndarray]:
    """Applies the best moves and swaps among the candidates to the state until none lowers the cost; returns what each profile's counts change by."""
    names = sorted({r["profile"] for r in rows})
    at = {p: k for k, p in enumerate(names)}
    width, labels = state.now.shape
    v, n = np.zeros((len(names), labels)), np.zeros(len(names))
    c, first = np.zeros((len(names), width)), np.zeros((len(names), width))
    for r in rows:
        k = at[r["profile"]]
        n[k] = r["n"]
        for x in r["vector"]:
            v[k, x["d"]] = x["v"]
        c[k] = [r[x] for x in _counts(state.splits)]
        first[k] = [r[f"first_{x}"] for x in state.splits]
    before = c.copy()
    few = len(names) <= MOVES
    listed = {(s, t): np.array(sorted({at[r["profile"]] for r in rows if few or (r["s"], r["t"]) == (s, t)}), int) for s in range(width) for t in range(width) if s != t}
    while True:
        best = (-least_gain, None)
        base = [float(state.cost_of(state.now[s], s)) for s in range(width)]
        for (s, t), ks in listed.items():
            ks = ks[c[ks, s] > 0]
            if not len(ks):
                continue
            moved = stay * n[ks] * _moved(c, first, s, t)[ks]
            change = state.cost_of(state.now[s] - v[ks], s) + state.cost_of(state.now[t] + v[ks], t) - base[s] - base[t] + moved
            k = int(change.argmin())
            if change[k] < best[0]:
                best = (change[k], [(ks[k], s, t)])
            if s < t:
                js = listed[t, s][c[listed[t, s], t] > 0]
                if len(js):
                    away = v[ks][:, None] - v[js][None]
                    both = state.cost_of(state.now[s] - away, s) + state.cost_of(state.now[t] + away, t) - base[s] - base[t]
                    both = both + moved[:, None] + stay * (n[js] * _moved(c, first, t, s)[js])[None]
                    i, j = np.unravel_index(both.argmin(), both.shape)
                    if both[i, j] < best[0] and ks[i] != js[j]:
                        best = (both[i, j], [(ks[i], s, t), (js[j], t, s)])
        if best[1] is None:
            return {p: c[k] - before[k] for p, k in at.items() if (c[k] != before[k]).any()}
        for k, s, t in best[1]:
            c[k, s] -= 1
            c[k, t] += 1
            state.now[s] -= v[k]
            state.now[t] += v[k]


def _greedy(state: State, rows: list) -> dict[str, np.ndarray]:
    """Groups one after the other, the largest first, each where the cost of the whole state is least; counts by profile."""
    out = {}
    for r in sorted(rows, key=lambda r: (-r["n"], r["profile"])):
        v = np.zeros(state.now.shape[1])
        for x in r["vector"]:
            v[x["d"]] = x["v"]
        out[r["profile"]] = np.zeros(len(state.splits))
        for _ in range(r["k"]):
            s = int((state.cost_of(state.now + v) - state.cost_of(state.now)).argmin())
            state.now[s] += v
            out[r["profile"]][s] += 1
    return out


def _lowest(curve: np.ndarray, slope: np.ndarray, most: float, sweeps: int = 2_000) -> np.ndarray:
    """The shares between 0 and `most` where shares @ curve @ shares + slope @ shares is least, one after the other until they stand still."""
    shares, diagonal = np.zeros(len(slope)), np.diag(curve)
    for _ in range(sweeps):
        before = shares.copy()
        for j in np.flatnonzero(diagonal > 0):
            shares[j] = min(max(shares[j] - (curve[j] @ shares + slope[j] / 2) / diagonal[j], 0.0), most)
        if np.abs(shares - before).max(initial=0) < 1e-12:
            break
    return shares


def _by_shares(table: DataFrame, state: State, stay: float, turn: int) -> DataFrame | None:
    """The table after groups moved by shares, if these are BULK groups at least; the rows needed of labels are left to single moves.

    Between every two splits there are two shares: one of all groups, and one of
    those whose labels are better off in the other split. Which groups of a
    profile with few of them move is decided by its hash, so a round leaves
    about the square root of what it moves to the next.
    """
    spark, (width, labels) = table.sparkSession, state.now.shape
    pairs = [(s, t) for s in range(width) for t in range(width) if s != t]
    weight = state.weight.copy()
    weight[:, -1] = np.minimum(weight[:, -1], EXACT_WEIGHT / np.maximum(state.target[:, -1], 1) ** 2)  # relative, as labels are
    slopes = 2 * weight * (state.now - state.target)
    slopes[:, -1] = 0
    known = spark.createDataFrame([tuple(x.tolist() for x in slopes)], ", ".join(f"slope_{k} array<double>" for k in range(width)))
    score = lambda k: F.aggregate("vector", F.lit(0.0), lambda so_far, x: so_far + x["v"] * F.element_at(f"slope_{k}", x["d"] + 1))
    scored = table.join(F.broadcast(known), F.lit(True)).select(*table.columns, *(score(k).alias(f"score_{k}") for k in range(width)))  # one row
    now, first = ([F.col(f"{x}_{s}") for s in state.splits] for x in ("now", "first"))
    better = {(s, t): F.col(f"score_{t}") < F.col(f"score_{s}") for s, t in pairs}
    leaves = {(s, t): now[s] * (F.when(now[s] <= first[s], 1).otherwise(0) - F.when(now[t] < first[t], 1).otherwise(0)) for s, t in pairs}
    sums = []
    for k, pair in enumerate(pairs):
        kept, gone = now[pair[0]], leaves[pair]
        some = lambda c: F.sum(F.when(better[pair], c).otherwise(0))  # noqa: B023, E731
        sums += [F.sum(kept).alias(f"groups_{k}"), some(kept).alias(f"groups_{k + len(pairs)}"), F.sum(gone * F.col("x.v")).alias(f"stay_{k}"), some(gone * F.col("x.v")).alias(f"stay_{k + len(pairs)}"), some(kept * F.col("x.v")).alias(f"rows_{k}")]
    found = {r["d"]: r for r in scored.select("*", F.explode("vector").alias("x")).groupBy("x.d").agg(*sums).collect()}  # a row per label
    size = found.get(labels - 1)
    if size is None:
        return None
    ways = np.zeros((2 * len(pairs), width, labels))
    for k, (s, t) in enumerate(pairs):
        chosen = np.zeros(labels)
        for d, r in found.items():
            chosen[d] = r[f"rows_{k}"]
        for j, x in ((k, state.now[s]), (k + len(pairs), chosen)):
            ways[j, s], ways[j, t] = -x, x
    flat = (ways * np.sqrt(weight)).reshape(len(ways), -1)
    off = (np.sqrt(weight) * (state.now - state.target)).ravel()
    staying, groups = (np.array([float(size[f"{x}_{j}"]) for j in range(len(ways))]) for x in ("stay", "groups"))
    shares = _lowest(flat @ flat.T, 2 * flat @ off + stay * staying, 1 / (2 * (width - 1))) if width > 1 else np.zeros(len(ways))
    if shares @ groups < BULK:
        return None
    moved = {}
    for s in range(width):
        offset = F.pmod(F.xxhash64("profile", F.lit(turn), F.lit(s)), F.lit(1 << 20)) / (1 << 20)
        share, last = F.lit(0.0), F.lit(0)
        for k, (a, b) in enumerate(pairs):
            if a == s:
                share = share + F.lit(float(shares[k])) + F.when(better[a, b], float(shares[k + len(pairs)])).otherwise(0.0)
                edge = F.least(F.floor(now[s] * share + offset), now[s])
                moved[a, b], last = edge - last, edge
    after = [now[s] + sum((moved[a, b] for a, b in pairs if b == s), F.lit(0)) - sum((moved[a, b] for a, b in pairs if a == s), F.lit(0)) for s in range(width)]
    return scored.select("profile", "vector", "n", "k", *(c.alias(f"now_{x}") for c, x in zip(after, state.splits, strict=True)), *first)


def _off(state: State) -> float:
    """What rounds by shares bring down: the cost without needed rows, an exact size weighing no more than other sizes can."""
    weight = state.weight.copy()
    weight[:, -1] = np.minimum(weight[:, -1], EXACT_WEIGHT / np.maximum(state.target[:, -1], 1) ** 2)
    return float((weight * (state.now - state.target) ** 2).sum())


def _with_changes(table: DataFrame, changes: dict[str, np.ndarray], splits: list[str]) -> DataFrame:
    small = table.sparkSession.createDataFrame([(p, *map(int, x)) for p, x in changes.items()], ", ".join(["profile string", *(f"add_{s} long" for s in splits)]))
    joined = table.join(F.broadcast(small), "profile", "left")  # at most 6 * MOVES rows, or FEW_GROUPS
    return joined.select("profile", "vector", "n", "k", *((F.col(f"now_{s}") + F.coalesce(f"add_{s}", F.lit(0))).alias(f"now_{s}") for s in splits), *(f"first_{s}" for s in splits))


def _sums(table: DataFrame, splits: list[str], labels: int) -> np.ndarray:
    each = table.select(F.explode("vector").alias("x"), *_counts(splits)).groupBy("x.d").agg(*(F.sum(F.col("x.v") * F.col(c)).alias(c) for c in _counts(splits)))
    out = np.zeros((len(splits), labels))
    for r in each.collect():  # a row per label
        out[:, r["d"]] = [r[c] for c in _counts(splits)]
    return out


def _settle(groups: DataFrame, table: DataFrame, splits: list[str]) -> DataFrame:
    """Every group's split: those of a profile stay where they were as far as its counts allow, in the order of their hash; the rest fill what is missing.

    Ranks are counted in ranges of the hash after the groups of earlier ranges, so
    that no profile gathers in a task.
    """
    keys = ["profile", "was"]
    hashed = groups.select("group", "n", "profile", F.coalesce("was", F.lit("")).alias("was"), F.sha2(F.col("group").cast("string"), 256).alias("_h")).withColumn("_part", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    parts = hashed.groupBy(*keys, "_part").agg(F.count("*").alias("_k"))
    earlier = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*keys, "_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", "group"))
    rows = hashed.join(parts, [*keys, "_part"]).withColumn("_rank", inside + F.col("_before")).join(table.drop("vector", "n", "k"), "profile")
    stays, offset, so_far = F.lit(0), F.lit(0), F.lit(0)
    for s in splits:
        keep = F.least(f"first_{s}", f"now_{s}")
        stays = F.when(F.col("was") == s, keep).otherwise(stays)
        offset = F.when(F.col("was") == s, so_far).otherwise(offset)
        so_far = so_far + F.col(f"first_{s}") - keep
    place = F.col("_rank") - stays + offset
    split, filled = F.lit(None).cast("string"), F.lit(0)
    for s in splits:
        filled = filled + F.greatest(F.lit(0), F.col(f"now_{s}") - F.col(f"first_{s}"))
        split = F.when(split.isNull() & (place <= filled), s).otherwise(split)
    stayed = (F.col("was") != "") & (F.col("_rank") <= stays)
    return rows.select("group", F.nullif("was", F.lit("")).alias("was"), "n", F.when(stayed, F.col("was")).otherwise(split).alias("split"))


@dataclass
class Balanced:
    """groups: (group, was, n, split). cost before and after; labels and the rows that every split has of them (the size last)."""

    groups: DataFrame
    cost_before: float
    cost: float
    labels: list[tuple[str, str]]
    state: State


def balance(rows: DataFrame, group: str, labels: list[str], objective: Objective = OBJECTIVES["plain"], was: str | None = None, few_groups: int = FEW_GROUPS) -> Balanced:
    """Whole groups to splits at the least cost found, from nothing or from the assignment in the column `was`.

    No group is torn; a group that `was` tears counts to the first of its splits,
    and rows without a known split to none. Results don't depend on the
    partitioning. Null labels are the label "unknown"; a null group is a group;
    an empty table gives an empty result. Rounds end when no listed move or swap
    lowers the cost, so the result is a local optimum of these.
    """
    spark, splits = rows.sparkSession, list(objective.ratios)
    scratch = Scratch(spark, "balance")
    groups, names = profiles_of(rows, group, labels, was)
    groups = scratch.keep(groups.withColumn("was", F.when(F.col("was").isin(splits), F.col("was"))))
    first = [F.count_if(F.col("was") == s).alias(f"first_{s}") for s in splits]
    table = groups.groupBy("profile").agg(F.any_value("vector").alias("vector"), F.any_value("n").alias("n"), F.count("*").alias("k"), *first)
    open_groups = F.col("k") - sum((F.col(f"first_{s}") for s in splits), F.lit(0))
    dealt = [(F.col(f"first_{s}") + d).alias(f"now_{s}") for s, d in zip(splits, _dealt(open_groups, F.col("profile"), objective.ratios), strict=True)]
    table = scratch.keep(table.select("profile", "vector", "n", "k", *dealt, *(f"first_{s}" for s in splits)))
    labels_n = len(names) + 1
    now = _sums(table, splits, labels_n)
    state = replace(label_state(now.sum(0), objective), now=now)
    size = table.agg(F.sum("k").alias("k"), F.count("*").alias("profiles")).first()
    total = size["k"] or 0
    if not was and total <= few_groups:
        state.now[:] = 0
        chosen = _greedy(state, table.select("profile", "vector", "n", "k").collect())
        old = {r["profile"]: r for r in table.select("profile", *_counts(splits)).collect()}
        table = scratch.keep(_with_changes(table, {p: x - [old[p][c] for c in _counts(splits)] for p, x in chosen.items()}, splits))
    before = state.cost
    stay = objective.stay / max(state.now[:, -1].sum(), 1)
    for turn in itertools.count() if total else ():
        off, at_first = _off(state), state.now
        after = _by_shares(table, state, stay, turn)
        if after is None:
            break
        after = scratch.keep(after)
        state.now = _sums(after, splits, labels_n)
        if _off(state) >= off:  # no nearer: single moves do the rest
            state.now = at_first
            scratch.drop(after)
            break
        scratch.drop(table)
        table = after
        if _off(state) > 0.9 * off:
            break
    while total:
        changes = _improve(state, _candidates(table, state, stay).collect(), stay)
        if not changes:
            break
        after = scratch.keep(_with_changes(table, changes, splits))
        scratch.drop(table)
        table = after
        if size["profiles"] <= MOVES:  # all profiles were candidates for all moves
            break
    return Balanced(_settle(groups, table, splits), before, state.cost, names, state)


def moved_rows(groups: DataFrame) -> DataFrame:
    """(was, split, groups, n): how many groups and rows went from where to where."""
    return groups.groupBy("was", "split").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))
