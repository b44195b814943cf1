"""Balanced splits against a sequential greedy over single groups, and rebalancing to exact sizes."""

import collections
import random

import numpy as np
import pytest

from veridex.operators import balance as B

RATIOS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def rows_of(seed, groups=60):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for _ in range(rng.choice([1, 1, 1, 2, 3, 8, 20])):
            rows.append((g, rng.choice("aabbc"), rng.choice(["x", "x", "y", None]), rng.choice(["train"] * 8 + ["dev", "test"])))
    first = {}
    return [(g, a, b, first.setdefault(g, s)) for g, a, b, s in rows]


def cost(rows, split, ratios=RATIOS, size_weight=4.0, floor=1.0):
    """The plain objective, counted from the rows."""
    total = 0.0
    for s, r in ratios.items():
        target = len(rows) * r
        total += size_weight * ((sum(split[x[0]] == s for x in rows) - target) / max(target, 1)) ** 2
        for k in (1, 2):
            for label, n in collections.Counter(x[k] for x in rows).items():
                total += ((sum(split[x[0]] == s and x[k] == label for x in rows) - n * r) / max(n * r, floor)) ** 2
    return total


def sequential(rows):
    """Every group where the cost of the whole state is least, the largest first."""
    size = collections.Counter(x[0] for x in rows)
    of = {g: [x for x in rows if x[0] == g] for g in size}
    targets = {s: {("n", ""): len(rows) * r} | {(k, v): n * r for k in (1, 2) for v, n in collections.Counter(x[k] for x in rows).items()} for s, r in RATIOS.items()}
    state = {s: collections.Counter() for s in RATIOS}
    split = {}
    for g in sorted(size, key=lambda g: (-size[g], g)):
        v = collections.Counter(("n", "") for _ in of[g]) + collections.Counter((k, x[k]) for x in of[g] for k in (1, 2))

        def after(s):
            return sum((4 if d == ("n", "") else 1) * ((state[q][d] + (v[d] if q == s else 0) - t) / max(t, 1)) ** 2 for q in RATIOS for d, t in targets[q].items())

        split[g] = min(RATIOS, key=after)
        state[split[g]].update(v)
    return split


@pytest.mark.parametrize("seed", range(20))
def test_cost_is_no_worse_than_the_sequential_greedy(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "g int, a string, b string, was string")
    made = B.balance(df, "g", ["a", "b"], few_groups=B.FEW_GROUPS if seed % 2 else 0)
    got = made.groups.collect()
    split = {r.group: r.split for r in got}
    assert len(got) == len(split) == 60 and set(split.values()) <= set(RATIOS)
    assert {r.group: r.n for r in got} == collections.Counter(x[0] for x in rows)
    assert cost(rows, split) == pytest.approx(made.cost)
    assert made.cost <= cost(rows, sequential(rows)) + 1e-9


def test_result_does_not_depend_on_partitions_and_hot_groups_stay_whole(spark):
    rows = rows_of(1, 200) + [(7, "a", "x", "train")] * 400
    results = []
    for k in (1, 5):
        made = B.balance(spark.createDataFrame(rows, "g int, a string, b string, was string").repartition(k), "g", ["a", "b"], few_groups=0)
        results.append(sorted((r.group, r.split) for r in made.groups.collect()))
    assert results[0] == results[1] and len({g for g, _ in results[0]}) == len(results[0])


@pytest.mark.parametrize("stay", [0.0, 5.0])
def test_rebalanced_to_exact_sizes(spark, stay):
    rows = rows_of(3, 300)
    df = spark.createDataFrame(rows, "g int, a string, b string, was string")
    n = len(rows)
    exact = {"dev": n // 10, "test": n // 10 + 3}
    made = B.balance(df, "g", ["a", "b"], B.Objective(exact=exact, least={"test": 5}, stay=stay), was="was")
    got = made.groups.collect()
    split = {r.group: r.split for r in got}
    sizes = collections.Counter(split[x[0]] for x in rows)
    assert {k: sizes[k] for k in exact} == exact
    assert all(sum(split[x[0]] == "test" and x[k] == v for x in rows) >= 5 for k in (1, 2) for v in {x[k] for x in rows})
    was = {x[0]: x[3] for x in rows}
    moved = sum(was[x[0]] != split[x[0]] for x in rows)
    told = B.moved_rows(made.groups).where("was != split").agg({"n": "sum"}).first()[0] or 0
    assert moved == told and all(was[r.group] == r.was for r in got) and made.cost < made.cost_before
    if stay:
        free = B.balance(df, "g", ["a", "b"], B.Objective(exact=exact, least={"test": 5}), was="was").groups.collect()
        assert moved < sum(r.n for r in free if r.was != r.split)


def test_least_rows_of_every_label(spark):
    rows = [(g, "rare" if g < 30 else "often", "x", None) for g in range(600)]
    df = spark.createDataFrame(rows, "g int, a string, b string, was string")
    made = B.balance(df, "g", ["a", "b"], B.OBJECTIVES["representative"])
    test = collections.Counter(rows[r.group][1] for r in made.groups.collect() if r.split == "test")
    assert test["rare"] >= 5 and abs(sum(test.values()) - 60) <= 1


def test_many_groups_of_one_profile_and_empty_tables(spark):
    df = spark.range(20_000).selectExpr("id as g", "'a' as a", "cast(null as string) as b", "'nowhere' as was")
    made = B.balance(df, "g", ["a", "b"], was="was")
    assert collections.Counter(r.split for r in made.groups.collect()) == {"train": 16_000, "dev": 2_000, "test": 2_000}
    assert B.balance(df.limit(0), "g", ["a"]).groups.count() == 0
    with pytest.raises(ValueError, match="labels"):
        B.balance(df, "g", ["g"])


def test_state_costs():
    state = B.label_state(np.array([10.0, 30.0, 40.0]), B.Objective(least={"test": 5}))
    state.now[2] = [1, 3, 4]
    assert state.cost == pytest.approx(2 * (2 + 4) + B.MISSING * 2)
