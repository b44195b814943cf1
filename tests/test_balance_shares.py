"""Many groups that must move: by shares first, only the rest one by one."""

import collections
import random

import pytest

from veridex.operators import balance as B


@pytest.mark.parametrize("stay", [0.0, 1.0])
def test_most_groups_move_by_shares(spark, monkeypatch, stay):
    rng = random.Random(5)
    rows = []
    for g in range(4_000):
        was = rng.choice(["train"] * 5 + ["dev"] * 2 + ["test"] * 3)
        rows += [(g, rng.choice("aab" if was == "test" else "abbb"), rng.choice("xyz"), was) for _ in range(rng.randint(5, 15))]
    n, singly, improve = len(rows), [], B._improve

    def counted(*args, **named):
        changes = improve(*args, **named)
        singly.append(sum(abs(x).sum() for x in changes.values()) / 2)
        return changes

    monkeypatch.setattr(B, "_improve", counted)
    objective = B.Objective(exact={"dev": n // 10, "test": n // 10}, least={"test": 5}, stay=stay)
    df = spark.createDataFrame(rows, "g int, a string, b string, was string")
    made = B.balance(df.repartition(3), "g", ["a", "b"], objective, was="was")
    got = {r.group: r for r in made.groups.collect()}
    size, was = collections.Counter(x[0] for x in rows), {x[0]: x[3] for x in rows}
    assert {g: (r.n, r.was) for g, r in got.items()} == {g: (size[g], was[g]) for g in size}
    sizes = collections.Counter(got[x[0]].split for x in rows)
    assert sizes == {"dev": n // 10, "test": n // 10, "train": n - 2 * (n // 10)}
    moved = sum(r.was != r.split for r in got.values())
    assert moved > 1_000 > 4 * sum(singly) and moved < 2_400
    if stay:
        again = B.balance(df.repartition(7), "g", ["a", "b"], objective, was="was").groups.collect()
        assert {r.group: r.split for r in again} == {g: r.split for g, r in got.items()}
    else:
        total = collections.Counter(x[1] for x in rows)
        share = collections.Counter((got[x[0]].split, x[1]) for x in rows)
        assert all(abs(share[s, v] - total[v] * r) <= 0.01 * total[v] * r for s, r in objective.ratios.items() for v in total)
