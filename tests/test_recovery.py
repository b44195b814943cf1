"""Rebuilt candidate spaces: tasks that ask for the same, and no table of tasks or items in the driver."""

import random

from veridex.operators import recovery


def test_tasks_of_one_ask_take_what_is_not_their_gold_and_nothing_is_broadcast(spark):
    rng = random.Random(4)
    pool = [(f"c{i:02d}", rng.choice(["s1", "s2", None]), rng.choice(["d1", "d2", None]), rng.choice(["cheap repair", "repair tools", "food", None])) for i in range(60)]
    tasks = [(f"t{i:03d}", rng.choice(["cheap repair shop", "a shop: repair, cheap", "tools", "", None]), rng.choice(["s1", "s3", None]), rng.choice(["d1", None]), [f"c{rng.randrange(60):02d}" for _ in range(rng.choice([0, 2, 11]))]) for i in range(120)]
    tasks.append(("none", "tools", "s1", "d1", None))
    got = recovery.rebuilt_candidates(spark.createDataFrame(tasks, "task_id string, query string, service string, domain string, gold array<string>"), spark.createDataFrame(pool, "candidate string, service string, domain string, document string"), target=6)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    words = lambda x: set("".join(c if c.isalnum() else " " for c in x or "").split()) - {"a"}
    want = []
    for t, q, s, d, gold in tasks[:-1]:
        order = sorted((x for x in pool if x[0] not in gold), key=lambda x: (s is None or x[1] != s, d is None or x[2] != d, -len(words(x[3]) & words(q)), x[0]))
        want += [(t, x[0], k + 1) for k, x in enumerate(order[: max(6, len(gold) + 1) - len(gold)])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
