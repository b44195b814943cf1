"""The stream of candidate spaces through a failure, and bootstrap intervals from distinct values."""

import random

import numpy as np
import pytest

from veridex.operators.candidates import explode_candidates
from veridex.operators.stats import bootstrap_by_values
from veridex.streaming import candidates as C

SCHEMA = "task_id string, seq int, query string, candidates array<string>, gold array<string>"


def test_candidate_stream_restarts_in_the_middle(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = []
    for k in range(240):
        names = [f"name{rng.randrange(30)}" for _ in range(rng.randint(0, 6))]
        rows.append((f"t{rng.randrange(90)}", k, rng.choice(["use name1 and name12", " ", None]), rng.choice([names, names, None]), names[:1] + [None]))
    source = tmp_path / "in"
    for k in range(8):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.parquet(f"{source}/{k}")
    start = lambda: C.candidate_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True)
    explode = C.explode_candidates
    calls = []

    def fails_once(tasks):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost in the middle of a batch")
        return explode(tasks)

    monkeypatch.setattr(C, "explode_candidates", fails_once)
    with pytest.raises(Exception, match="lost in the middle"):
        start().awaitTermination()
    assert C.counters(spark, str(tmp_path / "out")).first().tasks_read == 90
    start().awaitTermination()
    last = {}
    for r in rows:
        last[r[0]] = r
    clean = [(t, s, (q or "").strip(), c or [], [g for g in gold if g]) for t, s, q, c, gold in last.values()]
    want = sorted(map(tuple, explode_candidates(spark.createDataFrame(clean, SCHEMA).drop("seq")).collect()))
    got = C.current_candidates(spark, str(tmp_path / "out"))
    assert sorted(tuple(r[c] for c in ("task_id", "candidate_rank", "candidate", "is_gold", "is_mentioned")) for r in got.collect()) == want
    counts = C.counters(spark, str(tmp_path / "out")).first()
    assert counts.tasks_read == 240 and counts.query_empty > 0 and counts.candidate_empty > 0
    C.convert_batch(spark.createDataFrame(rows[210:], SCHEMA), 7, str(tmp_path / "out"))  # a replay of the last batch
    assert C.counters(spark, str(tmp_path / "out")).first().tasks_read == 240


def test_bootstrap_from_values_agrees_with_resampling(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.integers(0, 6, 900)] + [("b", float(x)) for x in rng.exponential(2, 400)] + [("c", None), ("d", 1.0), ("d", float("nan")), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(data, "g string, x double")
    rows = {r.g: r for r in bootstrap_by_values(df.repartition(3), "x", ["g"], repetitions=2000).collect()}
    again = {r.g: r for r in bootstrap_by_values(df.repartition(7), "x", ["g"], repetitions=2000).collect()}
    assert all(rows[g].low == pytest.approx(again[g].low) and rows[g].high == pytest.approx(again[g].high) for g in rows) and set(rows) == {"a", "b", "d", None}
    for g in "ab":
        x = np.array([v for k, v in data if k == g])
        means = rng.choice(x, (4000, len(x))).mean(1)
        low, high = np.quantile(means, [0.025, 0.975])
        assert abs(rows[g].low - low) < 0.12 * (high - low) and abs(rows[g].high - high) < 0.12 * (high - low)
        assert rows[g].mean == pytest.approx(x.mean()) and rows[g].n == len(x)
    assert rows["d"].low == rows["d"].high == 1.0
    assert bootstrap_by_values(df.limit(0), "x", ["g"]).count() == 0 and bootstrap_by_values(df, "x", []).count() == 1
