"""Phrase tables over one automaton against a search phrase by phrase."""

import random

from pyspark.sql import functions as F

from veridex.operators import semcap as S
from veridex.plans.policy_queries import _CAPABLE

DATA = "/root/testdata/sf0.01"


def test_phrases_equal_a_search_for_each(spark):
    rng = random.Random(5)
    phrases = tuple(sorted({"".join(rng.choice("ab é") for _ in range(rng.randint(1, 4))) for _ in range(40)}))
    texts = ["".join(rng.choice("ab éc") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "ab" * 50_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.phrases_in(F.col("t"), phrases).alias("f"))
    assert {r.i: r.f for r in rows.collect()} == {i: [k for k, p in enumerate(phrases) if t and p in t] for i, t in enumerate(texts)}


def test_every_reason_and_requirement_is_hit(spark):
    out = S.semcap(spark.read.parquet(f"{DATA}/part.parquet").selectExpr(*_CAPABLE).withColumn("coverage_text", F.concat_ws(" ", "gold", "flagged")))
    seen = {r[0] for k in ("mismatch", "uncertain", "ok", "requirements") for r in out.select(F.explode(k)).distinct().collect()}
    assert seen >= {r.name for r in S.REASONS} | {r.label for r in S.REQUIREMENTS} | {S.GENERAL, "all_detected_requirements_covered", "partial_requirement_coverage"}


def test_tables_with_negative_phrases_and_odd_rows(spark):
    table = S.requirement_table([("weather", ["weather"], ["forecast"], ["wave  height"]), ("open", ["open"], [])])
    rows = spark.createDataFrame([(1, "WEATHER please", "a Forecast"), (2, "weather", "forecast of wave height"), (3, "weather, open", None), (4, None, None), (4, None, None), (5, "open", "x"), (6, "weather", "")], "id int, query string, gold string")
    got = sorted((r.id, r.requirements, r.covered, r.missing, r.semantic, r.coverage_pred) for r in S.semcap(rows, table, ()).collect())
    assert got == [
        (1, ["weather"], ["weather"], [], "ok", "coverage_ok"), (2, ["weather"], ["weather"], [], "ok", "coverage_ok"), (3, ["open", "weather"], ["open"], ["weather"], "uncertain", "coverage_uncertain"),
        (4, [S.GENERAL], [S.GENERAL], [], "uncertain", "coverage_uncertain"), (4, [S.GENERAL], [S.GENERAL], [], "uncertain", "coverage_uncertain"), (5, ["open"], ["open"], [], "ok", "coverage_ok"), (6, ["weather"], [], ["weather"], "uncertain", "coverage_uncertain"),
    ]
    folded = S.semcap(rows.where("id = 2"), S.requirement_table([("weather", ["weather"], ["forecast"], ["wave height"])]), (), collapse=True).first()
    assert folded.missing == ["weather"] and S.semcap(rows.limit(0)).count() == 0
