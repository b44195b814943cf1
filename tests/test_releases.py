"""Later policies: every outcome is reached by the queries' rows, and odd rows have their defined results."""

from pyspark.sql import functions as F

from veridex.operators import releases as N
from veridex.operators import semcap as S
from veridex.plans import policy_queries as P

DATA = "/root/testdata/sf0.01"
TEXTS = "level api_leak api_leak_strength service_leak gold_services gold_apis space task_type semantic coverage coverage_confidence gold_set overtrust domain_flags missing_flags before before_bucket".split()


def seen(df, column):
    return {v for r in df.select(column).distinct().collect() for v in (r[0] or "").split(";") if v}


def test_every_reason_and_bucket_is_reached(spark):
    out = N.integrity_policy(spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr(*P._LATER)).cache()
    assert seen(out, "blocking") == {r[0] for r in N._blocking()} and seen(out, "warnings") == {r[0] for r in N._warnings()} | {"v12_not_high_confidence_clean"}
    assert seen(out, "bucket") == {r[2] for r in [*N._blocking(), *N._warnings()]} | {N.LEAK_ONLY, N.CLEAN} and seen(out, "decision") == {N.CLEAN, N.REMOVED, N.UNCERTAIN, N.LEAK_ONLY}
    assert N.dangers(out.where("decision = 'dryrun_clean_candidate'")).count() == 0
    judged = N.judge_policy(spark.read.parquet(f"{DATA}/orders.parquet").selectExpr(*P._JUDGED))
    assert len(seen(judged, "bucket")) == 15 and len(seen(judged, "reason")) == 19
    stepped = N.explicit_policy(spark.read.parquet(f"{DATA}/part.parquet").selectExpr(*P._STEP).withColumn("requirements", F.array("asked")), S.requirement_table(P._EXPLICIT))
    assert len(seen(stepped, "rules")) == 5 and len(seen(stepped, "bucket")) == 5


def test_null_rows_empty_tables_and_other_columns(spark):
    schema = ", ".join(f"{c} string" for c in TEXTS)
    none = spark.createDataFrame([tuple([None] * len(TEXTS))] * 2, schema).withColumn("rules_of_mine", F.lit(1))
    assert [(r.decision, r.bucket, r.blocking, r.rules_of_mine) for r in N.integrity_policy(none).collect()] == [(N.REMOVED, "removed_gold_missing", "gold_missing", 1)] * 2
    assert N.integrity_policy(none.limit(0)).count() == 0 and N.dangers(N.integrity_policy(none)).count() == 0
    rows = spark.createDataFrame([(None, None, None, None, None), (None, None, None, N.CLEAN, None), ("weather " * 100_000, "", ["x"], N.CLEAN, "b"), ("weather", "forecast", [None, " "], N.CLEAN, "b")], "query string, gold string, requirements array<string>, before string, before_bucket string")
    table = S.requirement_table([("weather", ["weather"], ["forecast"]), ("never", ["weather"], [])])
    assert [(r.decision, r.gaps) for r in N.explicit_policy(rows, table).collect()] == [("", []), (N.CLEAN, []), (N.REMOVED, ["weather", "never"]), (N.REMOVED, ["never"])]
    assert [r.decision for r in N.explicit_policy(rows, ()).collect()] == ["", N.CLEAN, N.CLEAN, N.CLEAN]
    blank = spark.createDataFrame([(N.CLEAN, *[None] * 10), (None, *[None] * 10)], "before string, before_bucket string, blocking string, parse_status string, semantic string, coverage string, missing_json string, extra_json string, overtrust string, gap string, wrong_gold string").withColumn("risk", F.lit(None).cast("string"))
    assert [tuple(r) for r in N.judge_policy(blank, "J").select("decision", "bucket", "reason").collect()] == [("J_uncertain_missing_prediction", "J_missing_prediction", "missing_prediction"), ("dryrun_not_clean", "", "not_a_clean_candidate")]


def test_what_holds_something(spark):
    rows = spark.createDataFrame([(v,) for v in (None, "", "[]", " [ ] ", "{}", "null", "0", "no json", "[0]", '{"a": null}', '"x"', "7")], "v string")
    assert [r[0] for r in rows.select(N.flagged("v")).collect()] == [False] * 8 + [True] * 4
    assert [r[0] for r in rows.select(N._some_listed("v")).collect()] == [False] * 7 + [True, True, False, False, False]
