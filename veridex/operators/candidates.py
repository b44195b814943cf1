"""Candidate spaces: explosion, task types, validation, negatives, filling up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions.text import normalize_ascii


def space_status(candidates: Column, gold: Column) -> Column:
    """empty_gold, gold_not_subset, no_non_gold_candidate or valid, checked in this order."""
    c, g = F.array_distinct(candidates), F.array_distinct(gold)
    return F.when(F.size(g) == 0, "empty_gold").when(F.size(F.array_except(g, c)) > 0, "gold_not_subset").when(F.size(c) <= F.size(g), "no_non_gold_candidate").otherwise("valid")


def eligible(n_candidates: Column, n_gold: Column) -> Column:
    return n_candidates > F.greatest(F.lit(1), n_gold)


def gold_in_candidates(gold: Column, candidates: Column) -> Column:
    return F.when((F.size(gold) == 0) | (F.size(candidates) == 0), "unknown").when(F.size(F.array_except(gold, candidates)) == 0, "yes").otherwise("no")


def explode_candidates(tasks: DataFrame) -> DataFrame:
    """A row per task and candidate with its rank, whether it is gold and whether the query mentions it. tasks: task_id, query, candidates, gold."""
    rows = tasks.select("task_id", "query", "gold", F.posexplode("candidates").alias("pos", "candidate"))
    name = normalize_ascii(F.col("candidate"))
    mentioned = (F.length(name) > 0) & normalize_ascii(F.col("query")).contains(name)
    return rows.select("task_id", (F.col("pos") + 1).alias("candidate_rank"), "candidate", F.array_contains("gold", F.col("candidate")).alias("is_gold"), mentioned.alias("is_mentioned"))


def regroup_candidates(rows: DataFrame) -> DataFrame:
    """Back to a row per task: distinct candidates in order of rank, and the gold ones."""
    ordered = F.array_sort(F.collect_list(F.struct("candidate_rank", "candidate", "is_gold")))
    grouped = rows.groupBy("task_id").agg(ordered.alias("o"))
    names = lambda xs: F.array_distinct(F.transform(xs, lambda s: s["candidate"]))
    return grouped.select("task_id", names(F.col("o")).alias("candidates"), names(F.filter("o", lambda s: s["is_gold"])).alias("gold"))


def task_type(gold_services: Column, composed: Column) -> Column:
    """single up to one distinct service, else composable where the query composes, else multi."""
    return F.when(F.size(F.array_distinct(gold_services)) <= 1, "single").when(composed, "composable").otherwise("multi")


def deterministic_negatives(values: Column, excluded: Column, seed: Column, limit: int = 4) -> Column:
    """The values with the smallest hash of seed and value that aren't excluded."""
    keyed = F.transform(F.array_except(values, excluded), lambda v: F.struct(F.sha2(F.concat_ws("\u0001", seed, v), 256).alias("h"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda s: s["v"])


def fill_candidates(tasks: DataFrame, pool: DataFrame, target: int = 12) -> DataFrame:
    """Candidates to add until max(target, gold + 1) are there: same service first, then same domain, then by name.

    tasks: task_id, service, domain, gold_n, have array; pool: candidate, service,
    domain. Of every domain, and of every service in it, only as many first
    candidates as the neediest task can ask for are joined.
    """
    need = F.greatest(F.lit(target), F.col("gold_n") + 1) - F.size("have")
    asked = tasks.select("task_id", F.col("service").alias("ts"), "domain", "have", need.alias("need")).where("need > 0")
    most = asked.agg(F.max(F.size("have") + F.col("need")).alias("m")).first()["m"] or 0
    first = lambda *by: pool.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("candidate"))).where(F.col("k") <= most).select("candidate", "service", "domain")
    own = asked.join(first("domain", "service").withColumnRenamed("service", "ts"), ["domain", "ts"]).select("task_id", "candidate", F.lit(0).alias("o"), "have", "need")
    any_ = asked.join(first("domain"), "domain").select("task_id", "candidate", F.when(F.col("service") == F.col("ts"), 0).otherwise(1).alias("o"), "have", "need")
    met = own.unionByName(any_).where(~F.array_contains("have", F.col("candidate"))).dropDuplicates(["task_id", "candidate"])
    order = Window.partitionBy("task_id").orderBy("o", "candidate")
    return met.withColumn("r", F.row_number().over(order)).where("r <= need").select("task_id", "candidate", "r")
