"""Model manifests: visible input, cache keys, estimates, and strict reading of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_FIELDS = ("setting", "task_id", "query_hash", "candidate_order_hash", "prompt_hash", "output_schema_hash", "model", "decoding_hash")
FORBIDDEN = ("gold", "acceptable_gold", "answer", "label", "split")


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def build_manifest(tasks: DataFrame, catalog: DataFrame, setting: str, model: str, prompt: str = "rank", schema: str = "ranking", decoding: str = "greedy") -> DataFrame:
    """One row a task with its visible input and an 8-field cache key.

    tasks: task_id, query, candidates array; catalog: candidate_id, document.
    Candidates stay in their order; one that the catalog lacks has an empty document.
    """
    each = tasks.select("task_id", "query", F.posexplode("candidates").alias("pos", "candidate_id")).join(catalog, "candidate_id", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "candidate_id", F.coalesce("document", F.lit("")).alias("document")))), lambda s: F.struct(s["candidate_id"].alias("candidate_id"), s["document"].alias("document")))
    rows = each.groupBy("task_id", "query").agg(listed.alias("candidates"))
    ids = F.to_json(F.transform("candidates", lambda c: c["candidate_id"].cast("string")))
    values = (F.lit(setting), F.col("task_id").cast("string"), sha(F.col("query")), sha(ids), sha(F.lit(prompt)), sha(F.lit(schema)), F.lit(model), sha(F.lit(decoding)))
    key = F.struct(*(v.alias(k) for k, v in zip(KEY_FIELDS, values, strict=True)))
    return rows.select("task_id", F.struct("query", "candidates").alias("visible_input"), key.alias("cache_key_fields"), sha(F.concat_ws("\n", *values)).alias("cache_key"))


def manifest_issues(manifest: DataFrame) -> DataFrame:
    """(task_id, issue): repeated keys, empty key fields, forbidden names in the visible input."""
    names = F.json_object_keys(F.to_json("visible_input"))
    own = F.array_compact(F.array(
        *(F.when(F.coalesce(F.col(f"cache_key_fields.{k}"), F.lit("")) == "", F.lit(f"empty:{k}")) for k in KEY_FIELDS),
        F.when(F.arrays_overlap(names, F.array(*map(F.lit, FORBIDDEN))), F.lit("forbidden_field")),
    ))
    repeated = manifest.groupBy("cache_key").agg(F.count("*").alias("n")).where("n > 1")
    twice = manifest.join(repeated, "cache_key", "left_semi").select("task_id", F.lit("repeated_key").alias("issue"))
    return manifest.select("task_id", F.explode(own).alias("issue")).unionByName(twice)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def answer_estimate(n_candidates: Column) -> Column:
    return F.greatest(F.lit(64), 8 * n_candidates)


def token_budget(rows: DataFrame, group: str, tokens: str, row_id: str, margin: int = 110) -> DataFrame:
    """Budget ceil(margin % of the worst output), the row that set it, and nearest-rank percentiles."""
    return rows.groupBy(group).agg(
        F.ceil(F.max(tokens) * margin / 100).cast("long").alias("budget"),
        F.max_by(row_id, F.struct(F.col(tokens), -F.col(row_id))).alias("worst_id"),
        F.expr(f"percentile_disc(0.95) within group (order by {tokens})").alias("p95"),
        F.expr(f"percentile_disc(0.5) within group (order by {tokens})").alias("p50"),
    )


def ranking_status(answer: Column, candidates: Column) -> Column:
    """ok, or the first reason why an answer {"ranking": [...]} isn't a permutation of the candidates."""
    parsed = F.from_json(answer, "struct<ranking:array<string>>")["ranking"]
    keys = F.json_object_keys(answer)
    return (
        F.when(F.try_parse_json(answer).isNull(), "invalid_json")
        .when(parsed.isNull(), "missing_ranking")
        .when(F.size(keys) != 1, "unexpected_keys")
        .when(F.size(parsed) != F.size(F.array_distinct(parsed)), "duplicate_candidate")
        .when(F.size(F.array_except(parsed, candidates)) > 0, "unknown_candidate")
        .when(F.size(parsed) != F.size(candidates), "missing_candidate")
        .otherwise("ok")
    )


def selection_status(answer: Column, candidates: Column) -> Column:
    """ok, or the first reason why an answer isn't {"ranked_candidate_ids": a permutation of the candidates, "selected_candidate_ids": a subset of them}.

    Both keys and no others, lists of strings, nothing twice; a subset may be empty.
    """
    both = F.try_parse_json(answer)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(both), F.lit("OBJECT")), F.lit(False))
    keys = F.json_object_keys(answer)
    strings = lambda k: F.schema_of_variant(F.try_variant_get(both, f"$.{k}", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>")
    listed = lambda k: F.coalesce(F.try_variant_get(both, f"$.{k}", "array<string>"), F.array().cast("array<string>"))
    ranked, chosen = listed("ranked_candidate_ids"), listed("selected_candidate_ids")
    wrong = lambda k: ~F.coalesce(strings(k), F.lit(False))
    twice = lambda xs: F.size(xs) != F.size(F.array_distinct(xs))
    return (
        F.when(both.isNull(), "invalid_json").when(~is_object, "not_an_object")
        .when(F.array_sort(keys) != F.array(F.lit("ranked_candidate_ids"), F.lit("selected_candidate_ids")), "unexpected_keys")
        .when(wrong("ranked_candidate_ids"), "ranking_not_strings").when(F.size(ranked) != F.size(candidates), "ranking_length")
        .when(twice(ranked), "duplicate_candidate").when(F.size(F.array_except(ranked, candidates)) > 0, "unknown_candidate")
        .when(wrong("selected_candidate_ids"), "selection_not_strings").when(twice(chosen), "duplicate_selection").when(F.size(F.array_except(chosen, candidates)) > 0, "unknown_selection")
        .otherwise("ok")
    )


def unfenced(answer: Column) -> Column:
    """The body of a code fence that wraps the whole answer, else the answer."""
    inner = F.regexp_extract(answer, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(answer))


def alias_map(candidates: Column) -> Column:
    """C000, C001, ... by position."""
    names = F.transform(candidates, lambda c, i: F.format_string("C%03d", i))
    return F.map_from_arrays(names, candidates)


def decode(aliases: Column, mapping: Column) -> Column:
    """Aliases back to candidates; unknown ones give null."""
    return F.transform(aliases, lambda a: F.try_element_at(mapping, a))


def first_fault(answer: Column, candidates: Column) -> Column:
    """For an answer that broke off: the first quoted id that repeats or isn't a candidate, with its position."""
    ids = F.regexp_extract_all(answer, F.lit(r'"([^"]+)"'), F.lit(1))
    faults = F.filter(F.transform(ids, lambda x, i: F.struct(i.alias("at"), F.when(~F.array_contains(candidates, x), "out_of_pool").when(F.array_position(ids, x) <= i, "duplicate").alias("fault"))), lambda s: s["fault"].isNotNull())
    return F.when(F.size(faults) > 0, faults[0])


def native_delta(native: DataFrame, challenge: DataFrame, key: str, metric: str) -> DataFrame:
    """Matched rows of two settings and the difference of their metric."""
    both = native.select(key, F.col(metric).alias("native")).join(challenge.select(key, F.col(metric).alias("challenge")), key)
    return both.withColumn("delta", F.round(F.col("challenge") - F.col("native"), 6))


def retrieval_manifest(tasks: DataFrame, ranked: DataFrame, catalog: DataFrame, k: int, setting: str, model: str) -> DataFrame:
    """The manifest of tasks over what was retrieved for them: the first k by rank (then id) instead of candidates of their own.

    tasks: task_id, query; ranked: task_id, candidate_id, rank. Tasks without any
    retrieved candidate are left out. The same serves a machine challenge, whose
    ranks are its shuffled order.
    """
    top = ranked.where(F.col("rank") <= k).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))), lambda s: s["candidate_id"]).alias("candidates"))
    return build_manifest(tasks.join(top, "task_id").select("task_id", "query", "candidates"), catalog, setting, model)
