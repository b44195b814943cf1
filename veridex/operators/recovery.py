"""Recovery of tasks that a gate rejected: what can be repaired, which negatives may be used, and how a rebuilt candidate space stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions.text import content_tokens, normalize_ascii, present
from veridex.plans.scratch import Scratch

# Reasons by other names, and the classes of reasons.
SYNONYMS = {
    "endpoint_service_count_lt_2": "gold_service_count_lt_2", "endpoint_api_count_lt_2": "gold_api_count_lt_2", "no_cross_service_edge": "no_cross_service_strong_edge", "same_service_only": "same_service_only_dependency",
    "failed_dependency_edge": "failed_or_error_dependency_edge", "failed_call_dependency": "failed_or_error_dependency_edge", "normalized_record_missing": "source_unavailable", "unresolved_service_mapping": "source_mapping_unresolved",
}
LEAKS = ("exact_blocking_service_name_leak", "exact_blocking_api_name_leak")
SPACES = ("service_candidate_space_invalid", "api_candidate_space_invalid")
SHARED = ("shared_input_only", "shared_input_only_dependency", "sequence_only", "sequence_only_dependency", "no_objective_dependency_evidence")
HARD = (
    (("failed_or_error_dependency_edge", "failed_or_error_gold_call"), "HARD_UNRECOVERABLE_FAILED_DEPENDENCY"), (("gold_service_count_lt_2",), "HARD_UNRECOVERABLE_GOLD_SERVICE_COUNT_LT_2"),
    (("same_service_only_dependency",), "HARD_UNRECOVERABLE_SAME_SERVICE_ONLY"), (("no_cross_service_strong_edge",), "HARD_UNRECOVERABLE_NO_CROSS_SERVICE_EDGE"),
    (("only_redundant_recomputation_dependency",), "HARD_UNRECOVERABLE_REDUNDANCY_ONLY"), (SHARED, "HARD_UNRECOVERABLE_SHARED_INPUT_OR_SEQUENCE_ONLY"),
)


def classify(reasons: Column, existing: Column, available: Column) -> Column:
    """What can be done for a task with these reasons (array); the first class that fits counts."""
    known = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    names = F.array_distinct(F.transform(F.filter(reasons, lambda r: present(r).isNotNull()), lambda r: F.coalesce(F.element_at(known, F.trim(r)), F.trim(r))))
    any_of = lambda xs: F.arrays_overlap(names, F.array(*map(F.lit, xs)))
    only = lambda xs: (F.size(names) > 0) & (F.size(F.array_except(names, F.array(*map(F.lit, xs)))) == 0)
    out = F.when(existing, "AUTHORITATIVE_VALID_EXISTING").when(~available | F.array_contains(names, "source_unavailable"), "SOURCE_UNAVAILABLE_HOLD")
    for which, status in HARD:
        out = out.when(any_of(which), status)
    return out.when(only(LEAKS), "REPAIRABLE_EXACT_LEAK_ONLY").when(only(SPACES), "REPAIRABLE_CANDIDATE_SPACE_ONLY").when(only(LEAKS + SPACES), "REPAIRABLE_LEAK_AND_CANDIDATE_SPACE").otherwise("OTHER_HOLD")


def is_forbidden_negative(flag: Column, *labels: Column) -> Column:
    """Services and APIs for tests and demonstrations never serve as negatives."""
    text = F.lower(F.concat_ws(" ", *labels))
    return F.coalesce(flag, F.lit(False)) | text.rlike(r"\b(?:demo|test|healthcheck|health check|ping endpoint)\b")


def has_alias_conflict(names: Column) -> Column:
    """Two items of one list that normalise to the same identifier."""
    flat = F.filter(F.transform(names, lambda n: F.regexp_replace(normalize_ascii(n), "[^a-z0-9]+", "")), lambda n: n != "")
    return F.size(flat) != F.size(F.array_distinct(flat))


def _by_case(df: DataFrame, *columns: str) -> DataFrame:
    """Rows for each of the four cases of keys: service and domain, either, neither; a null key is in no case."""
    service, domain, none = F.col("service").cast("string"), F.col("domain").cast("string"), F.lit("")
    cases = F.array(*(F.struct(F.lit(k).alias("case"), a.alias("a"), b.alias("b")) for k, (a, b) in enumerate(((service, domain), (service, none), (none, domain), (none, none)))))
    return df.select(*columns, F.inline(cases)).where("a is not null and b is not null")


def _met(asks: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(ask_id, candidate): in each case the `most` items that share most words with an ask, and the `most` first by key.

    Items that have the same words of those that any ask has, and the same keys,
    differ by their own key only, so the first `most` of them stand for all.
    """
    keys = ["case", "a", "b"]
    items = _by_case(items, "candidate", "have")
    rank = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = items.withColumn("k", rank(keys, "candidate")).where(F.col("k") <= most).select("candidate", *keys)
    few = items.where("have != ''").withColumn("k", rank([*keys, "have"], "candidate")).where(F.col("k") <= most)
    words = few.select("candidate", *keys, F.explode(F.split("have", " ")).alias("w"))
    asking = _by_case(asks.where("ask != ''"), "ask").distinct()
    shared = asking.select("ask", *keys, F.explode(F.split("ask", " ")).alias("w")).join(words.hint("merge"), [*keys, "w"]).groupBy("ask", *keys, "candidate").agg(F.count("*").alias("overlap"))
    shared = shared.withColumn("k", rank(["ask", *keys], F.desc("overlap"), "candidate")).where(F.col("k") <= most).select("ask", *keys, "candidate")
    placed = _by_case(asks, "ask_id", "ask")
    return placed.join(shared.hint("merge"), ["ask", *keys]).select("ask_id", "candidate").unionByName(placed.join(first.hint("merge"), keys).select("ask_id", "candidate")).distinct()


def rebuilt_candidates(tasks: DataFrame, pool: DataFrame, target: int = 12) -> DataFrame:
    """(task_id, candidate, r): the best of the pool until max(target, gold + 1) candidates are there.

    Same service first, then same domain, then the number of distinct topic words
    that item and query share, then by key. tasks: task_id, query, service, domain,
    gold (array); pool: candidate, service, domain, document. Tasks of the same
    service, domain and words ask for the same, so the order is worked out once
    for each such ask, as far as its largest task can need, and a task takes the
    first of it that aren't its gold. For each of the four cases (service and
    domain, either, neither) an ask meets as many of the items that share most
    words with it, and of the first by key, as the largest target can ask for:
    what it brings to the exchange doesn't grow with the pool, and a word that all
    items have pairs each set of asked words once with each set of such words that
    items have. Tables that grow with the input are joined by shuffles only: as
    compressed files they look small enough to be broadcast, and are not.
    """
    need = F.greatest(F.lit(target), F.size("gold") + 1) - F.size("gold")
    spelled = lambda words: F.array_join(F.array_sort(F.array_distinct(words)), " ")
    scratch = Scratch(tasks.sparkSession, "rebuilt")
    asked = scratch.keep(tasks.select("task_id", "service", "domain", "gold", need.alias("need"), spelled(content_tokens(F.col("query"))).alias("ask")))
    asks = asked.groupBy("service", "domain", "ask").agg(F.max(F.size("gold") + F.col("need")).alias("upto"))
    asks = scratch.keep(asks.withColumn("ask_id", F.monotonically_increasing_id()))
    items = pool.select("candidate", "service", "domain", F.array_distinct(content_tokens(F.col("document"))).alias("tokens"))
    some = asks.select(F.explode(F.split("ask", " ")).alias("w")).distinct()
    known = items.select("candidate", F.explode("tokens").alias("w")).join(some.hint("merge"), "w", "left_semi").groupBy("candidate").agg(spelled(F.collect_set("w")).alias("have"))
    items = scratch.keep(items.join(known.hint("merge"), "candidate", "left").withColumn("have", F.coalesce("have", F.lit(""))))
    most = asks.agg(F.max("upto").alias("m")).first()["m"] or 0
    rows = _met(asks, items, most).join(asks.select("ask_id", F.col("service").alias("ts"), F.col("domain").alias("td"), F.split("ask", " ").alias("words"), "upto").hint("merge"), "ask_id").join(items.drop("have").hint("merge"), "candidate")
    yes = lambda c: F.when(c, 0).otherwise(1)
    order = Window.partitionBy("ask_id").orderBy(yes(F.col("service") == F.col("ts")), yes(F.col("domain") == F.col("td")), F.desc(F.size(F.array_intersect("words", "tokens"))), "candidate")
    best = rows.withColumn("k", F.row_number().over(order)).where("k <= upto").groupBy("ask_id").agg(F.sort_array(F.collect_list(F.struct("k", "candidate"))).alias("best"))
    best = asks.drop("upto").join(best.hint("merge"), "ask_id").select(F.col("service").alias("ts"), F.col("domain").alias("td"), F.col("ask").alias("words"), F.col("best.candidate").alias("best"))
    same = (F.col("ask") == F.col("words")) & F.col("service").eqNullSafe(F.col("ts")) & F.col("domain").eqNullSafe(F.col("td"))
    left = F.slice(F.filter("best", lambda c: ~F.array_contains("gold", c)), 1, F.col("need"))
    placed = asked.join(best.hint("merge"), same).select("task_id", F.posexplode(left).alias("r", "candidate"))
    return placed.select("task_id", "candidate", (F.col("r") + 1).alias("r"))


def rebuilt_status(gold: Column, known: Column, candidates: Column, gold_names: Column, names: Column, parents_missing: Column) -> Column:
    """How a rebuilt space stands, in this order; known are the gold ids that the catalog has."""
    return (
        F.when(F.size(F.array_except(gold, known)) > 0, "GOLD_NOT_IN_CATALOG").when(has_alias_conflict(gold_names), "ALIAS_CONFLICT").when(parents_missing, "PARENT_MAPPING_MISSING").when(has_alias_conflict(names), "ALIAS_CONFLICT")
        .when((F.size(gold) == 0) | (F.size(F.array_except(gold, candidates)) > 0) | (F.size(F.array_distinct(candidates)) <= F.size(F.array_distinct(gold))), "CATALOG_INSUFFICIENT").otherwise("RECONSTRUCTED_VALID")
    )
