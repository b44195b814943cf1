"""Completed human reviews: row contracts, freezing, coverage samples, and answers with ordered error codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import is_iso_timestamp, nfkc, text_or_empty

# What each review field may hold.
ALLOWED = {
    "semantic_alignment_check": ("aligned", "misaligned", "uncertain"),
    "gold_validity_check": ("true", "false", "uncertain"),
    "candidate_validity_check": ("true", "false", "uncertain"),
    "service_catalog_check": ("pass", "fail", "uncertain"),
    "task_type_check": ("pass", "fail", "uncertain"),
    "leakage_check": ("no_blocking_leak", "blocking_leak", "uncertain"),
    "dependency_check": ("true", "false", "uncertain", "not_applicable_parallel_multi"),
    "final_decision": ("keep", "remove", "uncertain"),
    "severity": ("none", "minor", "major", "critical"),
}
PARALLEL = "not_applicable_parallel_multi"


def review_errors(reviews: DataFrame, composable: str = "composable") -> DataFrame:
    """The fields of every review that break its contract, in order; a missing column counts as blank."""
    value = lambda f: text_or_empty(F.col(f)) if f in reviews.columns else F.lit("")
    decision, severity, dependency = value("final_decision"), value("severity"), value("dependency_check")
    checks = [F.when(~value(f).isin(*allowed), F.lit(f)) for f, allowed in ALLOWED.items()]
    checks += [
        F.when((decision == "remove") & (value("error_type") == ""), F.lit("error_type")),
        F.when((decision == "uncertain") & (value("notes") == ""), F.lit("notes")),
        F.when((decision == "keep") & severity.isin("major", "critical"), F.lit("severity:keep")),
        F.when(F.col(composable) & (dependency == PARALLEL), F.lit("dependency_check:composable")),
        F.when(~F.col(composable) & (dependency != PARALLEL), F.lit("dependency_check:ordinary")),
        F.when(~F.coalesce(is_iso_timestamp(value("reviewed_at")), F.lit(False)), F.lit("reviewed_at")),
    ]
    return reviews.withColumn("errors", F.array_compact(F.array(*checks)))


def disagreements(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right) where two reviews of one row differ."""
    a, b = (df.select(key, *(F.col(f).cast("string").alias(f"{side}_{f}") for f in fields)) for side, df in (("l", left), ("r", right)))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left"), F.col(f"r_{f}").alias("right")) for f in fields))
    rows = a.join(b, key).select(key, F.explode(F.filter(cells, lambda c: ~c["left"].eqNullSafe(c["right"]))).alias("c"))
    return rows.select(key, "c.*")


def freeze(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The rows without those decided `remove`; refuses while a decision is open or uncertain."""
    open_ones = decisions.where(F.coalesce("final_decision", F.lit("")).isin("", "uncertain")).limit(1).count()
    if open_ones:
        raise ValueError("decisions are unresolved")
    return rows.join(decisions.where("final_decision = 'remove'").select(key), key, "left_anti")


def source_status(text: Column, statuses: tuple[str, ...] = ("allowed", "restricted", "unknown")) -> Column:
    """The status that a document's source-terms marker names, if exactly one does."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"source-terms:\s*(" + "|".join(statuses) + r")\b"), F.lit(1)))
    return F.when(F.size(found) == 1, found[0])


def normalize_scalar(value: Column) -> Column:
    """A comparable form of a value: NFKC, booleans and missing ones are empty, numbers lose trailing zeros, text is folded."""
    v = F.lower(F.trim(F.coalesce(nfkc(value), F.lit(""))))
    number = F.regexp_replace(F.regexp_replace(v, r"^\+", ""), r"(\.\d*?)0+$", "$1")
    return F.when(v.isin("true", "false", "none", "null"), "").when(v.rlike(r"^[+-]?\d+(\.\d+)?$"), F.regexp_replace(number, r"\.$", "")).otherwise(F.regexp_replace(v, r"\s+", " "))


def answer_code(answer: Column, limit: int = 4000) -> Column:
    """EMPTY, TOO_LONG, FENCED_PART, NOT_JSON, NOT_OBJECT, REFUSAL or OK, in this order; a fence may only wrap the whole answer."""
    body = F.trim(F.coalesce(answer, F.lit("")))
    fenced = body.rlike(r"(?s)^```.*```$")
    inner = F.when(fenced, F.regexp_replace(body, r"(?s)^```(?:json)?\s*|\s*```$", "")).otherwise(body)
    return (
        F.when(body == "", "EMPTY")
        .when(F.length(body) > limit, "TOO_LONG")
        .when(~fenced & body.contains("```"), "FENCED_PART")
        .when(F.lower(inner).rlike(r"^(i'm sorry|i cannot|i can't)"), "REFUSAL")
        .when(F.try_parse_json(inner).isNull(), "NOT_JSON")
        .when(~inner.startswith("{"), "NOT_OBJECT")
        .otherwise("OK")
    )


def coverage_sample(rows: DataFrame, features: dict[str, Column], order: str, k: int) -> DataFrame:
    """k rows in order, but each feature's first row comes before rows that add no feature. `order` tells rows apart."""
    if not features:
        return rows.orderBy(order).limit(k)
    least = rows.agg(F.array_compact(F.array(*(F.min(F.when(c, F.col(order))) for c in features.values()))).alias("_first"))  # one row
    tier = F.when(F.array_contains("_first", F.col(order)), 0).otherwise(1)
    return rows.join(F.broadcast(least), F.lit(True)).withColumn("_t", tier).orderBy("_t", order).limit(k).drop("_t", "_first")


def quality_order(rows: DataFrame, weights: dict[str, float], row_id: str, k: int) -> DataFrame:
    """The k rows of highest weighted signal score, ties by id."""
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return rows.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), row_id).limit(k)


# What a review policy must state, and which modes there are.
POLICY_FIELDS = ("schema_version", "policy_id", "review_mode", "authoritative_round", "secondary_review_role", "require_independent_secondary_reviewer", "require_adjudication")
REVIEW_MODES = ("single_human_review", "independent_double_review")


def policy_errors(policies: DataFrame, key: str, fields: str = "fields") -> DataFrame:
    """(key, errors) of review policies given as a map of strings: missing fields, unknown modes and rounds, and demands that a single review can't meet."""
    at = lambda k: F.element_at(fields, F.lit(k))
    true = lambda k: F.lower(F.coalesce(at(k), F.lit(""))) == "true"
    single = at("review_mode") == "single_human_review"
    checks = [F.when(at(f).isNull(), F.lit(f"missing:{f}")) for f in POLICY_FIELDS]
    checks += [
        F.when(~at("review_mode").isin(*REVIEW_MODES), F.lit("unsupported_review_mode")), F.when(at("authoritative_round") != "primary", F.lit("authoritative_round")),
        F.when(single & (at("secondary_review_role") != "supplemental_non_gating"), F.lit("single:secondary_review_role")), F.when(single & (true("require_independent_secondary_reviewer") | true("require_adjudication")), F.lit("single:requires_second_reader")),
    ]
    return policies.select(key, F.array_compact(F.array(*checks)).alias("errors"))


def resolve_rounds(sample: DataFrame, reviews: DataFrame, single: bool = False) -> DataFrame:
    """The standing of every sampled task: its final decision, and how it came about.

    sample: task_id, task_type, secondary (is a second reading due); reviews:
    task_id, round (inherited, primary, secondary, adjudication), reviewer, decision.
    A primary review replaces an inherited one. Where the readings differ, only an
    adjudicator who is neither reader settles them.
    """
    best = reviews.groupBy("task_id").pivot("round", ["inherited", "primary", "secondary", "adjudication"]).agg(F.max(F.struct("decision", "reviewer")))
    df = sample.join(best, "task_id", "left").withColumn("first", F.coalesce("primary", "inherited"))
    due = F.col("secondary_due") if "secondary_due" in sample.columns else F.lit(False)
    differ = F.col("first.decision") != F.col("secondary.decision")
    referee = F.col("adjudication").isNotNull() & ~F.col("adjudication.reviewer").isin(F.col("first.reviewer"), F.col("secondary.reviewer")) & F.lit(not single)
    status = (
        F.when(F.col("first").isNull(), "primary_pending").when(~due, "single_human_review_complete").when(F.col("secondary").isNull(), "secondary_pending")
        .when(differ & referee, "human_adjudicated").when(differ, "adjudication_pending").otherwise("double_review_agreement")
    )
    final = F.when(status == "human_adjudicated", F.col("adjudication.decision")).when(status.isin("single_human_review_complete", "double_review_agreement"), F.col("first.decision"))
    return df.select("task_id", "task_type", status.alias("resolution"), final.alias("final_decision"), (F.col("first.reviewer") == F.col("secondary.reviewer")).alias("same_reader"))


def task_rollup(resolved: DataFrame) -> DataFrame:
    """Counts and the review state of each task type; open rows come before uncertain ones, those before removals."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    by = resolved.groupBy("task_type").agg(F.count("*").alias("sampled"), *(n(F.col("final_decision") == d).alias(d) for d in ("keep", "remove", "uncertain")), n(F.col("final_decision").isNull()).alias("pending"), n(F.col("resolution").isin("adjudication_pending", "human_adjudicated")).alias("disagreements"))
    status = F.when(F.col("pending") > 0, "HUMAN_REVIEW_PENDING").when(F.col("uncertain") > 0, "QA_ACTION_REQUIRED").when(F.col("remove") > 0, "QA_REVIEW_COMPLETE_WITH_EXCLUSIONS").otherwise("QA_REVIEW_COMPLETE")
    return by.withColumn("status", status)


@dataclass(frozen=True)
class Finding:
    """A row of a review rule table: what is wrong where, what stands there and what was expected."""

    severity: str
    code: str
    field: str
    when: Column
    observed: Column
    expected: str


def findings(rows: DataFrame, row_id: str, rules: list[Finding]) -> DataFrame:
    """(row_id, severity, code, field, observed, expected) for every rule that a row breaks; a null condition isn't broken."""
    each = F.array(*(F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), F.lit(r.field).alias("field"), r.observed.cast("string").alias("observed"), F.lit(r.expected).alias("expected"))) for r in rules))
    return rows.select(row_id, F.explode(F.array_compact(each)).alias("f")).select(row_id, "f.*")


def target_rules(target: str) -> list[Finding]:
    """What a review for `target` (service or api) must hold: the checks of that target decided, the other's not applicable, and a decision that they allow."""
    other = "api" if target == "service" else "service"
    v = lambda f: text_or_empty(F.col(f))
    own = [f"{target}_{x}" for x in ("gold_complete", "candidate_space_valid", "leakage_final")]
    wrong = lambda f: ~v(f).isin("true", "false", "uncertain")
    failed = v(own[0]).eqNullSafe("false") | v(own[1]).eqNullSafe("false")
    return [
        *(Finding("ERROR", "TARGET_CHECK_NOT_DECIDED", f, (F.col("target") == target) & wrong(f), v(f), "true|false|uncertain") for f in own),
        *(Finding("ERROR", "OTHER_TARGET_DECIDED", f, (F.col("target") == target) & (v(f) != "not_applicable"), v(f), "not_applicable") for f in (x.replace(target, other, 1) for x in own)),
        Finding("ERROR", "KEEP_WITH_FAILED_CHECK", "final_decision", (F.col("target") == target) & (v("final_decision") == "keep") & failed, v("final_decision"), "remove|uncertain"),
        Finding("WARNING", "KEEP_WITH_UNCERTAIN_CHECK", "final_decision", (F.col("target") == target) & (v("final_decision") == "keep") & F.lit("uncertain").isin(*(v(f) for f in own)), v("final_decision"), "uncertain"),
    ]


# The keys of a request to a model, and names that must never reach one.
REQUEST_KEYS = ("request_id", "prompt", "candidate_ids", "decoding_config", "timeout_seconds")
SECRET_KEYS = ("reference_gold_ids", "acceptable_solutions", "retrieval_gold_recall", "retrieval_gold_completeness", "gold_count", "evaluation_truth", "truth", "source_path", "source_pointer", "identity_decision")
SECRET_PREFIXES = ("qa_", "reviewer", "split_membership")


def json_keys(document: Column) -> Column:
    """Every key of a JSON text at any depth: strings are read one after the other, and those before a colon are keys."""
    strings = F.regexp_extract_all(document, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    return F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.regexp_replace(s, r'^"|"\s*:$', ""))


def boundary_issues(requests: DataFrame, row_id: str, request: str) -> DataFrame:
    """(row_id, issues) of requests as JSON texts: not an object, wrong top-level keys, forbidden keys at any depth (the prompt's own JSON included), or candidates in another order than in the prompt."""
    r = F.col(request)
    top = F.array_sort(F.json_object_keys(r))
    prompt = F.get_json_object(r, "$.prompt")
    payload = F.regexp_extract(prompt, r"(?m)^INPUT_JSON=(.*)$", 1)
    lines = F.size(F.regexp_extract_all(prompt, F.lit(r"(?m)^INPUT_JSON="), F.lit(0)))
    keys = F.transform(F.concat(json_keys(r), json_keys(payload)), F.lower)
    bad = F.exists(keys, lambda k: k.isin(*SECRET_KEYS) | F.greatest(*(k.startswith(p) for p in SECRET_PREFIXES)))
    ids = F.from_json(F.get_json_object(r, "$.candidate_ids"), "array<string>")
    seen = F.from_json(payload, "candidate_documents array<struct<candidate_id:string,document:string>>")["candidate_documents"]
    ordered = F.transform(seen, lambda d: d["candidate_id"])
    checks = [
        F.when(top.isNull(), F.lit("not_an_object")), F.when(top.isNotNull() & (top != F.array(*map(F.lit, sorted(REQUEST_KEYS)))), F.lit("top_level_keys")), F.when(prompt.isNotNull() & (lines != 1), F.lit("input_json_lines")),
        F.when(bad, F.lit("forbidden_key")), F.when((lines == 1) & ~F.coalesce(ids == ordered, F.lit(False)), F.lit("candidate_order")),
    ]
    return requests.select(row_id, F.array_compact(F.array(*checks)).alias("issues"))
