"""Cleaning policies of later releases, each over the one before: integrity of gold sets, explicit requirements, a judge's guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import normalize_ascii
from veridex.operators.policy import Rule, first_match, hits
from veridex.operators.semcap import GENERAL, Requirement, phrases_in

CLEAN, REMOVED, UNCERTAIN, LEAK_ONLY = "dryrun_clean_candidate", "dryrun_removed", "dryrun_uncertain", "dryrun_service_leak_only"


_COMPARED = ("level", "api_leak", "api_leak_strength", "service_leak", "space", "task_type", "semantic", "coverage", "coverage_confidence", "gold_set", "overtrust")
_FLAGS = ("domain_flags", "missing_flags")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with what the conditions read, each worked out once: `_low_` texts and `_held_` flags."""
    kept = [c for c in (*_COMPARED, *_FLAGS) if c in rows.columns]
    return rows.withColumns({f"_held_{c}" if c in _FLAGS else f"_low_{c}": flagged(c) if c in _FLAGS else normalize_ascii(F.col(c)) for c in kept})


def _without(rows: DataFrame) -> DataFrame:
    return rows.drop(*(f"_low_{c}" for c in _COMPARED), *(f"_held_{c}" for c in _FLAGS))


def _low(c: str) -> Column:
    return F.col(f"_low_{c}")


def _held(c: str) -> Column:
    return F.col(f"_held_{c}")


def _true(c: str) -> Column:
    return _low(c).isin("true", "1", "yes")


def flagged(c: str) -> Column:
    """Whether a text is JSON that holds something; blank, unreadable and empty values don't."""
    held = F.to_json(F.try_parse_json(c))
    return F.coalesce(~held.isin("", "[]", "{}", "null", "false", "0", '""'), F.lit(False))


def _listed(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), ";")


def _changed(before: tuple[str, str], decision: Column, bucket: Column, unknown: str | None) -> Column:
    """unchanged, or what it was -> what it is; `unknown` where nothing was decided before."""
    old, slot = (F.coalesce(c, F.lit("")) for c in before)
    same = F.when((old == decision) & (slot == bucket), "unchanged").otherwise(F.concat(old, F.lit(":"), slot, F.lit("->"), decision, F.lit(":"), bucket))
    return F.when(old == "", unknown).otherwise(same) if unknown else same


# -- gold sets and guards: every blocking reason, the first in order names the bucket


def _blocking() -> list[tuple[str, str, str, Column]]:
    """(reason, rule, bucket, condition) in order of priority."""
    yes = lambda c, *of: F.coalesce(F.col(c).isin(*of), F.lit(False))
    mismatch = _low("coverage") == "coverage_mismatch"
    return [
        ("api_leak", "remove_blocking_api_leak", "removed_api_leak", (_low("api_leak") == "api_leak_blocking") | (_low("api_leak_strength") == "strong")),
        ("gold_missing", "remove_gold_missing", "removed_gold_missing", ~(yes("gold_services", "yes") & yes("gold_apis", "yes", "yes_api_name_only"))),
        ("choice_space_invalid", "remove_choice_space_invalid", "removed_choice_space_invalid", _low("space").startswith("invalid")),
        ("task_type_invalid", "remove_task_type_invalid", "removed_task_type_invalid", _low("task_type").startswith("invalid")),
        ("semantic_mismatch", "remove_v12_semantic_mismatch", "removed_semantic_mismatch", _low("semantic") == "mismatch"),
        ("wrong_gold_set", "remove_wrong_gold_set", "removed_wrong_gold_set", _low("gold_set") == "extra_gold_service_detected"),
        ("domain_guard_violation", "remove_domain_specific_guard_violation", "removed_capability_mismatch", _held("domain_flags")),
        ("missing_core_requirement", "remove_missing_core_requirement", "removed_capability_mismatch", _held("missing_flags") & mismatch),
        ("capability_mismatch", "remove_v12_capability_mismatch", "removed_capability_mismatch", mismatch),
    ]


def _warnings() -> list[tuple[str, str, str, Column]]:
    """(reason, rule, bucket, condition) in order of the buckets."""
    return [
        ("generic_search_overtrusted", "uncertain_generic_search_overtrusted", "uncertain_generic_search_overtrusted", _true("overtrust")),
        ("wrong_gold_set_uncertain", "uncertain_wrong_gold_set", "uncertain_wrong_gold_set", ~_low("gold_set").isin("ok", "not_applicable")),
        ("coverage_uncertain", "uncertain_v12_semcap", "uncertain_semcap", _low("coverage") == "coverage_uncertain"),
        ("semantic_uncertain", "uncertain_v12_semantic", "uncertain_semcap", _low("semantic") == "uncertain"),
        ("weak_or_generic_api_leak", "uncertain_weak_api_leak", "uncertain_weak_api_leak", _low("api_leak") == "api_leak_weak_or_generic"),
        ("ambiguous_service_leak", "uncertain_ambiguous_service_leak", "uncertain_ambiguous_service_leak", _low("service_leak") == "ambiguous_service_leak"),
    ]


def _places(rules: list[tuple[str, str, str, Column]]) -> Column:
    """The places of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(r[3], F.lit(False)), F.lit(k)) for k, r in enumerate(rules))))


def _named(places: str, rules: list[tuple[str, str, str, Column]], part: int) -> Column:
    names = F.array(*(F.lit(r[part]) for r in rules))
    return F.transform(places, lambda k: F.get(names, k))


def integrity_policy(rows: DataFrame) -> DataFrame:
    """Adds decision, bucket, blocking, warnings, rules, confidence and change.

    Columns read: level, api_leak, api_leak_strength, service_leak, gold_services,
    gold_apis, space, task_type, semantic, coverage, coverage_confidence, gold_set
    (ok, not_applicable, extra_gold_service_detected, else doubtful), overtrust,
    domain_flags, missing_flags (JSON), before, before_bucket (strings). Blocking
    reasons decide; a service-level row that only names its service comes next, then
    doubts, which are looked for in no other rows; clean is what a detector is sure
    of. Null is blank, which no condition takes for good: an all-null row lacks its
    gold and is removed. Row-local.
    """
    blocking, doubts = _blocking(), _warnings()
    leak = (_low("level") == "service") & (_low("service_leak") == "service_leak_only")
    sure = (_low("semantic") == "ok") & (_low("coverage") == "coverage_ok") & (_low("coverage_confidence") == "high") & ~_held("missing_flags")
    none = F.array().cast("array<string>")
    out = _without(_prepared(rows).withColumns({"_blocked": _places(blocking), "_warned": _places(doubts), "_leak": leak, "_sure": sure}))
    state = F.when(F.size("_blocked") > 0, "blocked").when(F.col("_leak"), "leak").when(F.size("_warned") > 0, "doubt").when(F.col("_sure"), "clean").otherwise("unsure")
    out = out.withColumn("_state", state)
    by = lambda **of: F.coalesce(*(F.when(F.col("_state") == k, v) for k, v in of.items()))
    decision = by(blocked=F.lit(REMOVED), leak=F.lit(LEAK_ONLY), doubt=F.lit(UNCERTAIN), clean=F.lit(CLEAN), unsure=F.lit(UNCERTAIN))
    slot = lambda places, rules: F.get(_named(places, rules, 2), F.lit(0))
    bucket = by(blocked=slot("_blocked", blocking), leak=F.lit(LEAK_ONLY), doubt=slot("_warned", doubts), clean=F.lit(CLEAN), unsure=F.lit("uncertain_semcap"))
    fired = by(
        blocked=_named("_blocked", blocking, 1), leak=F.array(F.lit("separate_service_level_service_leak")), doubt=_named("_warned", doubts, 1),
        clean=F.array(F.lit("keep_v14b_clean_candidate")), unsure=none,
    )
    out = out.withColumns({"decision": decision, "bucket": bucket, "rules": _listed(fired)})
    return out.withColumns({
        "blocking": _listed(_named("_blocked", blocking, 0)), "warnings": _listed(by(blocked=none, leak=none, doubt=_named("_warned", doubts, 0), clean=none, unsure=F.array(F.lit("v12_not_high_confidence_clean")))),
        "confidence": F.when(F.col("decision") == CLEAN, "clean_candidate_high_conf").otherwise(""),
        "change": _changed(("before", "before_bucket"), F.col("decision"), F.col("bucket"), "no_v1_4_decision_available"),
    }).drop("_blocked", "_warned", "_leak", "_sure", "_state")


def dangers(rows: DataFrame) -> DataFrame:
    """Clean rows (by `decision`) that carry what must not be clean, with their flags in order of the alphabet."""
    blocking = {r[0]: r[3] for r in _blocking()}
    named = {
        "blocking_api_leak_into_clean": blocking["api_leak"], "gold_missing_into_clean": blocking["gold_missing"], "no_choice_space_into_clean": blocking["choice_space_invalid"],
        "semantic_mismatch_into_clean": blocking["semantic_mismatch"], "semantic_uncertain_into_clean": _low("semantic") == "uncertain",
        "coverage_mismatch_into_clean": blocking["capability_mismatch"], "coverage_uncertain_into_clean": _low("coverage") == "coverage_uncertain",
        "service_level_service_leak_into_clean": (_low("service_leak") == "service_leak_only") & (_low("level") == "service"), "wrong_gold_set_into_clean": blocking["wrong_gold_set"],
        "generic_search_overtrust_into_clean": _true("overtrust"), "domain_specific_guard_violation_into_clean": blocking["domain_guard_violation"], "missing_core_requirement_into_clean": _held("missing_flags"),
    }
    found = F.array_sort(hits([Rule(k, "", c) for k, c in named.items()]))
    return _without(_prepared(rows.where(F.col("decision") == CLEAN)).withColumn("flags", found)).where("size(flags) > 0")


# -- explicit requirements: clean rows must name what their queries ask for

# Signs of several requirements in a query.
CONNECTORS = ("additionally", "also", "lastly", "finally", "furthermore", "moreover", "in addition", "and i", "also provide", "please provide")
ACTIONS = (
    "recommend", "suggest", "find", "fetch", "provide", "search", "convert", "check", "generate", "analyze", "extract", "list", "details", "prices", "images", "venues", "housing", "speakers", "weather", "songs", "companies", "scientific name",
)
# News sources that gold must name if the query does.
NEWS_SOURCES = ("guardian", "reuters", "ieee spectrum", "the times")
# Fixed values: (rule, words of gold, words of a query that allow them).
EXTRAS = (
    ("crypto_or_bybit_extra_without_crypto_need", ("bybit", "cryptocurrency", "crypto", "coin"), ("crypto", "cryptocurrency", "bitcoin", "bybit", "coin")),
    ("ipl_extra_without_cricket_need", ("latest ipl", "ipl news"), ("ipl", "cricket")),
    ("energy_price_extra_without_energy_need", ("energy price news",), ("energy", "energy prices")),
    ("climate_news_extra_without_climate_need", ("climate news feed", "climate news"), ("climate", "environment")),
    ("instagram_extra_for_tiktok_need", ("instagram",), ("instagram",)),
    ("miku_or_random_image_extra_for_specific_image_need", ("mikuapi", "miku random", "random image"), ("miku", "anime", "random image")),
    ("signl4_extra_without_alerting_need", ("signl4", "critical mobile alerting"), ("alert", "incident", "mobile alert")),
)
FALLBACK = "general_information_fallback_cannot_clean_multi_requirement_query"
NO_SOURCE = "source_specific_news_missing_named_source"


def explicit_policy(rows: DataFrame, requirements: tuple[Requirement, ...], extras: tuple = EXTRAS, sources: tuple[str, ...] = NEWS_SOURCES) -> DataFrame:
    """Adds decision, bucket, blocking, warnings, rules, gaps, extra_gold (arrays), confidence and change.

    Columns read: query, gold (texts), requirements (array, what a detector found
    the query to ask for), before, before_bucket. Only rows that were clean are
    looked at; others keep what they had. A requirement whose trigger the query
    holds is a gap unless gold holds a positive phrase and no negative one (without
    positive phrases it always is); so is a news source that only the query names,
    as rule:source. Extra gold blocks first, then gaps; a query with several
    requirements of which the detector only found general information is doubtful.
    The requirement table is a parameter (`requirement_table` makes one of rows).
    All phrases form one automaton for each text.
    """
    asked = [w for r in requirements for w in r.triggers] + [w for _, _, words in extras for w in words] + [*sources, *CONNECTORS, *ACTIONS]
    given = [w for r in requirements for w in (*r.positive, *r.negative)] + [w for _, words, _ in extras for w in words] + list(sources)
    number = {side: {w: k for k, w in enumerate(sorted(set(words)))} for side, words in (("q", asked), ("g", given))}
    clean = F.coalesce(F.col("before") == CLEAN, F.lit(False))
    text = {side: F.coalesce(normalize_ascii(F.when(clean, F.col(c))), F.lit("")) for side, c in (("q", "query"), ("g", "gold"))}
    found = rows.withColumns({f"_{side}": phrases_in(text[side], tuple(number[side])) for side in "qg"})
    listed = lambda side, words: F.array(*(F.lit(number[side][w]) for w in words)).cast("array<int>")
    has = lambda side, words: F.arrays_overlap(f"_{side}", listed(side, words)) if words else F.lit(False)
    some = lambda words: F.size(F.array_intersect("_q", listed("q", words)))
    several = (some(CONNECTORS) >= 1) | (some(ACTIONS) >= 3) | (F.length(F.regexp_replace(text["q"], "[^?]", "")) >= 2)
    kept = F.filter(F.transform(F.coalesce("requirements", F.array().cast("array<string>")), lambda x: normalize_ascii(x)), lambda x: x != "")
    fallback = clean & (kept == F.array(F.lit(GENERAL))) & several
    gaps = [(r.label, has("q", r.triggers) & (~has("g", r.positive) | has("g", r.negative))) for r in requirements]
    gaps += [(f"{NO_SOURCE}:{s}", has("q", (s,)) & ~has("g", (s,))) for s in sources]
    extra = [(name, has("g", words) & ~has("q", allowed)) for name, words, allowed in extras]
    of = lambda pairs: hits([Rule(k, "", c) for k, c in pairs])
    out = found.withColumns({"gaps": of(gaps), "extra_gold": of(extra), "_fallback": fallback})
    wrong, gap = F.size("extra_gold") > 0, F.size("gaps") > 0
    decision = F.when(~clean, F.coalesce("before", F.lit(""))).when(wrong | gap, REMOVED).when(F.col("_fallback"), UNCERTAIN).otherwise(F.col("before"))
    bucket = F.when(~clean, F.coalesce("before_bucket", F.lit(""))).when(wrong, "removed_wrong_gold_set").when(gap, "removed_capability_mismatch").when(F.col("_fallback"), "uncertain_semcap_general_information_fallback").otherwise(F.coalesce("before_bucket", F.lit("")))
    rules = of([
        ("v14c_gold_set_integrity_hard_gate", wrong), ("v14c_domain_specific_requirement_explicit_match", gap), ("v14c_general_information_fallback_blocking", F.col("_fallback")),
        ("keep_v14c_clean_candidate", clean & ~wrong & ~gap & ~F.col("_fallback")), ("preserve_v14b_non_clean_decision", ~clean),
    ])
    out = out.withColumns({"decision": decision, "bucket": bucket, "rules": _listed(rules), "blocking": _listed(of([("wrong_gold_set", wrong), ("domain_specific_gap", gap)])), "warnings": F.when(F.col("_fallback"), "general_information_fallback").otherwise("")})
    return out.withColumns({
        "gaps": F.when(F.col("_fallback"), F.array_prepend("gaps", F.lit(FALLBACK))).otherwise(F.col("gaps")),
        "confidence": F.when(F.col("decision") == CLEAN, "clean_candidate_high_conf").otherwise(""), "change": _changed(("before", "before_bucket"), F.col("decision"), F.col("bucket"), None),
    }).drop("_q", "_g", "_fallback")


# -- a judge's answers over clean rows, guarded: the first rule that holds decides

# Blocking reasons that no judge overrules.
HARD = ("api_leak", "gold_missing", "choice_space", "service_leak", "task_type")


def _some_listed(c: str) -> Column:
    """Whether a text is a JSON list with elements, or no JSON at all and not empty."""
    held = F.to_json(F.try_parse_json(c))
    return F.coalesce(F.when(held.isNull(), F.col(c) != "").otherwise(held.startswith("[") & (held != "[]")), F.lit(False))


def judge_policy(rows: DataFrame, prefix: str = "judge") -> DataFrame:
    """Adds decision, bucket and reason.

    Columns read: before, before_bucket, blocking, and the judge's parse_status
    (null: no answer), semantic, coverage, missing_json, extra_json, overtrust, gap,
    wrong_gold ("true" or else), risk (strings). Decisions and buckets begin with
    the prefix.
    """
    reasons = F.lower(F.coalesce("blocking", F.lit("")))
    is_true = lambda c: F.lower(F.coalesce(c, F.lit(""))) == "true"
    up = lambda s: f"{prefix}_{s}"
    good = (F.col("semantic") == "ok") & (F.col("coverage") == "coverage_ok") & F.col("risk").isin("low", "medium")
    table = [
        *((up("removed_hard_policy_block"), up("hard_policy_block"), f"hard_policy:{m}", reasons.contains(m)) for m in HARD),
        (up("uncertain_missing_prediction"), up("missing_prediction"), "missing_prediction", F.col("parse_status").isNull()),
        (up("uncertain_parse_failed"), up("parse_failed"), "parse_status", F.col("parse_status") != "ok"),
        (up("removed_semantic_mismatch"), up("removed_semantic_mismatch"), "semantic_mismatch", F.col("semantic") == "mismatch"),
        (up("uncertain_semcap"), up("uncertain_semantic_alignment"), "semantic_uncertain", F.col("semantic") == "uncertain"),
        (up("removed_capability_mismatch"), up("removed_capability_mismatch"), "coverage_mismatch", F.col("coverage") == "coverage_mismatch"),
        (up("uncertain_semcap"), up("uncertain_capability_coverage"), "coverage_uncertain", F.col("coverage") == "coverage_uncertain"),
        (up("removed_or_uncertain_missing_requirement"), up("missing_requirement"), "missing_requirements_nonempty", _some_listed("missing_json")),
        (up("removed_wrong_gold_set"), up("extra_unrelated_gold"), "extra_unrelated_gold_services", _some_listed("extra_json")),
        (up("uncertain_or_removed_generic_search_overtrust"), up("generic_search_overtrust"), "generic_search_overtrust", is_true("overtrust")),
        (up("removed_capability_mismatch"), up("domain_specific_gap"), "domain_specific_gap", is_true("gap")),
        (up("removed_wrong_gold_set"), up("wrong_gold_set"), "wrong_gold_set", is_true("wrong_gold")),
        (up("assisted_clean_candidate"), up("assisted_clean_candidate"), "all_conditions_passed", good),
        (up("uncertain_semcap"), up("uncertain_residual"), "residual_uncertain", F.lit(True)),
    ]
    clean = F.coalesce(F.col("before") == CLEAN, F.lit(False))
    pick = lambda k: first_match([Rule("", row[k], row[3]) for row in table], "")
    given = F.when(F.col("parse_status").isNotNull(), F.concat(F.lit("parse_status:"), "parse_status"))
    reason = F.when(pick(2) == "parse_status", given).otherwise(pick(2))
    return rows.withColumns({
        "decision": F.when(clean, pick(0)).otherwise(F.coalesce("before", F.lit("dryrun_not_clean"))), "bucket": F.when(clean, pick(1)).otherwise(F.coalesce("before_bucket", F.lit(""))),
        "reason": F.when(clean, reason).otherwise("not_a_clean_candidate"),
    })
