"""Cleaning policies as tables over the rule engines of `policy`: conditions are data, the order of evaluation is the policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import normalize_ascii, present
from veridex.operators.policy import Rule, first_match, hit_policy, hits


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds one of the phrases."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Phrases:
    """A rule that holds where every list of `need` has a phrase in its text, and none of `lack` has; texts are named by column."""

    name: str
    action: str
    need: tuple[tuple[str, tuple[str, ...]], ...]
    lack: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def rule(self) -> Rule:
        when = F.lit(True)
        for column, words in self.need:
            when = when & has_any(F.col(column), words)
        for column, words in self.lack:
            when = when & ~has_any(F.col(column), words)
        return Rule(self.name, self.action, when)


# -- the full cleaning policy: all blocking reasons, then service leaks, then warnings, then keep


def clean_policy(rows: DataFrame) -> DataFrame:
    """decision, bucket, blocking, warnings and confidence of rows with detector results.

    Columns: level (service, api), api_leak, api_leak_strength, service_leak,
    gold_services, gold_apis (yes, no, yes_api_name_only, unknown), space, task_type,
    semantic, coverage, semantic_confidence, coverage_confidence, parse_error.
    """
    low = lambda c: normalize_ascii(F.col(c))
    blocking = [
        Rule("api_leak", "remove", (low("api_leak") == "api_leak_blocking") | (low("api_leak_strength") == "strong")),
        Rule("gold_missing", "remove", ~(F.coalesce(F.col("gold_services") == "yes", F.lit(False)) & F.coalesce(F.col("gold_apis").isin("yes", "yes_api_name_only"), F.lit(False)))),
        Rule("choice_space_invalid", "remove", low("space").startswith("invalid")),
        Rule("task_type_invalid", "remove", low("task_type").startswith("invalid")),
        Rule("semantic_mismatch", "remove", low("semantic") == "mismatch"),
        Rule("capability_mismatch", "remove", low("coverage") == "coverage_mismatch"),
    ]
    semcap = (low("semantic") == "uncertain") | (low("coverage") == "coverage_uncertain")
    missing = present(F.col("semantic")).isNull() | present(F.col("coverage")).isNull()
    warnings = [
        Rule("semantic_uncertain", "warn", low("semantic") == "uncertain"),
        Rule("coverage_uncertain", "warn", low("coverage") == "coverage_uncertain"),
        Rule("weak_or_generic_api_leak", "warn", low("api_leak") == "api_leak_weak_or_generic"),
        Rule("ambiguous_service_leak", "warn", low("service_leak") == "ambiguous_service_leak"),
        Rule("detector_parse_error", "warn", present(F.col("parse_error")).isNotNull()),
        Rule("missing_semantic_capability", "warn", missing),
    ]
    clean = (low("semantic") == "ok") & (low("coverage") == "coverage_ok")
    leaks = (low("level") == "service") & (low("service_leak") == "service_leak_only")
    uncertain = (
        F.when(semcap, "uncertain_semcap").when(low("api_leak") == "api_leak_weak_or_generic", "uncertain_weak_api_leak").when(low("service_leak") == "ambiguous_service_leak", "uncertain_ambiguous_service_leak")
        .when(present(F.col("parse_error")).isNotNull(), "uncertain_detector_parse_error").otherwise("dryrun_uncertain")
    )
    blocked, warned = hits(blocking), hits(warnings)
    extra = F.when((F.size(blocked) == 0) & (F.size(warned) == 0) & ~leaks & ~clean, F.array(F.lit("semcap_not_clean_ok"))).otherwise(F.array().cast("array<string>"))
    bucket = F.when(F.size(blocked) > 0, F.concat(F.lit("removed_"), F.get(blocked, F.lit(0)))).when(leaks, "dryrun_service_leak_only").when(F.size(warned) > 0, uncertain).when(clean, "dryrun_clean_candidate").otherwise("uncertain_semcap")
    decision = F.when(F.size(blocked) > 0, "dryrun_removed").when(leaks, "dryrun_service_leak_only").when(F.size(warned) > 0, "dryrun_uncertain").when(clean, "dryrun_clean_candidate").otherwise("dryrun_uncertain")
    sure = (low("semantic_confidence") == "high") & (low("coverage_confidence") == "high")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ";")
    return rows.withColumns({
        "decision": decision, "bucket": bucket, "blocking": listed(blocked), "warnings": listed(F.concat(warned, extra)),
        "confidence": F.when(decision == "dryrun_clean_candidate", F.when(sure, "clean_candidate_high_conf").otherwise("clean_candidate_medium_conf")).otherwise(""),
    })


# -- the tightening policy: rule hits on query and gold texts; remove beats downgrade beats keep

# Phrases of the query (q) and of the gold services and APIs (g).
_TRAVEL = ("hotel", "restaurant", "attraction", "tourist", "flight", "vacation", "trip", "concert", "venue", "book a table")
_DEMO = ("healthcheck", "checkhealth", "sandbox", "dummy", "sample", "deprecated", "test endpoint", "ping", '"hello"', '"home"', "demo project")
TIGHTENING = (
    Phrases("R5_dummy_test_endpoint_gate", "remove", (("g", _DEMO),)),
    Phrases("R6_object_scope_gate", "remove", (("q", ("package", "parcel", "mail", "postal", "delivery", "tracking number")), ("g", ("container", "freight", "bill of lading")))),
    Phrases("R6_object_scope_gate", "remove", (("q", ("postal code", "address", "neighborhood", "geolocation", "geocode", "latitude", "longitude")),), (("g", ("postal", "address", "geocod", "latitude", "longitude", "zip")),)),
    Phrases("R6_object_scope_gate", "remove", (("q", ("city", "city name")), ("g", ("zip code", "zipcode", "zip"))), (("g", ("city", "geocod", "address")),)),
    Phrases("R6_object_scope_gate", "remove", (("q", ("city", "cities", "san francisco", "istanbul", "tokyo", "new york")), ("g", ("lat/lon", "latitude", "longitude"))), (("g", ("city", "geocod", "address")),)),
    Phrases("R6_object_scope_gate", "remove", (("q", ("istanbul", "turkey", "turkish")), ("g", ("pridnestrovie", "transnistria")))),
    Phrases("R6_object_scope_gate", "remove", (("q", ("san francisco", "california")), ("g", ("septa", "philadelphia")))),
    Phrases("R6_object_scope_gate", "downgrade", (("q", ("forecast", "tomorrow", "next day", "next three", "next 3", "weekend", "from saturday", "14 days")), ("g", ("current weather", "current temperature", "sunrise", "sunset"))), (("g", ("forecast",)),)),
    Phrases("R6_object_scope_gate", "remove", (("q", ("bitcoin", "btc", "ethereum", "eth", "cryptocurrency", "crypto")), ("q", ("usd", "eur", "euro")), ("g", ("ethereum price index", "gex")))),
    Phrases("R3_action_vs_metadata_endpoint_gate", "remove", (("q", ("generate", "create", "book", "reserve", "track", "current status", "recommend", "suggest", "find me", "help me find")), ("g", ("list", "all", "detail", "details", "status", "support", "supported", "revision", "search", "frontpage"))), (("g", ("generate", "create", "book", "reservation", "track", "tracking", "recommend", "suggest")),)),
    Phrases("R3_action_vs_metadata_endpoint_gate", "remove", (("q", ("translate", "translation")), ("g", ("supported languages", "get revision", "revision"))), (("g", ("translate text", "translate phrase", "translation request")),)),
    Phrases("R3_action_vs_metadata_endpoint_gate", "remove", (("q", ("qr code", "generate qr", "create qr")), ("g", ('"hello"', '"home"', "demo project"))), (("g", ("generate qr", "create qr", "qr code generator")),)),
    Phrases("R4_wrong_gold_set_gate", "remove", (("q", ("profile image", "profile photo", "user image")), ("g", ("demo project",)))),
    Phrases("R2_missing_core_requirement_gate", "downgrade", (("q", ("recommend", "suggest", "best", "suitable", "nearby", "near me", "pair", "pairs well", "complements")),), (("g", ("recommend", "suggest", "near", "restaurant", "hotel", "place", "pair", "booking", "search places")),)),
    Phrases("R2_missing_core_requirement_gate", "remove", (("q", ("example sentence", "interactive lesson", "learning app", "website", "websites", "lesson")),), (("g", ("example", "lesson", "learning", "website", "app")),)),
    Phrases("R2_missing_core_requirement_gate", "remove", (("q", ("gold", "silver", "precious metal", "precious metals")), ("q", ("exchange rate", "exchange rates", "currency"))), (("g", ("gold", "silver", "metal", "xau", "xag")),)),
    Phrases("R2_missing_core_requirement_gate", "remove", (("q", ("nearest post office", "post office locations", "post office")),), (("g", ("post office", "nearby", "location search", "places")),)),
    Phrases("R7_generic_search_news_image_overtrust_gate", "downgrade", (("g", ("web search", "imagesearch", "image search", "newssearch", "generic search")), ("q", ("appropriate", "verify", "ted talk", "banner", "movie", "restaurant", "hotel", "tourist", "specific genre", "domain-specific")))),
    Phrases("R8_travel_place_recommendation_gap_gate", "remove", (("q", _TRAVEL), ("q", ("recommend", "suggest", "near", "suitable", "find", "book"))), (("g", ("hotel", "restaurant", "place", "flight", "booking", "venue", "concert", "travel", "search places")),)),
    Phrases("R11_failure_family_regression_gate", "remove", (("q", ("pairs well", "complements", "specific dish", "seafood")), ("g", ("cocktail",))), (("g", ("pair", "food", "dish", "seafood")),)),
    Phrases("R11_failure_family_regression_gate", "remove", (("q", ("city", "zip code", "hardiness zone")), ("g", ("hardiness zone",)), ("g", ("zip",))), (("g", ("city",)),)),
)
# Phrases that show a chain of dependent steps.
CHAIN = (r"based on", r"according to", r"using the result", r"with the result", r"after finding", r"first .* then", r"then use", r"use .* to", r"depending on", r"if .* then", r"given the result", r"before recommending")
CRYPTO = ("current prices", "ticker data", "cryptocurrency", "bitcoin", "ethereum")


def has_chain(query: Column) -> Column:
    return query.rlike("|".join(f"(?:{p})" for p in CHAIN))


def tightening_policy(rows: DataFrame) -> DataFrame:
    """decision (remove, downgrade or keep), label (the first rule that fires) and reasons. rows: query, gold (texts), task_type, semantic, wrong_gold_flags, domain_flags, representative (strings)."""
    df = rows.withColumns({"q": normalize_ascii(F.col("query")), "g": normalize_ascii(F.col("gold"))})
    flagged = lambda c: ~F.coalesce(F.trim(c), F.lit("")).isin("", "[]", "null")
    composable = normalize_ascii(F.col("task_type")).contains("composable")
    rules = [
        Rule("R4_wrong_gold_set_gate", "remove", flagged(F.col("wrong_gold_flags"))),
        Rule("R1_gold_only_coverage_gate", "remove", normalize_ascii(F.col("semantic")).contains("mismatch")),
        Rule("R10_composable_dependency_gate", "downgrade", composable & ~has_chain(F.col("q"))),
        *(p.rule() for p in TIGHTENING),
        Rule("R9_duplicate_representative_gate", "downgrade", normalize_ascii(F.col("representative")).isin("0", "false", "no")),
        Rule("R11_failure_family_regression_gate", "remove", composable & has_any(F.col("q"), CRYPTO) & ~has_chain(F.col("q"))),
        Rule("R2_missing_core_requirement_gate", "downgrade", flagged(F.col("domain_flags"))),
    ]
    out = hit_policy(df, rules, ["remove", "downgrade"])
    return out.withColumn("reasons", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("reasons", ";"), lambda x: x != ""))), ";")).drop("q", "g")


# -- the pool policy: remove > rewrite > reconstruct > composable review > uncertain > keep, label of the first hit

# Sources that are demonstrations, and requirements with the gold words that cover them.
DEMO_SOURCES = ("demo project", "fastapi project", "petstore", "sample", "sandbox", "test api", "healthcheck", "health status of", "health endpoint", "order catalog", "xmusic")
CORE = (
    (("recommend", "suggest", "popular", "suitable"), ("recommend", "suggest", "popular", "rating")),
    (("venue", "accessible", "landscape"), ("venue", "place", "accessib", "landscape")),
    (("fee", "fees", "withdrawal"), ("fee", "withdraw")),
    (("followers", "artist followers"), ("followers", "artist")),
    (("quarterly", "ratio", "cash flow", "balance sheet", "income statement"), ("quarterly", "ratio", "cash flow", "balance", "income")),
    (("recipe", "cake recipe", "detailed recipe"), ("recipe", "detail")),
    (("trending keyword", "top 10"), ("trend", "keyword")),
)
WRONG_SETS = (("football", "energy price"), ("greek news", "energy price"), ("dna2protein", "numerology"))
POOL_ORDER = ["remove", "rewrite", "reconstruct", "composable_review", "uncertain"]


def letters(c: Column) -> Column:
    """Lower-case letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def names_in(query: Column, name: Column) -> Column:
    """Whether the query holds the name, also when both are written without blanks."""
    q, n = letters(query), letters(name)
    return (n != "") & (q.contains(n) | F.replace(q, F.lit(" ")).contains(F.replace(n, F.lit(" "))))


def pool_policy(rows: DataFrame) -> DataFrame:
    """decision, label and reasons. rows: query, services, apis (gold names, arrays), catalog (text of all candidates), n_candidates, n_gold, group, task_type_guess."""
    q, gold = letters(F.col("query")), letters(F.concat_ws(" ", F.concat("services", "apis")))
    core = F.lit(False)
    for asked, covered in CORE:
        core = core | (has_any(q, asked) & ~has_any(gold, covered))
    wrong = F.lit(False)
    for asked, given in WRONG_SETS:
        wrong = wrong | (q.contains(asked) & gold.contains(given))
    endpoint = lambda n: (F.length(letters(n)) > 3) & (n.rlike("[/_-]") | letters(n).contains(" ") | letters(n).contains("api"))
    api_leak = F.exists("apis", lambda n: endpoint(n) & names_in(F.col("query"), n))
    service_leak = F.exists("services", lambda n: (F.length(letters(n)) > 3) & names_in(F.col("query"), n))
    rules = [
        Rule("demo_or_test_source_blocking", "remove", has_any(letters(F.concat_ws(" ", "catalog", "query")), DEMO_SOURCES)),
        Rule("missing_core_requirement", "remove", wrong | core),
        Rule("api_leak_blocking", "rewrite", api_leak),
        Rule("service_leak_blocking", "rewrite", ~api_leak & service_leak),
        Rule("candidate_space_invalid", "reconstruct", F.col("n_candidates") <= F.col("n_gold")),
        Rule("composable_not_strong_dependency", "composable_review", (F.col("group") == "G3") & ~has_chain(q)),
        Rule("task_type_uncertain", "uncertain", present(F.col("task_type_guess")).isNull()),
    ]
    return hit_policy(rows, rules, POOL_ORDER)


# -- the source-name policy: remove > rewrite > keep with warnings

# Phrases that need context from outside the query, and those that ask about a service itself.
CONTEXT_NEEDED = ("above", "previous", "earlier", "linked above", "this link", "that link", "this product", "that product", "attached", "uploaded", "the document", "the file")
ABOUT = ("know more about", "tell me about", "what is", "link to", "learn about")
SOURCE_WORDS = "api|tool|plugin|service|website|platform|agent|source"


def source_name_policy(rows: DataFrame, common: tuple[str, ...]) -> DataFrame:
    """decision, label and reasons. rows: query, service, gold, adapter (strings); common: words that alone don't name a service."""
    q, s = letters(F.col("query")), letters(F.col("service"))
    named = names_in(F.col("query"), F.col("service"))
    ordinary = (s != "") & F.forall(F.split(s, " "), lambda w: w.isin(*common) | (F.length(w) <= 2))
    patterns = (F.concat(F.lit("(?:use|using|ask|from|according to|with|via|through|on|in) "), s), F.concat(s, F.lit(f" (?:{SOURCE_WORDS})")), F.concat(F.lit(f"(?:{SOURCE_WORDS}) "), s))
    source = F.rlike(q, patterns[0]) | F.rlike(q, patterns[1]) | F.rlike(q, patterns[2])
    adapter = F.lower(F.coalesce("adapter", F.lit("")))
    parts = F.filter(F.split(s, " "), lambda w: ~w.isin(*common) & (F.length(w) > 2))
    rules = [
        Rule("adapter_warning_blocking", "remove", adapter.contains("unmatched") & ~adapter.contains("no")),
        Rule("missing_context_blocking", "remove", has_any(q, CONTEXT_NEEDED)),
        Rule("semantic_mismatch_blocking", "remove", (named & has_any(q, ABOUT)) | (q.contains("link to") & letters(F.concat_ws(" ", "gold", "service")).contains("recommend"))),
        Rule("service_leak_blocking", "rewrite", named & ~ordinary),
        Rule("leak_uncertain", "keep_warning", (named & ordinary) | (~named & F.exists(parts, lambda w: F.array_contains(F.split(q, " "), w)))),
    ]
    out = hit_policy(rows, rules, ["remove", "rewrite"])
    blocking = hits([r for r in rules if r.action in ("remove", "rewrite")])
    label = F.coalesce(F.get(blocking, F.lit(0)), F.nullif(first_match(rules[-1:], "", "name"), F.lit("")), F.lit("no_obvious_leak"))
    return out.withColumns({"label": label, "rule": F.when(named & ~ordinary, F.when(source, "M3_source_or_platform_name_leak").otherwise("M1_exact_gold_service_name_leak_blocking")).otherwise("")})
