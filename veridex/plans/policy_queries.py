"""Queries over cleaning policies, leakage, recovery and traces. Rows are made by SQL expressions that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import STOPWORDS
from veridex.operators import leakage as L
from veridex.operators import recovery as R
from veridex.operators import releases as N
from veridex.operators import rulesets as P
from veridex.operators import semcap as S
from veridex.operators import traces as X
from veridex.plans.registry import Tables, query

# -- cleaning policies

_CLEAN = [
    "l_orderkey * 10 + l_linenumber as id", "case when l_linenumber % 2 = 0 then 'service' else 'api' end as level",
    "case l_suppkey % 5 when 0 then 'api_leak_blocking' when 1 then 'api_leak_weak_or_generic' else 'no_blocking_api_leak' end as api_leak", "case when l_linenumber = 6 then 'strong' else 'none' end as api_leak_strength",
    "case l_partkey % 4 when 0 then 'service_leak_only' when 1 then 'ambiguous_service_leak' else 'no_service_leak' end as service_leak", "case when cast(l_quantity as int) % 7 = 0 then 'no' else 'yes' end as gold_services",
    "case cast(l_quantity as int) % 5 when 0 then 'yes_api_name_only' when 1 then 'no' else 'yes' end as gold_apis", "case when l_orderkey % 6 = 0 then 'invalid_no_choice' else 'valid_choice' end as space",
    "case when l_orderkey % 11 = 0 then 'invalid_level' else 'valid_level' end as task_type", "case l_partkey % 9 when 0 then 'mismatch' when 1 then 'uncertain' when 2 then '' when 3 then 'unclear' else 'ok' end as semantic",
    "case l_suppkey % 8 when 0 then 'coverage_mismatch' when 1 then 'coverage_uncertain' else 'coverage_ok' end as coverage", "case when l_returnflag = 'R' then 'high' else 'medium' end as semantic_confidence", "'High' as coverage_confidence",
    "case when l_linenumber = 7 then 'KeyError' else '' end as parse_error",
]


@query(f"""with r as (select {', '.join(_CLEAN)} from lineitem), f as (select *, api_leak = 'api_leak_blocking' or api_leak_strength = 'strong' as b1, gold_services <> 'yes' or gold_apis = 'no' as b2, space like 'invalid%' as b3, task_type like 'invalid%' as b4, semantic = 'mismatch' as b5, coverage = 'coverage_mismatch' as b6,
semantic = 'uncertain' as w1, coverage = 'coverage_uncertain' as w2, api_leak = 'api_leak_weak_or_generic' as w3, service_leak = 'ambiguous_service_leak' as w4, parse_error <> '' as w5, semantic = '' as w6, level = 'service' and service_leak = 'service_leak_only' as leak, semantic = 'ok' and coverage = 'coverage_ok' as ok from r),
g as (select *, b1 or b2 or b3 or b4 or b5 or b6 as blocked, w1 or w2 or w3 or w4 or w5 or w6 as warned from f)
select id, case when blocked then 'dryrun_removed' when leak then 'dryrun_service_leak_only' when warned or not ok then 'dryrun_uncertain' else 'dryrun_clean_candidate' end as decision,
case when b1 then 'removed_api_leak' when b2 then 'removed_gold_missing' when b3 then 'removed_choice_space_invalid' when b4 then 'removed_task_type_invalid' when b5 then 'removed_semantic_mismatch' when b6 then 'removed_capability_mismatch' when leak then 'dryrun_service_leak_only'
when w1 or w2 then 'uncertain_semcap' when w3 then 'uncertain_weak_api_leak' when w4 then 'uncertain_ambiguous_service_leak' when w5 then 'uncertain_detector_parse_error' when warned then 'dryrun_uncertain' when ok then 'dryrun_clean_candidate' else 'uncertain_semcap' end as bucket,
concat_ws(';', case when b1 then 'api_leak' end, case when b6 then 'capability_mismatch' end, case when b3 then 'choice_space_invalid' end, case when b2 then 'gold_missing' end, case when b5 then 'semantic_mismatch' end, case when b4 then 'task_type_invalid' end) as blocking,
concat_ws(';', case when w4 then 'ambiguous_service_leak' end, case when w2 then 'coverage_uncertain' end, case when w5 then 'detector_parse_error' end, case when w6 then 'missing_semantic_capability' end, case when w1 then 'semantic_uncertain' end, case when not blocked and not warned and not leak and not ok then 'semcap_not_clean_ok' end, case when w3 then 'weak_or_generic_api_leak' end) as warnings,
case when blocked or leak or warned or not ok then '' when semantic_confidence = 'high' then 'clean_candidate_high_conf' else 'clean_candidate_medium_conf' end as confidence from g""")
def policy_clean(t: Tables) -> DataFrame:
    return P.clean_policy(t.lineitem.selectExpr(*_CLEAN)).select("id", "decision", "bucket", "blocking", "warnings", "confidence")


_ASKED = ["track my package to tokyo", "forecast for tomorrow in the city", "recommend a hotel nearby and then use it to book", "translate this phrase", "gold exchange rates today", "seafood that pairs well with wine", "find me the latest bitcoin price in usd and eur", "list all users"]
_GIVEN = ["container status list", "current weather by zip code", "supported languages and revision", "hotel booking search places", "sample ping", "cocktail detail", "ethereum price index city", "users"]


def _pick(values: list[str], by: str) -> str:
    return "case " + by + " " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


_TIGHT = [
    "p_partkey as id", f"{_pick(_ASKED, 'p_partkey % 8')} as query", f"{_pick(_GIVEN, 'p_size % 8')} as gold", "case when p_partkey % 3 = 0 then 'composable_service' else 'single' end as task_type", "case when p_partkey % 29 = 0 then 'mismatch' else 'ok' end as semantic",
    "case when p_partkey % 31 = 0 then '[\"x\"]' else '[]' end as wrong_gold_flags", "case when p_partkey % 7 = 0 then '[1]' else '' end as domain_flags", "case when p_partkey % 5 = 0 then 'False' else 'true' end as representative",
]


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _phrase(p: P.Phrases) -> str:
    return " and ".join([*(_any(c, w) for c, w in p.need), *("not " + _any(c, w) for c, w in p.lack)])


_CHAIN = "regexp_matches(q, '" + "|".join(P.CHAIN) + "')"
_TIGHT_RULES = [
    ("R4_wrong_gold_set_gate", "remove", "wrong_gold_flags not in ('', '[]', 'null')"), ("R1_gold_only_coverage_gate", "remove", "contains(semantic, 'mismatch')"), ("R10_composable_dependency_gate", "downgrade", f"contains(task_type, 'composable') and not {_CHAIN}"),
    *((p.name, p.action, _phrase(p)) for p in P.TIGHTENING), ("R9_duplicate_representative_gate", "downgrade", "representative = 'False'"),
    ("R11_failure_family_regression_gate", "remove", f"contains(task_type, 'composable') and {_any('q', P.CRYPTO)} and not {_CHAIN}"), ("R2_missing_core_requirement_gate", "downgrade", "domain_flags not in ('', '[]', 'null')"),
]


def _hit_sql(rows: str, rules: list[tuple[str, str, str]], order: list[str], default: str = "keep") -> str:
    """The strongest action, the first hit and the distinct hits of a rule list."""
    found = "[x for x in [" + ", ".join(f"case when {w} then '{n}' end" for n, _, w in rules) + "] if x is not null]"
    actions = "[x for x in [" + ", ".join(f"case when {w} then '{a}' end" for _, a, w in rules) + "] if x is not null]"
    best = "case " + " ".join(f"when list_contains(acts, '{a}') then '{a}'" for a in order) + f" else '{default}' end"
    return f"with r as ({rows}), h as (select *, {found} as hits, {actions} as acts from r) select id, {best} as decision, coalesce(hits[1], '') as label, array_to_string(list_sort(list_distinct(hits)), ';') as reasons from h"


@query(_hit_sql(f"select *, lower(query) as q, lower(gold) as g from (select {', '.join(_TIGHT)} from part)", _TIGHT_RULES, ["remove", "downgrade"]))
def policy_tightening(t: Tables) -> DataFrame:
    return P.tightening_policy(t.part.selectExpr(*_TIGHT)).select("id", "decision", "label", "reasons")


_POOL_Q = ["show artist followers", "football scores please", "use the Rating_API now", "plan a trip with Alpha Travel", "fees for withdrawal", "a quiet question", "test api sandbox", "first find it then book it"]
_POOL = [
    "p_partkey as id", f"{_pick(_POOL_Q, 'p_partkey % 8')} as query", f"{_pick(['Alpha Travel', 'Energy Price', 'Beta', 'Xy'], 'p_size % 4')} as service", f"{_pick(['Rating_API', 'GetFee', 'artist followers', 'go'], '(p_size + 1) % 4')} as api",
    f"{_pick(['catalog one', 'petstore catalog', 'other'], 'p_size % 3')} as catalog", "p_size % 6 as n_candidates", "2 as n_gold", "case when p_partkey % 4 = 0 then 'G3' else 'G1' end as grp", "case when p_partkey % 9 = 0 then ' ' else 'single' end as task_type_guess",
]
_LET = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_NAMED = "(contains({q}, {n}) or contains(replace({q}, ' ', ''), replace({n}, ' ', '')))"
_POOL_RULES = [
    ("demo_or_test_source_blocking", "remove", _any("b", P.DEMO_SOURCES)),
    ("missing_core_requirement", "remove", "(" + " or ".join([*(f"({_any('q', a)} and not {_any('g', c)})" for a, c in P.CORE), *(f"(contains(q, '{a}') and contains(g, '{c}'))" for a, c in P.WRONG_SETS)]) + ")"),
    ("api_leak_blocking", "rewrite", "api_leak"), ("service_leak_blocking", "rewrite", "not api_leak and length(sn) > 3 and " + _NAMED.format(q="q", n="sn")), ("candidate_space_invalid", "reconstruct", "n_candidates <= n_gold"),
    ("composable_not_strong_dependency", "composable_review", f"grp = 'G3' and not {_CHAIN}"), ("task_type_uncertain", "uncertain", "trim(task_type_guess) = ''"),
]


@query(_hit_sql(f"select *, length(an) > 3 and (regexp_matches(api, '[/_-]') or contains(an, ' ') or contains(an, 'api')) and {_NAMED.format(q='q', n='an')} as api_leak from (select *, {_LET.format('query')} as q, {_LET.format('service')} as sn, {_LET.format('api')} as an, {_LET.format(chr(39) + chr(39) + ' || service || ' + chr(39) + ' ' + chr(39) + ' || api')} as g, {_LET.format('catalog || ' + chr(39) + ' ' + chr(39) + ' || query')} as b from (select {', '.join(_POOL)} from part))", _POOL_RULES, P.POOL_ORDER))
def policy_pool(t: Tables) -> DataFrame:
    rows = t.part.selectExpr(*_POOL).withColumns({"services": F.array("service"), "apis": F.array("api"), "group": F.col("grp")})
    out = P.pool_policy(rows)
    return out.select("id", "decision", "label", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("reasons", ";"), lambda x: x != ""))), ";").alias("reasons"))


_SRC_Q = ["ask Alpha Guide for a list", "what is alpha guide", "the weather in town", "see the attached file", "alphaguide please", "guide me home", "link to a page", "nothing here"]
_SRC = ["p_partkey as id", f"{_pick(_SRC_Q, 'p_partkey % 8')} as query", f"{_pick(['Alpha Guide', 'Weather', 'Recommend Me', 'Other Name'], 'p_size % 4')} as service", "'[]' as gold", "case when p_partkey % 13 = 0 then 'gold unmatched' when p_partkey % 17 = 0 then 'no unmatched' else '' end as adapter"]


@query(f"""with r as (select *, {_LET.format('query')} as q, {_LET.format('service')} as s from (select {', '.join(_SRC)} from part)), n as (select *, {_NAMED.format(q='q', n='s')} as named, s = 'weather' as common, len(list_intersect(list_filter(string_split(s, ' '), lambda w: w not in ('weather', 'search') and length(w) > 2), string_split(q, ' '))) > 0 as part from r),
f as (select *, contains(adapter, 'unmatched') and not contains(adapter, 'no') as m6, {_any('q', P.CONTEXT_NEEDED)} as m4, (named and {_any('q', P.ABOUT)}) or (contains(q, 'link to') and contains(s, 'recommend')) as m5, named and not common as m1, (named and common) or (not named and part) as m2 from n)
select id, case when m6 or m4 or m5 then 'remove' when m1 then 'rewrite' else 'keep' end as decision, case when m6 then 'adapter_warning_blocking' when m4 then 'missing_context_blocking' when m5 then 'semantic_mismatch_blocking' when m1 then 'service_leak_blocking' when m2 then 'leak_uncertain' else 'no_obvious_leak' end as label,
case when m1 then case when regexp_matches(q, '(use|using|ask|from|according to|with|via|through|on|in) ' || s) or regexp_matches(q, s || ' ({P.SOURCE_WORDS})') or regexp_matches(q, '({P.SOURCE_WORDS}) ' || s) then 'M3_source_or_platform_name_leak' else 'M1_exact_gold_service_name_leak_blocking' end else '' end as rule from f""")
def policy_source_names(t: Tables) -> DataFrame:
    return P.source_name_policy(t.part.selectExpr(*_SRC), ("weather", "search")).select("id", "decision", "label", "rule")


# -- leakage


@query("""with d as (select c_custkey, case when c_custkey % 2 = 0 then 'service' else 'api' end as target, 'for ' || lower(c_mktsegment) || ' ask ' || n_name || ' or ' || r_name || ', not weather' as q, n_nationkey, n_name, r_regionkey, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
h as (select c_custkey, n_nationkey::bigint as target_id, 'service' as level, q, lower(n_name) as surface from d where target = 'service' union all select c_custkey, r_regionkey, case target when 'service' then 'api_clue_in_service_task' else 'api' end, q, unnest([lower(r_name), 'weather']) from d)
select c_custkey as task_id, target_id, level, surface, (position(surface in lower(q)) - 1)::int as start_offset, (position(surface in lower(q)) - 1 + length(surface))::int as end_offset, surface <> 'weather' as blocking from h""")
def leak_targets(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    one = lambda c: F.array(F.col(c).cast("long"))
    tasks = rows.select(
        F.col("c_custkey").alias("task_id"), F.concat(F.lit("for "), F.lower("c_mktsegment"), F.lit(" ask "), "n_name", F.lit(" or "), "r_name", F.lit(", not weather")).alias("query"), F.when(F.col("c_custkey") % 2 == 0, "service").otherwise("api").alias("target"),
        one("n_nationkey").alias("gold_services"), one("r_regionkey").alias("gold_apis"), one("r_regionkey").alias("paired_apis"),
    )
    services = t.nation.select(F.col("n_nationkey").cast("long").alias("service_id"), F.col("n_name").alias("name"))
    apis = t.region.select(F.col("r_regionkey").cast("long").alias("api_id"), F.array(F.col("r_name"), F.lit("weather")).alias("surfaces"))
    return L.target_hits(tasks, services, apis).select("task_id", "target_id", "level", "surface", "start_offset", "end_offset", "blocking")


@query("""select p_partkey, case p_partkey % 6 when 0 then 'find parts for a job, please' when 1 then 'find parts ' || p_name || ' for a job' when 2 then '' when 3 then 'find parts' when 4 then 'find parts and and today' else 'call me and find parts' end as rewritten,
case p_partkey % 6 when 0 then 'REWRITE_VALID' when 1 then 'REWRITE_NOT_APPLICABLE' when 2 then 'REWRITE_UNSAFE_MEANING_LOSS' when 3 then 'REWRITE_NOT_APPLICABLE' when 4 then 'REWRITE_UNSAFE_GRAMMAR' else 'REWRITE_VALID' end as status from part""")
def leak_rewrites(t: Tables) -> DataFrame:
    name = "p_name"
    forms = [
        F.concat(F.lit("find parts for a job using the "), name, F.lit(" , please.")), F.concat(F.lit("find parts "), name, F.lit(" for a job")), F.concat(F.lit("using "), name), F.lit("find parts"),
        F.concat(F.lit("find parts and via "), name, F.lit(" and today")), F.concat(F.lit("call me and find  parts with "), name, F.lit(" service")),
    ]
    asked = F.element_at(F.array(*forms), (F.col("p_partkey") % 6).cast("int") + 1)
    text, status = L.verified_rewrite(asked, F.array(name), F.array("p_brand"))
    return t.part.select("p_partkey", F.regexp_replace(text, r"\.$", "").alias("rewritten"), status.alias("status"))


# -- recovery

_REASONS = ["same_service_only", "failed_dependency_edge", "exact_blocking_api_name_leak", "service_candidate_space_invalid", "no_cross_service_edge", "source_unavailable", "", "sequence_only"]


@query(f"""with r as (select p_partkey, {_pick(_REASONS, 'p_partkey % 8')} as a, {_pick(_REASONS, '(p_size + 2) % 8')} as b, p_partkey % 41 = 0 as existing, p_partkey % 23 <> 0 as available from part), x as (select *, [y for y in [a, b] if y <> ''] as s from r)
select p_partkey, case when existing then 'AUTHORITATIVE_VALID_EXISTING' when not available or list_contains(s, 'source_unavailable') then 'SOURCE_UNAVAILABLE_HOLD' when list_contains(s, 'failed_dependency_edge') then 'HARD_UNRECOVERABLE_FAILED_DEPENDENCY' when list_contains(s, 'same_service_only') then 'HARD_UNRECOVERABLE_SAME_SERVICE_ONLY'
when list_contains(s, 'no_cross_service_edge') then 'HARD_UNRECOVERABLE_NO_CROSS_SERVICE_EDGE' when list_contains(s, 'sequence_only') then 'HARD_UNRECOVERABLE_SHARED_INPUT_OR_SEQUENCE_ONLY' when len(s) = 0 then 'OTHER_HOLD' when not list_contains(s, 'service_candidate_space_invalid') then 'REPAIRABLE_EXACT_LEAK_ONLY'
when not list_contains(s, 'exact_blocking_api_name_leak') then 'REPAIRABLE_CANDIDATE_SPACE_ONLY' else 'REPAIRABLE_LEAK_AND_CANDIDATE_SPACE' end as recovery from x""")
def recovery_classes(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", f"array({_pick(_REASONS, 'p_partkey % 8')}, {_pick(_REASONS, '(p_size + 2) % 8')}) as reasons", "p_partkey % 41 = 0 as existing", "p_partkey % 23 <> 0 as available")
    return rows.select("p_partkey", R.classify(F.col("reasons"), F.col("existing"), F.col("available")).alias("recovery"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z][a-z0-9]{{2,}}'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")))"


@query(f"""with i as (select cast(s_suppkey as varchar) as candidate, 'n' || s_nationkey as service, 'd' || (s_nationkey % 5) as domain, {_WORDS.format("s_name || ' ' || case when s_suppkey % 3 = 0 then 'cheap repair shop' when s_suppkey % 3 = 1 then 'repair tools' else 'fine food' end")} as w from supplier),
q as (select c_custkey as task_id, 'n' || c_nationkey as ts, 'd' || (c_nationkey % 5) as td, ['1', cast(c_custkey % 10 as varchar)] as gold, {_WORDS.format("'a cheap tools shop for ' || c_mktsegment")} as w from customer),
m as (select task_id, candidate, case when service = ts then 0 else 1 end as a, case when domain = td then 0 else 1 end as b, len(list_intersect(i.w, q.w)) as o from q, i where not list_contains(gold, candidate)),
r as (select *, row_number() over (partition by task_id order by a, b, o desc, candidate) as r from m) select task_id, candidate, r from r where r <= 6""")
def recovery_candidates(t: Tables) -> DataFrame:
    pool = t.supplier.selectExpr("cast(s_suppkey as string) as candidate", "concat('n', s_nationkey) as service", "concat('d', s_nationkey % 5) as domain", "concat(s_name, ' ', case when s_suppkey % 3 = 0 then 'cheap repair shop' when s_suppkey % 3 = 1 then 'repair tools' else 'fine food' end) as document")
    tasks = t.customer.selectExpr("c_custkey as task_id", "concat('a cheap tools shop for ', c_mktsegment) as query", "concat('n', c_nationkey) as service", "concat('d', c_nationkey % 5) as domain", "array('1', cast(c_custkey % 10 as string)) as gold")
    return R.rebuilt_candidates(tasks, pool, target=8).withColumn("r", F.col("r").cast("long"))


@query("""select p_partkey, case when p_partkey % 7 = 0 then 'GOLD_NOT_IN_CATALOG' when p_partkey % 5 = 0 then 'ALIAS_CONFLICT' when p_partkey % 4 = 0 then 'PARENT_MAPPING_MISSING' when p_partkey % 3 = 0 then 'ALIAS_CONFLICT' when p_partkey % 2 = 0 then 'CATALOG_INSUFFICIENT' else 'RECONSTRUCTED_VALID' end as status,
contains(lower(p_name), 'test') or p_partkey % 6 = 0 or p_partkey % 11 = 0 as forbidden from part""")
def recovery_status(t: Tables) -> DataFrame:
    rows = t.part.selectExpr(
        "p_partkey", "p_name", "array('a', 'b') as gold", "case when p_partkey % 7 = 0 then array('a') else array('a', 'b', 'c') end as known", "case when p_partkey % 2 = 0 then array('a', 'b') else array('a', 'b', 'c') end as candidates",
        "case when p_partkey % 5 = 0 then array('Map It', 'map-it') else array('x', 'y') end as gold_names", "case when p_partkey % 3 = 0 then array('x', 'X') else array('x', 'y', 'z') end as names", "p_partkey % 4 = 0 as parents_missing", "case when p_partkey % 6 = 0 then 'a Demo shop' else 'contest' end as label",
    )
    status = R.rebuilt_status(*(F.col(c) for c in ("gold", "known", "candidates", "gold_names", "names", "parents_missing")))
    return rows.select("p_partkey", status.alias("status"), R.is_forbidden_negative(F.col("p_partkey") % 11 == 0, F.col("label")).alias("forbidden"))


# -- traces

_PAYLOADS = ['{"k": 87}', '{"status": 404, "message": "x"}', '{"error": "boom", "data": {"k": 5}}', "", '{"result": "[{\\"name\\": \\"abc\\"}]"}', "plain not found", '{"code": "200", "items": ["north", null]}', "[]"]
_STATES = ["success", "error_only", "partial_success", "unknown", "success", "error_only", "success", "unknown"]


@query("select event_id, " + _pick(_STATES, "event_id % 8") + " as status from events")
def trace_status(t: Tables) -> DataFrame:
    payload = F.element_at(F.array(*map(F.lit, _PAYLOADS)), (F.col("event_id") % 8).cast("int") + 1)
    return X.execution_status(t.events.select("event_id", payload.alias("payload")), ["event_id"], "payload").select("event_id", "status")


@query("""select event_id, '$.a.b[0]' as path, cast(event_id as varchar) as value from events where event_id > 1 union all select event_id, '$.a.b[1]', event_type from events where event_type <> 'error' union all select event_id, '$.s.decoded.x', cast(user_id as varchar) from events where user_id > 1""")
def trace_scalars(t: Tables) -> DataFrame:
    doc = F.format_string('{"a": {"b": [%d, "%s"], "token": "hidden value"}, "ok": true, "s": "{\\"x\\": %d}", "n": null, "short": "abc"}', "event_id", "event_type", "user_id")
    flat = X.flatten(t.events.select("event_id", doc.alias("doc")), "event_id", "doc")
    return flat.where(X.allowed(F.col("path"), F.col("value"), F.col("kind"))).select("event_id", "path", "value")


@query("""with s as (select l_orderkey as t, count(*) as n, count(distinct l_suppkey % 3) as sv, count(distinct l_partkey) as ap, count(*) filter (l_returnflag = 'R') as failed from lineitem group by 1),
e as (select l_orderkey as t, count(*) filter (l_linestatus = 'O' and l_returnflag = 'A') as strong, count(*) filter (l_linestatus = 'O' and l_returnflag = 'N') as shared, count(*) filter (l_linestatus = 'F') as seq, count(*) filter (l_linestatus <> 'F') as other from lineitem where l_linenumber > 1 group by 1),
j as (select o_orderkey as t, case when o_orderkey % 10 = 0 then 'join_ambiguous' when o_orderkey % 10 = 1 then 'broken' when o_orderkey % 10 = 2 then '' else 'ok' end as parse, coalesce(n, 0) as n, coalesce(sv, 0) as sv, coalesce(ap, 0) as ap, coalesce(failed, 0) as failed, coalesce(strong, 0) as strong, coalesce(shared, 0) as shared, coalesce(seq, 0) as seq, coalesce(other, 0) as other from orders left join s on s.t = o_orderkey left join e on e.t = o_orderkey),
k as (select *, n >= 2 and (sv >= 2 or ap >= 2) as spread, case when parse = 'join_ambiguous' then parse when parse = 'broken' then 'parse_failed' when strong > 0 and n >= 2 and (sv >= 2 or ap >= 2) then 'strong_objective_evidence_available' when other > 0 then 'no_dependency_evidence' when n >= 2 then 'sequence_only' else 'no_dependency_evidence' end as st from j)
select t as trace_id, st as evidence_status, case when st = 'strong_objective_evidence_available' then 'true_composable_candidate' when spread and (shared > 0 or seq > 0) then 'parallel_multi' else 'no_dependency' end as suggested_class, strong as strong_edges, failed as failed_calls, failed > 0 as execution_evidence_incomplete from k""")
def trace_assessment(t: Tables) -> DataFrame:
    records = t.orders.selectExpr("o_orderkey as trace_id", "case when o_orderkey % 10 = 0 then 'join_ambiguous' when o_orderkey % 10 = 1 then 'broken' when o_orderkey % 10 = 2 then '' else 'ok' end as parse_status")
    steps = t.lineitem.selectExpr("l_orderkey as trace_id", "l_linenumber as step", "cast(l_suppkey % 3 as string) as service", "cast(l_partkey as string) as api", "case when l_returnflag = 'R' then 'failed' else 'success' end as status")
    edges = t.lineitem.where("l_linenumber > 1").selectExpr("l_orderkey as trace_id", "case when l_linestatus = 'F' then 'sequence_only' when l_returnflag = 'A' then 'result_to_input' when l_returnflag = 'N' then 'shared_input_only' else 'unsupported' end as edge_type", "l_linestatus = 'O' and l_returnflag = 'A' as strong")
    return X.assess_records(records, steps, edges)


_GATE = [
    "o_orderkey as task_id", "case when o_orderkey % 17 = 0 then ' ' else 'compare the weather' end as query", "case when o_orderkey % 3 = 0 then 'A' else 'B' end as s2", "case when o_orderkey % 7 = 0 then '' else 'C' end as s3",
    "case when o_orderkey % 5 = 0 then 'failed' when o_orderkey % 19 = 0 then 'unknown' else 'success' end as st2", "o_orderkey % 4 <> 0 as e12", "o_orderkey % 6 <> 0 as e23",
]


@query(f"""with r as (select {', '.join(_GATE)} from orders), f as (select *, e12 and s2 <> 'A' as c12, e23 and s3 <> '' and s3 <> s2 as c23, e12 and s2 = 'A' as same12, e23 and s3 = '' as lost from r),
g as (select *, c12::int + c23::int as cross_n, same12::int as same_n, [x for x in [case when trim(query) = '' then 'empty_query' end, case when not e12 and not e23 then 'empty_dependency_evidence' end, case when task_id % 8 = 0 then 'gold_service_count_lt_2' end, case when task_id % 9 = 0 then 'gold_api_count_lt_2' end,
case when not c12 and not c23 then 'no_cross_service_strong_edge' end, case when same12 and not c12 and not c23 then 'same_service_only_dependency' end, case when lost then 'unresolved_edge_service_mapping' end, case when st2 = 'failed' and (e12 or e23) then 'failed_or_error_dependency_edge' end, case when st2 = 'failed' and (e12 or e23) then 'failed_or_error_gold_call' end,
case when st2 <> 'success' and (e12 or e23) then 'gold_dependency_core_not_fully_successful' end, case when task_id % 10 = 0 then 'exact_blocking_service_name_leak' end, case when task_id % 11 = 0 then 'exact_blocking_api_name_leak' end, case when task_id % 15 = 0 then 'service_candidate_space_invalid' end, case when task_id % 16 = 0 then 'api_candidate_space_invalid' end,
case when task_id % 12 = 0 then 'dependency_graph_not_dag' end, case when task_id % 13 = 0 and (c12 or c23) then 'only_redundant_recomputation_dependency' end] if x is not null] as reasons from f)
select task_id, array_to_string(reasons, ';') as reasons, case when trim(query) = '' then 'SOURCE_UNAVAILABLE_HOLD' when same_n > 0 and cross_n = 0 and task_id % 9 <> 0 then 'API_ONLY_WORKFLOW_CANDIDATE' when len(reasons) > 0 then 'STRUCTURALLY_INELIGIBLE' when task_id % 13 = 0 or task_id % 14 = 0 or task_id % 18 = 0 then 'STRUCTURALLY_ELIGIBLE_WITH_RISK' else 'STRUCTURALLY_ELIGIBLE_FOR_REVIEW' end as machine_status,
cross_n as cross_service_edges, same_n as same_service_edges from g""")
def trace_necessity(t: Tables) -> DataFrame:
    step = lambda k, s, st: f"named_struct('step', {k}, 'service', {s}, 'api', 'x', 'status', {st})"
    edge = lambda a, b, c: f"named_struct('from_step', {a}, 'to_step', {b}, 'strong', {c})"
    pair = lambda a, b: f"named_struct('from_step', {a}, 'to_step', {b})"
    rows = t.orders.selectExpr(*_GATE).selectExpr(
        "task_id", "query", f"array({step(1, repr('A'), repr('success'))}, {step(2, 's2', 'st2')}, {step(3, 's3', repr('partial_success'))}) as steps", f"array({edge(1, 2, 'e12')}, {edge(2, 3, 'e23')}) as edges",
        "case when task_id % 8 = 0 then array('A', 'A') else array('A', 'B') end as gold_services", "case when task_id % 9 = 0 then array('x') else array('x', 'y') end as gold_apis",
        "case when task_id % 15 = 0 then array('B') else array('A', 'B', 'Z') end as candidate_services", "case when task_id % 16 = 0 then array('z') else array('x', 'y', 'z') end as candidate_apis", "task_id % 10 = 0 as service_leak", "task_id % 11 = 0 as api_leak",
        "case when task_id % 18 = 0 then 2 else 1 end as components", "task_id % 12 <> 0 as is_dag", f"case when task_id % 13 = 0 then array({pair(1, 2)}, {pair(2, 3)}) else filter(array({pair(1, 2)}), x -> false) end as redundant", "case when task_id % 14 = 0 then array('weather lookup') else filter(array('x'), x -> false) end as disconnected",
    )
    return X.necessity_gate(rows)


@query(r"""with r as (select doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}_]+') as q from documents), c as (select doc_id, list_contains(q, 'then')::int + list_contains(q, 'first')::int as s, list_contains(q, 'with')::int as m, list_contains(q, 'and')::int + list_contains(q, 'und')::int as w from r)
select doc_id, s as strong, m as medium, w as weak, 5 * s + 3 * m + w as score from c""")
def trace_signals(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.signals(F.col("text"), ["then", "first"], ["with"], ["and", "und"]).alias("s")).select("doc_id", "s.*")

# -- phrase tables over one automaton

_ASKS = "traffic|weather in snow|hotel and zoo|gas station|linkedin profile|companies|company photo|mail|bill of lading|zip code|gondrand|headline|find images|search the web|random user|trustpilot|checkhealth|ascii art|latitude|capital of country|ticker|recipes|registered on whatsapp|whatsapp for business|authors|top-rated pizza|transit agency in istanbul|same-day courier|track my parcel|news|nothing known"
_GOLD = "route|forecast|venue|place|profile|shipping|additional logo|tracking|vessel|postcode|transitaire|currents|imagesearch|websearch|fake gender|star|squake project|hashtag|geocode|language|population language|finance|cooking|is registered|is whatsapp for business|book|product reviews rating|container track|article|nothing"


def _picked(listed: str, n: int, step: str) -> str:
    return f"split_part('{listed}', '|', cast(1 + ({step}) % {n} as int))"


_CAPABLE = [
    "p_partkey as id", f"concat({_picked(_ASKS, 31, 'p_partkey')}, ' and ', {_picked(_ASKS, 31, 'p_partkey % 7 * p_size')}) as query",
    f"concat({_picked(_GOLD, 30, 'p_partkey % 30 + p_partkey % 31 * (p_size % 3) + case when p_partkey % 2 = 0 then p_partkey % 31 else 0 end')}, ' by ', {_picked(_GOLD, 30, 'p_partkey % 31')}) as gold", f"case when p_size % 4 = 0 then {_picked(_GOLD, 30, 'p_partkey % 13 * 5')} else '' end as flagged",
]

#: Written by hand from the requirements and reasons, not from the library's tables.
_SEMCAP = """with t as (select id, lower(query) as q, lower(gold) as g, lower(gold || ' ' || flagged) as c from p),
req(label, trig, pos) as (values ('traffic_route','traffic|route|directions|driving time','traffic|route'),('weather','weather|forecast|temperature|rain|snow','weather|forecast'),('hotel_venue_event','hotel|venue|concert|event planner|event planning|attraction|zoo','hotel|venue|event|popular times|busy and popular'),
('restaurant_place_reviews','restaurant|review|gas station|place|popular times|walmart','restaurant|place|review|popular times|busy and popular'),('social_profile','linkedin|profile|company data','linkedin|company data|profile'),('company_list','company|companies|courier|shipping company|carrier list','company|companies|courier|shipping'),
('company_images_or_extra_data','image|images|photo|logo|additional data|extra data','image|images|logo|additional'),('package_tracking','package|parcel|mail|postal|tracking number|track my|shipment','package|parcel|mail|postal|tracking|track'),('container_tracking','container|bill of lading|vessel','container|bill of lading|vessel'),
('postal_code','postal code|zip code|postcode','postal|zip|postcode'),('customs_transitaire','customs|transitaire|freight forwarder|gondrand|new caledonia','transitaire|customs|freight'),('news_search','news|article|headline','news|currents|article|headline'),('image_search','image search|find images|search images|retrieve images','image|images|imagesearch'),
('web_search','web search|search the web|find websites|web page','web|search|websearch'),('fake_user','fake user|random user|gender','fake|user|gender'),('trustpilot_review','trustpilot|review|star|business unit','trustpilot|review|star'),('squake_project_health','squake|checkhealth|projects|api health','squake|project|checkhealth|health'),
('translation_generation','translate|translation|ascii art|hashtag|generate','translate|translation|ascii|hashtag|generate'),('geocode','latitude|longitude|geocode|coordinates','latitude|longitude|geocode|coordinates'),('country_facts','population|country name|facts|capital|languages','population|country|fact|capital|language'),
('finance_market','ipo|stock|market|ticker|exchange','ipo|stock|market|ticker|finance'),('recipe_instruction','recipe|recipes|ingredients|cooking instruction|cooking instructions','recipe|ingredient|cooking'),('whatsapp_registration_status','registered on whatsapp|whatsapp for business|business status','registered|whatsapp for business|business status'),
('bookstore_author_profile','bookstore|bookstores|author profiles|authors|new books','bookstore|author|book'),('place_reviews_ratings','top-rated|ratings|pizza restaurants|reviews and ratings','rating|ratings|restaurant|place review'),('transit_agency_local_scope','transit agencies|transit agency','transit agency|transit agencies')),
a as (select id, label, any_of(c, pos) as held from t, req where any_of(q, trig)), b as (select t.id, coalesce(list_sort(list(label) filter (label is not null)), ['general_information']) as requirements, coalesce(list_sort(list(label) filter (held)), case when count(label) = 0 then ['general_information'] else [] end) as covered, coalesce(list_sort(list(label) filter (not held)), []) as missing from t left join a using (id) group by 1),
k(n, kind, name, need1, w1, need2, w2, need3, w3, lack, l) as (values
(1,'mismatch','package_or_mail_tracking_mapped_to_container_tracking','q','package|parcel|mail|postal','g','container|bill of lading|vessel','','','',''),(2,'mismatch','container_tracking_requirement_not_covered','q','container|bill of lading','','','','','g','container|bill of lading|vessel'),
(3,'mismatch','hotel_venue_place_requirement_not_covered','q','hotel|venue|concert|zoo|gas station|restaurant','','','','','c','hotel|venue|event|concert|zoo|gas station|restaurant|popular times|busy and popular|place'),(4,'mismatch','geocode_requirement_not_covered','q','latitude|longitude|coordinates|geocode','','','','','c','latitude|longitude|geocode|coordinates'),
(5,'mismatch','traffic_requirement_not_covered','q','traffic','','','','','c','traffic|route'),(6,'mismatch','weather_requirement_not_covered','q','weather|forecast','','','','','c','weather|forecast'),(7,'mismatch','generation_or_translation_requirement_not_covered','q','ascii art|hashtag|translate|translation','','','','','c','ascii|hashtag|translate|translation|generate'),
(8,'mismatch','company_images_or_additional_data_missing','q','image|images|photo|logo|additional data','q','company|companies','','','c','image|photo|logo|additional'),(9,'mismatch','country_facts_not_covered_by_language_only_api','q','country|population|facts|capital','g','language','','','g','population|capital|country facts'),
(10,'mismatch','recipe_ingredients_and_instructions_not_covered','q','recipe|recipes|ingredients|cooking instruction|cooking instructions','','','','','c','recipe|ingredient|cooking'),(11,'mismatch','whatsapp_registered_check_not_in_gold_apis','q','registered on whatsapp','','','','','g','is registered|registered on whatsapp'),
(12,'mismatch','whatsapp_business_account_check_not_in_gold_apis','q','whatsapp for business','','','','','g','is whatsapp for business|whatsapp for business?'),(13,'mismatch','whatsapp_registration_or_business_status_not_covered','q','registered on whatsapp|whatsapp for business|business status','','','','','c','registered|whatsapp for business|business status'),
(14,'mismatch','bookstore_or_author_profile_requirement_not_covered','q','bookstore|bookstores|author profiles|authors','','','','','c','bookstore|bookstores|author|book'),(15,'mismatch','turkey_transit_agency_not_covered_by_new_caledonia_transitaires','q','turkey|istanbul','q','transit agency|transit agencies','g','transitaire','',''),
(16,'uncertain','restaurant_reviews_may_be_confused_with_product_reviews','q','pizza|restaurant|restaurants','q','review|reviews|rating|ratings|top-rated','g','product review|product reviews','',''),(17,'uncertain','logistics_company_specialization_or_extra_data_unclear','q','company|companies|courier|shipping','c','company|companies|courier|shipping','q','same-day|same day|custom packaging|remote area|remote-area|international shipping|images|additional data','',''),
(20,'ok','transitaire_customs_lookup_covered','q','customs|transitaire|new caledonia|gondrand','g','transitaire','','','',''),(21,'ok','squake_project_health_covered','q','squake|checkhealth|projects|api health','g','squake|checkhealth|project','','','',''),(22,'ok','fake_user_gender_covered','q','fake user|random user|gender','c','fake|user|gender','','','',''),
(23,'ok','trustpilot_endpoint_covered','q','trustpilot','c','trustpilot|review|star','','','',''),(24,'ok','news_search_covered','q','news|article|headline','c','news|currents|article|headline|search','','','',''),(25,'ok','image_search_covered','q','image search|find images|search images|retrieve images','c','image|imagesearch|search','','','',''),
(26,'ok','web_search_covered','q','web search|search the web|find websites','c','web|search','','','',''),(27,'ok','company_or_logistics_list_covered','q','company|companies|courier|shipping','c','company|companies|courier|shipping','','','q','same-day|same day|custom packaging|remote area|remote-area|international shipping|images|additional data'),
(28,'ok','package_or_postal_tracking_covered','q','package|parcel|mail|postal','c','package|parcel|postal|tracking|track','','','g','container')),
h as (select id, n, kind, name from t, k where any_of(of(q, g, c, need1), w1) and (need2 = '' or any_of(of(q, g, c, need2), w2)) and (need3 = '' or any_of(of(q, g, c, need3), w3)) and (lack = '' or not any_of(of(q, g, c, lack), l))),
e as (select id, n, kind, name from h union all select id, 30, 'ok', 'all_detected_requirements_covered' from b where len(missing) = 0 and requirements <> ['general_information'] union all select id, 18, 'uncertain', 'partial_requirement_coverage' from b where len(covered) > 0 and not (len(missing) = 0 and requirements <> ['general_information'])),
r as (select b.*, coalesce(list(name order by n) filter (kind = 'mismatch'), []) as mismatch, coalesce(list(name order by n) filter (kind = 'uncertain'), []) as uncertain, coalesce(list(name order by n) filter (kind = 'ok'), []) as ok from b left join e using (id) group by all),
s as (select *, case when len(mismatch) > 0 then 1 when len(missing) > 0 and len(ok) = 0 then 2 when len(uncertain) > 0 and len(ok) = 0 then 3 when len(uncertain) > 0 then 4 when len(ok) > 0 then 5 else 6 end as z from r)
"""


def _spelled(sql: str) -> str:
    """The SQL with its two abbreviations written out: a text by its letter, and whether a text holds a phrase of a list."""
    sql = re.sub(r"of\(q, g, c, (\w+)\)", r"case \1 when 'q' then q when 'g' then g else c end", sql)
    return re.sub(r"any_of\((case .*? end|\w+), (\w+)\)", r"(len(list_filter(string_split(\2, '|'), lambda z: contains(\1, z))) > 0)", sql)


@query(f"with p as (select {', '.join(_CAPABLE)} from part), " + _spelled(_SEMCAP).removeprefix("with ") + """
select id, array_to_string(requirements, ';') as requirements, array_to_string(covered, ';') as covered, array_to_string(missing, ';') as missing, array_to_string(mismatch, ';') as mismatch, array_to_string(uncertain, ';') as uncertain, array_to_string(ok, ';') as ok,
case z when 1 then 'mismatch' when 2 then 'uncertain' when 3 then 'uncertain' else 'ok' end as semantic, case z when 1 then 'coverage_mismatch' when 2 then 'coverage_uncertain' when 3 then 'coverage_uncertain' when 4 then 'coverage_uncertain' else 'coverage_ok' end as coverage_pred,
case z when 1 then 'high' when 5 then 'high' else 'medium' end as coverage_confidence, case z when 1 then mismatch[1] when 2 then 'partial_or_unclear_domain_match' when 3 then 'unclear_scope' else '' end as semantic_type,
case z when 1 then mismatch[1] when 2 then 'partial_or_unclear_coverage' when 3 then uncertain[1] when 4 then uncertain[1] else '' end as coverage_type, z <> 5 as needs_review from s""")
def policy_semcap(t: Tables) -> DataFrame:
    out = S.semcap(t.part.selectExpr(*_CAPABLE).withColumn("coverage_text", F.concat_ws(" ", "gold", "flagged")))
    lists = [F.array_join(k, ";").alias(k) for k in ("requirements", "covered", "missing", "mismatch", "uncertain", "ok")]
    return out.select("id", *lists, "semantic", "coverage_pred", "coverage_confidence", "semantic_type", "coverage_type", "needs_review")


# -- later releases of the cleaning policy

_LATER = [
    "l_orderkey * 10 + l_linenumber as id", "case when l_linenumber % 2 = 0 then 'Service' else 'api' end as level", "case l_suppkey % 11 when 0 then 'api_leak_blocking' when 1 then 'api_leak_weak_or_generic' else '' end as api_leak", "case when l_orderkey % 37 = 0 then ' Strong' else 'none' end as api_leak_strength",
    "case l_partkey % 8 when 0 then 'service_leak_only' when 1 then 'ambiguous_service_leak' else 'no_service_leak' end as service_leak", "case when cast(l_quantity as int) = 17 then 'no' else 'yes' end as gold_services", "case cast(l_quantity as int) % 23 when 0 then 'unknown' when 1 then 'yes_api_name_only' else 'yes' end as gold_apis",
    "case when l_orderkey % 23 = 0 then 'Invalid_no_choice' else 'valid' end as space", "case when l_orderkey % 29 = 0 then 'invalid_level' else 'valid' end as task_type", "case l_partkey % 13 when 0 then 'mismatch' when 1 then 'uncertain' when 2 then '' else 'ok' end as semantic", "case l_suppkey % 7 when 0 then 'coverage_mismatch' when 1 then 'coverage_uncertain' when 2 then ' Coverage_OK' else 'coverage_ok' end as coverage",
    "case l_returnflag when 'R' then 'high' when 'A' then 'HIGH ' else 'medium' end as coverage_confidence", "case l_partkey % 9 when 0 then 'extra_gold_service_detected' when 1 then '' when 2 then 'unsure' when 3 then 'not_applicable' else 'ok' end as gold_set", "case l_orderkey % 7 when 0 then 'True' when 1 then 'yes' else 'no' end as overtrust",
    "case l_suppkey % 17 when 0 then '[{\"rule\": \"x\"}]' when 1 then '[ ]' when 2 then 'no json' else '' end as domain_flags", "case l_partkey % 5 when 0 then '[\"a\"]' else '[]' end as missing_flags", "case l_linestatus when 'O' then '' else 'dryrun_uncertain' end as before", "'uncertain_semcap' as before_bucket",
]
_LATER_SQL = f"""with r as (select {', '.join(_LATER)} from lineitem),
f as (select *, api_leak = 'api_leak_blocking' or api_leak_strength = ' Strong' as b1, gold_services = 'no' or gold_apis = 'unknown' as b2, space <> 'valid' as b3, task_type <> 'valid' as b4, semantic = 'mismatch' as b5, gold_set like 'extra%' as b6, domain_flags like '[{{%' as b7, missing_flags <> '[]' as m, coverage = 'coverage_mismatch' as b9,
overtrust <> 'no' as w1, gold_set not in ('ok', 'not_applicable') as w2, coverage = 'coverage_uncertain' as w3, semantic = 'uncertain' as w4, api_leak like '%generic' as w5, service_leak like 'ambiguous%' as w6, level = 'Service' and service_leak = 'service_leak_only' as leak from r),
g as (select *, m and b9 as b8, case when b1 or b2 or b3 or b4 or b5 or b6 or b7 or b9 then 'blocked' when leak then 'leak' when w1 or w2 or w3 or w4 or w5 or w6 then 'doubt' when semantic = 'ok' and coverage in ('coverage_ok', ' Coverage_OK') and coverage_confidence <> 'medium' and not m then 'clean' else 'unsure' end as z from f),
d as (select *, case z when 'blocked' then 'dryrun_removed' when 'leak' then 'dryrun_service_leak_only' when 'clean' then 'dryrun_clean_candidate' else 'dryrun_uncertain' end as decision,
case z when 'leak' then 'dryrun_service_leak_only' when 'clean' then 'dryrun_clean_candidate' when 'unsure' then 'uncertain_semcap' when 'doubt' then case when w1 then 'uncertain_generic_search_overtrusted' when w2 then 'uncertain_wrong_gold_set' when w3 or w4 then 'uncertain_semcap' when w5 then 'uncertain_weak_api_leak' else 'uncertain_ambiguous_service_leak' end
else case when b1 then 'removed_api_leak' when b2 then 'removed_gold_missing' when b3 then 'removed_choice_space_invalid' when b4 then 'removed_task_type_invalid' when b5 then 'removed_semantic_mismatch' when b6 then 'removed_wrong_gold_set' else 'removed_capability_mismatch' end end as bucket,
z = 'doubt' as dz from g)"""


@query(f"""{_LATER_SQL} select id, decision, bucket, concat_ws(';', case when b1 then 'api_leak' end, case when b9 then 'capability_mismatch' end, case when b3 then 'choice_space_invalid' end, case when b7 then 'domain_guard_violation' end, case when b2 then 'gold_missing' end, case when b8 then 'missing_core_requirement' end, case when b5 then 'semantic_mismatch' end, case when b4 then 'task_type_invalid' end, case when b6 then 'wrong_gold_set' end) as blocking,
concat_ws(';', case when dz and w6 then 'ambiguous_service_leak' end, case when dz and w3 then 'coverage_uncertain' end, case when dz and w1 then 'generic_search_overtrusted' end, case when dz and w4 then 'semantic_uncertain' end, case when z = 'unsure' then 'v12_not_high_confidence_clean' end, case when dz and w5 then 'weak_or_generic_api_leak' end, case when dz and w2 then 'wrong_gold_set_uncertain' end) as warnings,
concat_ws(';', case when z = 'clean' then 'keep_v14b_clean_candidate' end, case when b1 then 'remove_blocking_api_leak' end, case when b3 then 'remove_choice_space_invalid' end, case when b7 then 'remove_domain_specific_guard_violation' end, case when b2 then 'remove_gold_missing' end, case when b8 then 'remove_missing_core_requirement' end, case when b4 then 'remove_task_type_invalid' end, case when b9 then 'remove_v12_capability_mismatch' end, case when b5 then 'remove_v12_semantic_mismatch' end, case when b6 then 'remove_wrong_gold_set' end,
case when z = 'leak' then 'separate_service_level_service_leak' end, case when dz and w6 then 'uncertain_ambiguous_service_leak' end, case when dz and w1 then 'uncertain_generic_search_overtrusted' end, case when dz and w4 then 'uncertain_v12_semantic' end, case when dz and w3 then 'uncertain_v12_semcap' end, case when dz and w5 then 'uncertain_weak_api_leak' end, case when dz and w2 then 'uncertain_wrong_gold_set' end) as rules,
case when z = 'clean' then 'clean_candidate_high_conf' else '' end as confidence, case when before = '' then 'no_v1_4_decision_available' when decision = 'dryrun_uncertain' and bucket = 'uncertain_semcap' then 'unchanged' else 'dryrun_uncertain:uncertain_semcap->' || decision || ':' || bucket end as change from d""")
def policy_integrity(t: Tables) -> DataFrame:
    return N.integrity_policy(t.lineitem.selectExpr(*_LATER)).select("id", "decision", "bucket", "blocking", "warnings", "rules", "confidence", "change")


@query(f"""{_LATER_SQL}, e as (select *, concat_ws(';', case when b1 then 'blocking_api_leak_into_clean' end, case when b9 then 'coverage_mismatch_into_clean' end, case when w3 then 'coverage_uncertain_into_clean' end, case when b7 then 'domain_specific_guard_violation_into_clean' end, case when w1 then 'generic_search_overtrust_into_clean' end, case when b2 then 'gold_missing_into_clean' end, case when m then 'missing_core_requirement_into_clean' end,
case when b3 then 'no_choice_space_into_clean' end, case when b5 then 'semantic_mismatch_into_clean' end, case when w4 then 'semantic_uncertain_into_clean' end, case when leak then 'service_level_service_leak_into_clean' end, case when b6 then 'wrong_gold_set_into_clean' end) as flags from d)
select id, flags from e where flags <> ''""")
def policy_dangers(t: Tables) -> DataFrame:
    """The audit of a decision that takes every row for clean."""
    return N.dangers(t.lineitem.selectExpr(*_LATER, f"'{N.CLEAN}' as decision")).select("id", F.array_join("flags", ";").alias("flags"))


# Some of the released requirements.
_EXPLICIT = [
    ("energy_price_news_articles_by_source", ["energy prices", "energy price", "different sources in europe", "sources in europe"], ["article", "articles", "search", "specific article"], ["sources by region", "list of sources"]),
    ("vegan_restaurant_recommendation", ["vegan-friendly restaurant", "vegan restaurant"], ["vegan restaurant", "vegan-friendly", "cuisine", "dietary", "restaurant recommendation"], ["get restaurants by address", "get restaurant by link"]),
    ("playlist_or_theme_song", ["playlist", "theme songs", "popular songs to play"], ["playlist", "theme song", "song recommendation", "popular songs", "music"], ["song details"]),
    ("book_cover_by_title_author", ["book cover image", "book cover", "by paulo coelho"], ["title", "author", "isbn", "search"], []),
]
_EXPLICIT_Q = ["energy prices from Reuters", "a vegan restaurant, also  songs", "playlist? and now?", "book cover", "find, check and list it", "plain words", "Bitcoin and cricket", "news of the times"]
_EXPLICIT_G = ["Reuters  articles", "list of sources search", "cuisine of coin", "song details music", "isbn and climate news", "instagram Latest IPL", "random image", "the times"]
_STEP = [
    "p_partkey as id", f"{_pick(_EXPLICIT_Q, 'p_partkey % 8')} as query", f"{_pick(_EXPLICIT_G, 'p_size % 8')} as gold", "case when p_partkey % 3 = 0 then 'General_Information' else 'weather' end as asked", "case p_partkey % 7 when 0 then 'dryrun_removed' else 'dryrun_clean_candidate' end as before",
    "case p_partkey % 7 when 0 then 'removed_api_leak' else 'dryrun_clean_candidate' end as before_bucket",
]


@query(f"""with r as (select *, p % 8 as q, s % 8 as g, p % 7 > 0 as c from (select {', '.join(_STEP)}, p_partkey as p, p_size as s from part)),
f as (select *, c and q = 0 and g <> 0 as g1, c and q = 1 and g <> 2 as g2, c and q = 2 as g3, c and q = 3 and g not in (1, 4) as g4, c and q = 0 and g <> 0 as n1, c and q = 7 and g <> 7 as n2,
c and g = 2 and q <> 6 as x1, c and g = 5 and q <> 6 as x2, c and g = 4 as x3, c and g = 5 as x4, c and g = 6 as x5, c and asked like 'G%' and q in (1, 2, 4) as fb from r),
h as (select *, x1 or x2 or x3 or x4 or x5 as wrong, g1 or g2 or g3 or g4 or n1 or n2 as gap from f), d as (select *, case when not c then before when wrong or gap then 'dryrun_removed' when fb then 'dryrun_uncertain' else before end as decision, case when not c then before_bucket when wrong then 'removed_wrong_gold_set' when gap then 'removed_capability_mismatch' when fb then 'uncertain_semcap_general_information_fallback' else before_bucket end as bucket from h)
select id, decision, bucket, concat_ws(';', case when gap then 'domain_specific_gap' end, case when wrong then 'wrong_gold_set' end) as blocking, case when fb then 'general_information_fallback' else '' end as warnings,
concat_ws(';', case when c and not wrong and not gap and not fb then 'keep_v14c_clean_candidate' end, case when not c then 'preserve_v14b_non_clean_decision' end, case when gap then 'v14c_domain_specific_requirement_explicit_match' end, case when fb then 'v14c_general_information_fallback_blocking' end, case when wrong then 'v14c_gold_set_integrity_hard_gate' end) as rules,
concat_ws(';', case when fb then 'general_information_fallback_cannot_clean_multi_requirement_query' end, case when g1 then 'energy_price_news_articles_by_source' end, case when g2 then 'vegan_restaurant_recommendation' end, case when g3 then 'playlist_or_theme_song' end, case when g4 then 'book_cover_by_title_author' end, case when n1 then 'source_specific_news_missing_named_source:reuters' end, case when n2 then 'source_specific_news_missing_named_source:the times' end) as gaps,
concat_ws(';', case when x1 then 'crypto_or_bybit_extra_without_crypto_need' end, case when x2 then 'ipl_extra_without_cricket_need' end, case when x3 then 'climate_news_extra_without_climate_need' end, case when x4 then 'instagram_extra_for_tiktok_need' end, case when x5 then 'miku_or_random_image_extra_for_specific_image_need' end) as extra_gold,
case when decision = before and bucket = before_bucket then 'unchanged' else before || ':' || before_bucket || '->' || decision || ':' || bucket end as change from d""")
def policy_explicit(t: Tables) -> DataFrame:
    rows = t.part.selectExpr(*_STEP).withColumn("requirements", F.array("asked"))
    out = N.explicit_policy(rows, S.requirement_table(_EXPLICIT))
    return out.select("id", "decision", "bucket", "blocking", "warnings", "rules", F.array_join("gaps", ";").alias("gaps"), F.array_join("extra_gold", ";").alias("extra_gold"), "change")


_JUDGED = [
    "o_orderkey as id", "case when o_orderkey % 9 = 0 then 'dryrun_removed' else 'dryrun_clean_candidate' end as before", "'b' as before_bucket", f"{_pick(['api_leak;x', 'gold_missing', 'choice_space_invalid', 'Service_Leak', 'task_type', ''], 'least(o_custkey % 41, 5)')} as blocking",
    "case o_custkey % 23 when 0 then null when 1 then 'bad' else 'ok' end as parse_status", "case o_custkey % 13 when 0 then 'mismatch' when 1 then 'uncertain' when 2 then null else 'ok' end as semantic", "case o_orderkey % 11 when 0 then 'coverage_mismatch' when 1 then 'coverage_uncertain' else 'coverage_ok' end as coverage",
    "case o_orderkey % 19 when 0 then '[\"a\"]' when 1 then 'text' when 2 then '{\"a\": 1}' when 3 then null else '[]' end as missing_json", "case o_orderkey % 17 when 0 then '[ 1 ]' else '' end as extra_json", "case o_orderkey % 7 when 0 then 'True' else '' end as overtrust", "case o_custkey % 7 when 0 then 'true' else 'no' end as gap",
    "case o_custkey % 5 when 0 then 'TRUE' else null end as wrong_gold", "case o_orderkey % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' end as risk",
]


@query(f"""with r as (select {', '.join(_JUDGED)}, o_orderkey as k, o_custkey as u from orders), z as (select *, case when k % 9 = 0 then 0 when u % 41 < 5 then 1 when u % 23 = 0 then 2 when u % 23 = 1 then 3 when u % 13 = 0 then 4 when u % 13 = 1 then 5 when k % 11 = 0 then 6 when k % 11 = 1 then 7 when k % 19 < 2 then 8 when k % 17 = 0 then 9 when k % 7 = 0 then 10 when u % 7 = 0 then 11 when u % 5 = 0 then 12 when u % 13 <> 2 and k % 4 < 2 then 13 else 14 end as z from r)
select id, case z when 0 then before when 1 then 'judge_removed_hard_policy_block' when 2 then 'judge_uncertain_missing_prediction' when 3 then 'judge_uncertain_parse_failed' when 4 then 'judge_removed_semantic_mismatch' when 6 then 'judge_removed_capability_mismatch' when 8 then 'judge_removed_or_uncertain_missing_requirement' when 9 then 'judge_removed_wrong_gold_set' when 10 then 'judge_uncertain_or_removed_generic_search_overtrust' when 11 then 'judge_removed_capability_mismatch' when 12 then 'judge_removed_wrong_gold_set' when 13 then 'judge_assisted_clean_candidate' else 'judge_uncertain_semcap' end as decision,
case z when 0 then 'b' when 1 then 'judge_hard_policy_block' when 2 then 'judge_missing_prediction' when 3 then 'judge_parse_failed' when 4 then 'judge_removed_semantic_mismatch' when 5 then 'judge_uncertain_semantic_alignment' when 6 then 'judge_removed_capability_mismatch' when 7 then 'judge_uncertain_capability_coverage' when 8 then 'judge_missing_requirement' when 9 then 'judge_extra_unrelated_gold' when 10 then 'judge_generic_search_overtrust' when 11 then 'judge_domain_specific_gap' when 12 then 'judge_wrong_gold_set' when 13 then 'judge_assisted_clean_candidate' else 'judge_uncertain_residual' end as bucket,
case z when 0 then 'not_a_clean_candidate' when 1 then 'hard_policy:' || ['api_leak', 'gold_missing', 'choice_space', 'service_leak', 'task_type'][cast(u % 41 + 1 as int)] when 2 then 'missing_prediction' when 3 then 'parse_status:bad' when 4 then 'semantic_mismatch' when 5 then 'semantic_uncertain' when 6 then 'coverage_mismatch' when 7 then 'coverage_uncertain' when 8 then 'missing_requirements_nonempty' when 9 then 'extra_unrelated_gold_services' when 10 then 'generic_search_overtrust' when 11 then 'domain_specific_gap' when 12 then 'wrong_gold_set' when 13 then 'all_conditions_passed' else 'residual_uncertain' end as reason from z""")
def policy_judge(t: Tables) -> DataFrame:
    return N.judge_policy(t.orders.selectExpr(*_JUDGED)).select("id", "decision", "bucket", "reason")
