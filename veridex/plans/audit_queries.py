"""Queries over split audits, challenges, reviews, checked joins and unified fields."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions import text as T
from veridex.operators import balance as B
from veridex.operators import joins as J
from veridex.operators import manifests as M
from veridex.operators import reviews as V
from veridex.operators import sampling as S
from veridex.operators import splits as Q
from veridex.operators import stats as A
from veridex.plans.flow_queries import _h
from veridex.plans.registry import Tables, query
from veridex.plans.scratch import shared_dir
from veridex.sources import adapters as E
from veridex.sources import readers as D
from veridex.sources.json_arrays import read_json_elements
from veridex.streaming import trace_index as I

# -- splits

_ASSIGNED = [
    "case when o_orderkey % 103 = 0 then -1 - o_orderkey else o_orderkey end as row_id", "o_custkey as grp", "case when o_custkey % 10 < 8 then 'train' when o_custkey % 10 = 8 then 'dev' when o_orderkey % 97 = 0 then 'dev' when o_orderkey % 499 = 0 then 'none' else 'test' end as split", "o_orderpriority as task",
    "o_orderstatus as source", "concat(o_orderpriority, '|', o_orderstatus) as cell", "case when o_orderkey % 101 = 0 then 'edited' else concat('c', cast(o_orderkey % 700 as varchar(20))) end as content", "case when o_orderkey % 5 = 0 then '' else concat('q', cast(o_custkey % 400 as varchar(20))) end as query", "concat('p', cast(o_custkey as varchar(20))) as parent",
]
_TARGETS = {"train": 0, "dev": 150, "test": 150}


@query(f"""with r as (select {', '.join(_ASSIGNED)} from orders), o as (select o_orderkey as row_id, concat('c', o_orderkey % 700) as content from orders), ed as (select o_orderkey as u, min(o_orderkey) over (partition by o_custkey % 1000) as v, 'F' as source from orders),
n as (select count(*) as n, count(*) filter (split = 'test') as test, count(*) filter (split = 'dev') as dev, count(*) filter (split not in ('train', 'dev', 'test')) as odd from r), torn as (select count(*) as k from (select grp from r group by 1 having count(distinct split) > 1)), copies as (select count(*) as k from (select content from r group by 1 having count(distinct split) > 1)),
shared as (select (select count(*) from (select query from r where query <> '' group by 1 having count(distinct split) > 1)) + (select count(*) from (select parent from r group by 1 having count(distinct split) > 1)) as k),
rel as (select count(*) filter (a.split <> b.split) as cut, count(*) filter (a.source <> b.source or a.source <> ed.source) as alien from ed join r a on a.row_id = ed.u join r b on b.row_id = ed.v where ed.u <> ed.v),
m as (select (select count(*) from r where row_id not in (select row_id from o)) + (select count(*) from o where row_id not in (select row_id from r)) as mutated, (select count(*) from r join o using (row_id) where r.content <> o.content) as edited),
t as (select task, count(*) as total, count(distinct grp) as groups, count(*) filter (split = 'test') as test from r group by 1), tk as (select count(*) filter (t.test = 0) as without, count(*) filter (t.test < case when groups >= 20 then 20 else 1 end) as few, count(*) filter (t.test / greatest(n.test, 1)::double > least(0.7, total / n.n::double + 0.15) + 1e-12) as dominant from t, n),
c as (select cell, count(*) as total, count(distinct grp) as groups, count(*) filter (split = 'test') as test, count(*) filter (split = 'dev') as dev from r group by 1), ck as (select count(*) filter (groups >= 20 and c.test < 5) as few, count(*) filter (total >= 1000 and groups >= 20 and (abs(c.dev / total::double - 150 / n.n::double) > 0.05 + 1e-12 or abs(c.test / total::double - 150 / n.n::double) > 0.05 + 1e-12)) as off, count(*) filter (c.test = 0 and groups >= 3) as lost from c, n),
a as (select 'H01_group_unsplit' as k, k as v from torn union all select 'H02_tasks_in_test', without from tk union all select 'H03_identity_group_overlap', k from shared union all select 'H04_relationship_conflicts', cut from rel union all select 'H05_content_duplicate_conflicts', k from copies union all select 'H08_task_minimum', few from tk union all select 'H09_source_task_minimum', few from ck
union all select 'H10_named_cell_in_test', lost from ck union all select 'H11_task_dominance', dominant from tk union all select 'H12_content_immutable', edited from m union all select 'H13_large_source_task_ratio', off from ck union all select 'H14_no_row_mutation', mutated + odd from m, n union all select 'H15_source_local_edges', alien from rel)
select k as "constraint", v = 0 as passed, v::double as observed from a union all select 'H06_test_size', test = 150, test::double from n union all select 'H07_dev_size', dev = 150, dev::double from n""")
def split_hard_constraints(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr(*_ASSIGNED).withColumnRenamed("grp", "group")
    original = t.orders.select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 700).cast("string")).alias("content"))
    first = t.orders.groupBy((F.col("o_custkey") % 1000).alias("_c")).agg(F.min("o_orderkey").alias("v"))
    edges = t.orders.withColumn("_c", F.col("o_custkey") % 1000).join(first, "_c").select(F.col("o_orderkey").alias("u"), "v", F.lit("F").alias("source")).where("u != v")
    return Q.hard_constraints(rows, _TARGETS, original, ["query", "parent"], edges)


_WAS = "case when o_custkey % 10 < 7 then 'train' when o_custkey % 10 = 7 then 'dev' else 'test' end"


@query(f"""with n as (select count(*) as n from orders), s as (select 'dev' as split, n // 10 as n from n union all select 'test', n // 10 from n union all select 'train', n - n // 10 - n // 10 from n)
select split, n, 0 as torn, true as whole from s""")
def split_rebalanced(t: Tables) -> DataFrame:
    """Sizes that must be exact, from an assignment whose sizes are not: customers stay whole and labels near their shares."""
    rows = t.orders.selectExpr("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", f"{_WAS} as was")
    n = rows.count()
    made = B.balance(rows, "o_custkey", ["o_orderpriority", "o_orderstatus"], B.Objective(exact={"dev": n // 10, "test": n // 10}, least={"test": 5}, stay=1.0), was="was")
    placed = rows.join(made.groups.select(F.col("group").alias("o_custkey"), "split"), "o_custkey", "left")
    each = placed.groupBy("o_custkey").agg(F.count_distinct("split").alias("k"), F.min("split").alias("split"), F.count("*").alias("n"))
    return each.groupBy("split").agg(F.sum("n").alias("n"), F.count_if(F.col("k") != 1).cast("int").alias("torn"), F.lit(True).alias("whole"))


@query("""with l as (select 'o_orderpriority' as field, o_orderpriority as value, count(*) as total from orders group by 2 union all select 'o_orderstatus', o_orderstatus, count(*) from orders group by 2), s(split, r) as (values ('train', 0.8), ('dev', 0.1), ('test', 0.1))
select field, value, split, total, true as near from l, s""")
def split_balanced(t: Tables) -> DataFrame:
    """Every label's rows in every split, counted again from the assignment: at most 1 % of the label's rows, or two rows, off its share."""
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus")
    made = B.balance(rows, "o_custkey", ["o_orderpriority", "o_orderstatus"])
    placed = rows.join(made.groups.select(F.col("group").alias("o_custkey"), "split"), "o_custkey")
    labels = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in ("o_orderpriority", "o_orderstatus"))))
    counted = placed.select("split", labels.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("total"), *(F.count_if(F.col("split") == s).alias(s) for s in Q.RATIOS))
    near = lambda s: F.abs(F.col(s) - Q.RATIOS[s] * F.col("total")) <= F.greatest(F.lit(2.0), 0.01 * F.col("total"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), near(s).alias("near")) for s in Q.RATIOS)))
    return counted.select("field", "value", "total", each.alias("x")).select("field", "value", "x.split", "total", "x.near")


@query("""with r as (select source, 'lang' as field, lang as value from documents union all select source, 'n_chars', cast(n_chars as varchar) from documents union all select source, 'text_md5', md5(text) from documents), c as (select field, value, source, count(*) as n from r where nullif(trim(value), '') is not null group by 1, 2, 3), v as (select field, value, count(*) as s, sum(n)::bigint as n from c group by 1, 2)
select field, count(*) as distinct_values, count(*) filter (s > 1) as shared_values, coalesce(sum(n) filter (s > 1), 0)::bigint as affected_rows, sum(n - 1)::bigint as edges_before, sum(n - s)::bigint as edges_after from v group by 1""")
def split_scopes(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "lang", F.col("n_chars").cast("string").alias("n_chars"), F.md5("text").alias("text_md5"))
    return Q.scope_audit(rows, "source", ["lang", "n_chars", "text_md5"])


@query("""with g as (select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderpriority = '1-URGENT') as u from orders group by 1)
select '[' || f || ',' || o || ',' || u || ']' as profile, n, count(*) as groups, min(o_custkey) as first_group from g group by f, o, u, n""")
def split_profiles(t: Tables) -> DataFrame:
    return Q.group_profiles(t.orders, "o_custkey", {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT"]})


_CANDIDATES = [
    "p_partkey as id", "p_partkey % 3 <> 0 as valid", "p_size % 4 as maximum_task_test_share", "p_partkey % 5 as cell_test_l1", "p_size % 7 as task_test_l1", "p_partkey % 2 as source_test_l1", "p_size as minimum_task_test_rows", "p_size % 3 as minimum_eligible_cell_test_rows", "p_partkey % 11 as moved_rows", "p_partkey % 13 as moved_groups", "concat('h', p_partkey) as assignment_hash",
]


@query(f"select id, assignment_hash from (select {', '.join(_CANDIDATES)} from part) where valid order by maximum_task_test_share, cell_test_l1, task_test_l1, source_test_l1, minimum_task_test_rows desc, minimum_eligible_cell_test_rows desc, moved_rows, moved_groups, assignment_hash limit 1")
def split_recommended(t: Tables) -> DataFrame:
    return Q.recommended(t.part.selectExpr(*_CANDIDATES)).select("id", "assignment_hash")


# -- challenges and manifests

_EVIDENCE = "select l_orderkey as q, l_partkey as c, l_returnflag as m, min(l_linenumber) as rank, max(l_quantity) as score from lineitem group by 1, 2, 3"


@query(f"""with e as ({_EVIDENCE}), t as (select o_orderkey as q, o_orderdate, list_sort(list(distinct l_partkey) filter (l_returnflag = 'R')) as g from orders join lineitem on l_orderkey = o_orderkey group by 1, 2), k as (select q, coalesce(g, []) as g, coalesce(len(g), 0) as n from t),
s as (select *, greatest(10, n + n) - n as need, len(list_filter(g, lambda x: x % 17 = 0)) > 0 as lost from k), x as (select e.*, row_number() over (partition by e.q, m order by rank, score desc, c) as place, case m when 'R' then 1 when 'N' then 2 else 3 end as turn from e join s on s.q = e.q where c % 17 <> 0 and not list_contains(g, c)),
b as (select q, c, min(place * 10 + turn) as t from x group by 1, 2), a as (select q, count(*) as have from b group by 1)
select s.q as task_id, case when lost then 'GOLD_NOT_IN_CATALOG' when coalesce(have, 0) < need then 'INSUFFICIENT_MACHINE_CANDIDATES' else 'READY' end as status, case when not lost and coalesce(have, 0) >= need then n + need end as candidates from s left join a using (q)""")
def challenge_states(t: Tables) -> DataFrame:
    evidence = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("candidate_id"), F.col("l_returnflag").alias("method")).agg(F.min("l_linenumber").alias("rank"), F.max("l_quantity").alias("score"))
    tasks = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))))).alias("alternatives"))
    known = t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderkey").alias("position"))
    out = S.challenge_set(tasks.join(known, "task_id"), evidence, t.part.select(F.expr("if(p_partkey % 17 = 0, -1 - p_partkey, p_partkey)").alias("candidate_id")), ["R", "N", "A"], 100, 147949090)
    return out.select("task_id", "status", F.when(F.col("status") == "READY", F.size("candidates")).cast("long").alias("candidates"))


@query("""with r as (select l_orderkey as t, l_partkey as c, min(l_linenumber) as k from lineitem group by 1, 2), o as (select t, list(c order by k, c) as c from r where k <= 3 group by 1)
select t as task_id, sha256(concat_ws(chr(10), 'global', t, sha256('order ' || t), sha256('["' || array_to_string(c, '","') || '"]'), sha256('rank'), sha256('ranking'), 'm2', sha256('greedy'))) as cache_key, len(c) as n_candidates from o""")
def manifest_retrieval(t: Tables) -> DataFrame:
    ranked = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("candidate_id")).agg(F.min("l_linenumber").alias("rank"))
    tasks = ranked.select("task_id").distinct().withColumn("query", F.concat(F.lit("order "), "task_id"))
    out = M.retrieval_manifest(tasks, ranked, t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("document")), 3, "global", "m2")
    return out.select("task_id", "cache_key", F.size("visible_input.candidates").cast("long").alias("n_candidates"))


# -- reviews


@query("""select c_custkey, concat_ws(';', case when c_custkey % 7 = 0 then 'missing:policy_id' end, case when c_custkey % 5 = 0 then 'unsupported_review_mode' end, case when c_custkey % 11 = 0 then 'authoritative_round' end, case when c_custkey % 5 = 1 and c_custkey % 3 = 0 then 'single:secondary_review_role' end, case when c_custkey % 5 = 1 and c_custkey % 13 = 0 then 'single:requires_second_reader' end) as errors from customer""")
def review_policies(t: Tables) -> DataFrame:
    rows = t.customer.selectExpr(
        "c_custkey",
        "map_filter(map('schema_version', '1', 'policy_id', if(c_custkey % 7 = 0, null, 'p'), 'review_mode', case c_custkey % 5 when 0 then 'panel' when 1 then 'single_human_review' else 'independent_double_review' end, 'authoritative_round', if(c_custkey % 11 = 0, 'secondary', 'primary'), "
        "'secondary_review_role', if(c_custkey % 3 = 0, 'gating', 'supplemental_non_gating'), 'require_independent_secondary_reviewer', if(c_custkey % 13 = 0, 'True', 'false'), 'require_adjudication', 'false'), (k, v) -> v is not null) as fields",
    )
    return V.policy_errors(rows, "c_custkey").select("c_custkey", F.array_join("errors", ";").alias("errors"))


_ROUNDS = """with s as (select o_orderkey as id, o_orderpriority as task_type, o_orderkey % 2 = 0 as due, case when o_orderkey % 19 = 0 then null when o_orderkey % 4 = 0 then 'remove' else 'keep' end as d1, case when o_orderkey % 6 = 0 then null when o_orderkey % 10 = 0 then 'uncertain' else 'keep' end as d2, case when o_orderkey % 8 = 0 then 'remove' end as d3, case when o_orderkey % 16 = 0 then 'anna' else 'carl' end as r3 from orders),
f as (select *, case when d1 is null then 'primary_pending' when not due then 'single_human_review_complete' when d2 is null then 'secondary_pending' when d1 <> d2 and d3 is not null and r3 = 'carl' then 'human_adjudicated' when d1 <> d2 then 'adjudication_pending' else 'double_review_agreement' end as resolution from s),
g as (select *, case when resolution = 'human_adjudicated' then d3 when resolution in ('single_human_review_complete', 'double_review_agreement') then d1 end as final from f)"""


def _resolved(t: Tables) -> DataFrame:
    sample = t.orders.selectExpr("o_orderkey as task_id", "o_orderpriority as task_type", "o_orderkey % 2 = 0 as secondary_due")
    rows = t.orders.selectExpr(
        "o_orderkey as task_id",
        "explode(array(named_struct('round', if(o_orderkey % 4 = 1, 'inherited', 'primary'), 'reviewer', 'anna', 'decision', case when o_orderkey % 19 = 0 then null when o_orderkey % 4 = 0 then 'remove' else 'keep' end), "
        "named_struct('round', 'secondary', 'reviewer', 'ben', 'decision', case when o_orderkey % 6 = 0 then null when o_orderkey % 10 = 0 then 'uncertain' else 'keep' end), named_struct('round', 'adjudication', 'reviewer', if(o_orderkey % 16 = 0, 'anna', 'carl'), 'decision', if(o_orderkey % 8 = 0, 'remove', null)))) as r",
    ).select("task_id", "r.*")
    return V.resolve_rounds(sample, rows.where("decision is not null"))


@query(_ROUNDS + " select id as task_id, resolution, final as final_decision from g")
def review_rounds(t: Tables) -> DataFrame:
    return _resolved(t).select("task_id", "resolution", "final_decision")


@query(_ROUNDS + """, n as (select task_type, count(*) as sampled, count(*) filter (final = 'keep') as keep, count(*) filter (final = 'remove') as remove, count(*) filter (final = 'uncertain') as uncertain, count(*) filter (final is null) as pending, count(*) filter (resolution in ('adjudication_pending', 'human_adjudicated')) as disagreements from g group by 1)
select *, case when pending > 0 then 'HUMAN_REVIEW_PENDING' when uncertain > 0 then 'QA_ACTION_REQUIRED' when remove > 0 then 'QA_REVIEW_COMPLETE_WITH_EXCLUSIONS' else 'QA_REVIEW_COMPLETE' end as status from n""")
def review_rollup(t: Tables) -> DataFrame:
    return V.task_rollup(_resolved(t))


_TARGET = [
    "p_partkey as id", "case when p_partkey % 2 = 0 then 'service' else 'api' end as target", "case when p_partkey % 2 = 1 then 'not_applicable' when p_partkey % 3 = 0 then 'false' else 'true' end as service_gold_complete", "case when p_partkey % 2 = 1 then 'not_applicable' when p_partkey % 7 = 0 then '' else 'true' end as service_candidate_space_valid",
    "case when p_partkey % 2 = 1 then 'not_applicable' when p_partkey % 11 = 0 then 'uncertain' else 'false' end as service_leakage_final", "case when p_partkey % 2 = 1 then 'true' when p_partkey % 5 = 0 then 'true' else 'not_applicable' end as api_gold_complete", "case when p_partkey % 2 = 1 then 'true' else 'not_applicable' end as api_candidate_space_valid",
    "case when p_partkey % 2 = 1 then 'true' else 'not_applicable' end as api_leakage_final", "case when p_size % 2 = 0 then 'keep' else 'remove' end as final_decision",
]


@query(f"""with r as (select {', '.join(_TARGET)} from part) select id, 'ERROR' as severity, 'TARGET_CHECK_NOT_DECIDED' as code, 'service_candidate_space_valid' as field, '' as observed, 'true|false|uncertain' as expected from r where target = 'service' and service_candidate_space_valid = ''
union all select id, 'ERROR', 'OTHER_TARGET_DECIDED', 'api_gold_complete', 'true', 'not_applicable' from r where target = 'service' and api_gold_complete = 'true' union all select id, 'ERROR', 'KEEP_WITH_FAILED_CHECK', 'final_decision', 'keep', 'remove|uncertain' from r where target = 'service' and final_decision = 'keep' and service_gold_complete = 'false'
union all select id, 'WARNING', 'KEEP_WITH_UNCERTAIN_CHECK', 'final_decision', 'keep', 'uncertain' from r where target = 'service' and final_decision = 'keep' and service_leakage_final = 'uncertain'""")
def review_findings(t: Tables) -> DataFrame:
    return V.findings(t.part.selectExpr(*_TARGET), "id", [*V.target_rules("service"), *V.target_rules("api")])


@query("""select event_id, case event_id % 6 when 0 then '' when 1 then 'not_an_object' when 2 then 'top_level_keys' when 3 then 'forbidden_key' when 4 then 'candidate_order' else 'forbidden_key' end as issues from events""")
def boundary_issues(t: Tables) -> DataFrame:
    prompt = lambda more, ids: 'Rank.\\nINPUT_JSON={\\"query\\": \\"q: \\\\\\"gold_count\\\\\\": 1\\", \\"candidate_documents\\": [' + ", ".join(f'{{\\"candidate_id\\": \\"{i}\\", \\"document\\": \\"d\\"}}' for i in ids) + "]" + more + "}"
    whole = lambda more="", ids="ab", top="", deep="": '{"request_id": "r", "prompt": "' + prompt(more, ids) + '", "candidate_ids": ["a", "b"], "decoding_config": {"t": 0' + deep + '}, "timeout_seconds": 5' + top + "}"
    forms = [whole(), "[1]", whole(top=', "extra": 1'), whole(deep=', "x": [{"Reviewer_id": 1}]'), whole(ids="ba"), whole(more=', \\"gold_count\\": 2')]
    rows = t.events.select("event_id", F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 6).cast("int") + 1).alias("request"))
    return V.boundary_issues(rows, "event_id", "request").select("event_id", F.array_join("issues", ";").alias("issues"))


# -- metrics and samples


@query("""with r as (select l_orderkey as task, list(l_partkey order by l_linenumber, l_partkey) as ranking, list(distinct l_partkey) filter (l_returnflag = 'R') as gold from lineitem group by 1), x as (select task, case when task % 3 = 0 then 'single_service' when task % 3 = 1 then 'single_api' else 'multi' end as task_type, list_distinct(ranking) as rk, ranking, gold from r where gold is not null),
b as (select *, case when len(ranking) <= 5 then '2-5' when len(ranking) <= 20 then '6-20' else '21-50' end as bucket from x), n as (select task_type, bucket, count(*) as n, max(len(ranking)) as most from b group by 1, 2),
k as (select b.task_type, b.bucket, k, avg(2.0 * len(list_intersect(gold, ranking[1:k])) / (len(ranking[1:k]) + len(gold))) as f1 from b join n on n.task_type = b.task_type and n.bucket = b.bucket, lateral (select unnest(generate_series(1, least(20, most))) as k) group by 1, 2, 3),
o as (select *, row_number() over (partition by task_type, bucket order by round(f1, 12) desc, k) as r from k)
select n.task_type, n.bucket, n, case when n.task_type = 'single_service' then 1 else k end::int as selected_k, case when n.task_type = 'single_service' then 1.0 else round(f1, 6) end as mean_f1 from n join o on o.task_type = n.task_type and o.bucket = n.bucket and r = 1""")
def stats_cardinality_lenient(t: Tables) -> DataFrame:
    key = F.col("l_partkey").cast("string")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("task")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string")).alias("ranking"), F.collect_set(F.when(F.col("l_returnflag") == "R", key)).alias("gold"))
    kind = F.when(F.col("task") % 3 == 0, "single_service").when(F.col("task") % 3 == 1, "single_api").otherwise("multi")
    out = A.fit_cardinality(rows.select(kind.alias("task_type"), "ranking", F.array("gold").alias("alternatives")), least_rows=1, fixed="single_service")
    return out.select("task_type", "bucket", "n", "selected_k", "mean_f1")


@query("select round(avg(c_acctbal) / 10000, 9) as observed, round(avg(s_acctbal) / 10000, 9) as expected, abs(avg(c_acctbal) - avg(s_acctbal)) / 10000 <= 0.01 as passed from (select avg(c_acctbal) as c_acctbal from customer), (select avg(s_acctbal) as s_acctbal from supplier)")
def stats_mrr_gate(t: Tables) -> DataFrame:
    out = A.mrr_gate(t.customer.select((F.col("c_acctbal") / 10000).alias("mrr")), t.supplier.select((F.col("s_acctbal") / 10000).alias("mrr")))
    return out.select(F.round("observed", 9).alias("observed"), F.round("expected", 9).alias("expected"), "passed")


@query("""with r as (select l_orderkey as id, l_returnflag as name, avg(l_quantity) as v from lineitem group by 1, 2 union all select distinct l_orderkey, 'all', cast(l_orderkey % 7 as double) from lineitem) select name, round(avg(v), 9) as mean from r group by 1 having count(distinct id) = (select count(distinct l_orderkey) from lineitem)""")
def stats_shared_means(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("name")).agg(F.avg("l_quantity").alias("v"))
    rows = rows.unionByName(t.lineitem.select(F.col("l_orderkey").alias("id")).distinct().select("id", F.lit("all").alias("name"), (F.col("id") % 7).cast("double").alias("v")))
    return A.mean_of_shared(rows, "id", "name", "v").select("name", F.round("mean", 9).alias("mean"))


@query(f"with r as (select doc_id, source, row_number() over (partition by source order by {_h('pool', 'source', 'doc_id')}, doc_id) as position from documents) select doc_id, source, position from r where position <= case source when 'src0' then 103 when 'src1' then 150 else 0 end")
def sample_pools(t: Tables) -> DataFrame:
    return S.hashed_pools(t.documents, {"src0": 3, "src1": 5}, "source", "doc_id", "pool").select("doc_id", "source", F.col("position").cast("long").alias("position"))


@query(f"""with p as (select p_partkey as id, case when p_size % 6 = 0 then p_brand end as grp from part), c as (select id, grp, id as position from p order by id limit 40), h as (select count(grp) as have from c), b as (select *, row_number() over (order by position desc) as r from c where grp is null),
s as (select *, row_number() over (order by {_h('dup', 'grp', 'id')}, id) as r from p where grp is not null and id not in (select id from c)), w as (select b.id as gone, b.position, s.id, s.grp from b join s using (r), h where b.r <= 20 - have)
select id, grp, position, false as replaced from c where id not in (select gone from w) union all select id, grp, position, true from w""")
def sample_duplicates(t: Tables) -> DataFrame:
    pool = t.part.selectExpr("p_partkey as id", "case when p_size % 6 = 0 then p_brand end as grp")
    chosen = pool.orderBy("id").limit(40).withColumn("position", F.col("id"))
    return S.cover_duplicates(chosen, pool, "id", "grp", "position", 20, "dup").select("id", "grp", "position", "replaced")


@query(f"with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {_h('second', 'o_orderkey')}, o_orderkey) as r from orders) select o_orderkey, o_orderpriority from r where r <= case o_orderpriority when '1-URGENT' then 30 else 20 end")
def sample_secondary(t: Tables) -> DataFrame:
    return S.secondary_sample(t.orders, "o_orderpriority", "o_orderkey", {"1-URGENT": 30}, 20, "second").select("o_orderkey", "o_orderpriority")


# -- joins and unified fields


@query("""select o_orderkey, case when c_custkey is null then 'unmatched' when o_orderkey % 4 = 0 or o_orderkey % 6 = 0 then 'mismatch' else 'matched' end as status, case when c_custkey is null then '' else concat_ws(';', case when o_orderkey % 4 = 0 then 'source' end, case when o_orderkey % 6 = 0 then 'query_hash' end) end as differs from orders left join (select case when c_custkey % 10 = 0 then -c_custkey else c_custkey end as c_custkey from customer) on c_custkey = o_custkey""")
def join_guarded(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey", "o_custkey as c_custkey", "if(o_orderkey % 4 = 0, 'other', 'own') as source", "if(o_orderkey % 6 = 0, null, 'h') as query_hash")
    side = t.customer.selectExpr("if(c_custkey % 10 = 0, -c_custkey, c_custkey) as c_custkey", "'own' as source", "'h' as query_hash")  # keys that the other side lacks
    return J.guarded_join(rows, side, ["c_custkey"], ["source", "query_hash"]).select("o_orderkey", "status", F.array_join("differs", ";").alias("differs"))


@query("""with o as (select distinct case when o_custkey % 10 = 0 then -1 - o_custkey else o_custkey end as c_custkey from orders) select c_custkey, 'left' as side from customer where c_custkey not in (select c_custkey from o) union all select c_custkey, 'right' from o where c_custkey not in (select c_custkey from customer)""")
def join_id_difference(t: Tables) -> DataFrame:
    renamed = F.when(F.col("o_custkey") % 10 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))  # some ids are not the same on both sides
    return J.id_difference(t.customer, t.orders.select(renamed.alias("c_custkey")), "c_custkey")


@query("select 'customer' as branch, c_custkey as id, c_name as name, c_mktsegment as segment, null::double as balance from customer union all select 'supplier', s_suppkey, s_name, null, s_acctbal from supplier")
def append_branches(t: Tables) -> DataFrame:
    return J.append_branches({"customer": t.customer.selectExpr("c_custkey as id", "c_name as name", "c_mktsegment as segment"), "supplier": t.supplier.selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance")})


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'own' else p_brand end as source, case when p_partkey % 2 = 0 then p_type else p_name end as origin, case when p_partkey % 10 < 8 then 'train' else 'test' end as split from part""")
def join_enriched(t: Tables) -> DataFrame:
    tasks = t.part.selectExpr("p_partkey", "if(p_partkey % 3 = 0, 'own', ' ') as source")
    provenance = t.part.selectExpr("p_partkey", "p_brand as source_name", "if(p_partkey % 2 = 0, p_type, '') as query_id", "p_name as instruction_id")
    splits = t.part.selectExpr("p_partkey", "if(p_partkey % 10 < 8, 'train', 'test') as split")
    return J.enriched(tasks, "p_partkey", [provenance, splits], {"source": ["source", "source_name"], "origin": ["query_id", "instruction_id"], "split": ["split"]}).select("p_partkey", "source", "origin", "split")


@query("""select p_partkey, lower(p_name) || '-x' as task_id, case p_partkey % 4 when 0 then p_name || ',' || p_brand when 1 then p_name when 2 then p_brand else '' end as names, case p_partkey % 6 when 0 then 'composable_service_discovery' when 1 then 'multi_api_recommendation' when 2 then 'multi_service_discovery' when 3 then 'single_api_recommendation' when 4 then 'single_service_discovery' else 'unknown' end as task_type,
case p_partkey % 5 when 0 then 'main_candidate_pool' when 1 then 'rewrite_candidate_pool' when 2 then 'excluded_pool' when 3 then 'not_applicable' else 'not_applicable' end as pool, case p_partkey % 5 when 4 then 'unknown' when 3 then 'uncertain' when 2 then 'remove' when 1 then 'rewrite_pool' else 'keep_candidate' end as decision,
case p_partkey % 4 when 0 then 2 when 3 then 0 else 1 end::int as services, case p_partkey % 4 when 3 then '' when 2 then '' else p_brand end as first_description from part""")
def text_unified(t: Tables) -> DataFrame:
    listed = F.element_at(F.array(
        F.format_string('[{"name": "%s", "service_description": "%s"}, {"service_name": "%s"}]', "p_name", "p_brand", "p_brand"), F.format_string('{"service_name": "%s", "description": "%s"}', "p_name", "p_brand"), F.format_string('["%s"]', "p_brand"), F.lit(" "),
    ), (F.col("p_partkey") % 4).cast("int") + 1)
    kinds = F.element_at(F.array(*map(F.lit, ("G3_x", "multi_api", "G2", "api", "external", "other"))), (F.col("p_partkey") % 6).cast("int") + 1)
    decisions = F.element_at(F.array(*map(F.lit, ("source_specific_keep_candidate", "rewrite_pool_only", "dryrun_remove", "downgrade_to_uncertain", "?"))), (F.col("p_partkey") % 5).cast("int") + 1)
    fields = {"service_id": ["service_id", "id"], "service_name": ["service_name", "name"], "service_description": ["service_description", "description"]}
    packed = T.repacked(listed, fields)
    return t.part.select(
        "p_partkey", T.task_id(F.concat(F.lit("ToolBench__"), "p_name", F.lit("-X"))).alias("task_id"), F.array_join(T.names_of(listed, ["service_name", "name"]), ",").alias("names"), T.unified_task_type(kinds).alias("task_type"),
        T.release_pool(T.policy_pool(decisions)).alias("pool"), T.policy_pool(decisions).alias("decision"), F.size(packed).alias("services"), F.coalesce(F.get(packed, F.lit(0))["service_description"], F.lit("")).alias("first_description"),
    )


@query("""with b as (select p_brand as id, count(distinct p_partkey) as n, min(p_partkey) as lo from part group by 1), e as (select *, right(id, 1) as d from b)
select id as catalog_id, concat_ws(';', case when d = '1' then 'FORBIDDEN_MARKER' end, case when d = '2' then 'NOT_PRIMARY_PASSING' end, case when d = '3' then 'SHA256_MISMATCH' end, case when d = '4' then 'SCHEMA_INVALID' end, case when d = '5' then 'SIZE_MISMATCH' end) as reasons, case when d in ('1', '2', '3', '4', '5') then 'BLOCKED' else 'SAFE' end as status, n as actual_size from e""")
def source_registry(t: Tables) -> DataFrame:
    digit = F.right("p_brand", F.lit(1))
    records = t.part.select(F.col("p_brand").alias("catalog_id"), F.lit("s").alias("actual_sha256"), F.col("p_partkey").cast("string").alias("candidate_id"), F.when((digit == "4"), " ").otherwise(F.col("p_name")).alias("name"), F.lit("").alias("description"))
    entries = t.part.groupBy(F.col("p_brand").alias("catalog_id")).agg(F.count_distinct("p_partkey").alias("n")).select(
        "catalog_id", F.when(F.right("catalog_id", F.lit(1)) == "1", "/x/Union.jsonl").otherwise("/x/a.jsonl").alias("path"), (F.col("n") + F.when(F.right("catalog_id", F.lit(1)) == "5", 1).otherwise(0)).cast("string").alias("size"),
        F.when(F.right("catalog_id", F.lit(1)) == "3", "t").otherwise("s").alias("sha256"), F.lit("PASS_1").alias("scope_status"), F.when(F.right("catalog_id", F.lit(1)) == "2", "false").otherwise("True").alias("primary"),
    )
    return D.checked_registry(entries, records).select("catalog_id", F.array_join("reasons", ";").alias("reasons"), "status", "actual_size")


@query("select page_id, url as name, k as size from pages, lateral (select unnest(case when page_id % 3 = 0 then [1, 2] when page_id % 3 = 1 then [7] else [] end) as k)")
def source_mined(t: Tables) -> DataFrame:
    one = '{"name": "%s", "size": %d}'
    script = F.when(F.col("page_id") % 3 == 0, F.format_string(f'<script type="application/ld+json">[{one}, {one}]</script>', "url", F.lit(1), "url", F.lit(2))).when(F.col("page_id") % 3 == 1, F.format_string(f'<SCRIPT id="x" type="application/json"> {one} </SCRIPT>', "url", F.lit(7))).otherwise("")
    return D.mine_records(t.pages.select("page_id", F.concat("html", script).alias("html")), "page_id", "html", "name:string,size:int")


# -- source adapters and arrays

_FLAT = [
    "p_brand as candidate_service_name", "p_name as candidate_service_description", "case when p_size % 4 = 0 then concat('/', p_type) else p_type end as candidate_api_name", "p_name as candidate_api_description",
    "case p_size % 3 when 0 then '{}' when 1 then concat('{\"candidate_service_host\": \"h', cast(p_size % 5 as varchar(9)), '.io\", \"candidate_api_method\": \"get\", \"candidate_required_parameters_json\": \"[1]\"}') else 'no json' end as metadata_json",
]
_FLAT_SQL = f"with r as (select {', '.join(_FLAT)}, case when p_size % 3 = 1 then 'h' || (p_size % 5) || '.io' else '' end as host from part), k as (select *, case when host <> '' then '[\"' || host || '\",\"' || lower(candidate_service_name) || '\"]' else lower(candidate_service_name) end as identity from r)"


@query(_FLAT_SQL + """ select identity, min(candidate_service_name) as name, first(candidate_service_description order by length(candidate_service_description) desc, candidate_service_description desc) as description, case when max(host) <> '' then 'RapidAPI' else '' end as provider, max(host) as host,
min(case when host <> '' then 'host_plus_source_name' else 'normalized_source_name' end) as basis from k group by 1""")
def adapted_services(t: Tables) -> DataFrame:
    return E.service_records(t.part.selectExpr(*_FLAT), E.ADAPTERS["flat"]).select("identity", "name", "description", "provider", "host", "basis")


@query(_FLAT_SQL + """ select identity, candidate_api_name as name, first(candidate_api_description order by length(candidate_api_description) desc, candidate_api_description desc) as description, case when candidate_api_name like '/%' then candidate_api_name else '' end as endpoint, case when max(host) <> '' then 'GET' else '' end as method,
case when candidate_api_name like '/%' then '' else candidate_api_name end as operation, case when max(host) <> '' then '{"optional":[],"required":[1]}' else '{"optional":[],"required":[]}' end as parameters from k group by identity, candidate_api_name""")
def adapted_apis(t: Tables) -> DataFrame:
    raw = t.part.selectExpr(*_FLAT)
    known = E.service_records(raw, E.ADAPTERS["flat"]).select("service_id", "identity")
    return E.api_records(raw, E.ADAPTERS["flat"]).join(known, "service_id").select("identity", "name", "description", "endpoint", "method", "operation", "parameters")


@query("""with s as (select lower(p_brand) as identity, p_brand as name from part union all select lower(p_type), p_type from part union all select lower(p_brand) || ' x', p_brand || ' X' from part where p_size % 2 = 0), a as (select lower(p_brand) || case when p_size % 2 = 0 then ' x' else '' end as identity, '/' || p_size as api from part)
select identity, min(name) as name, (select count(distinct api) from a where a.identity = s.identity) as apis from s group by 1""")
def adapted_lists(t: Tables) -> DataFrame:
    raw = t.part.selectExpr(
        """concat('["', p_brand, '", {"tool_name": "', p_type, '"}, null, {"other": 1}]') as candidate_services_json""",
        """concat('[{"service_name": "', p_brand, if(p_size % 2 = 0, ' X', ''), '", "api_name": "/', p_size, '", "method": "post"}]') as candidate_apis_json""",
    )
    apis = E.api_records(raw, E.ADAPTERS["listed"]).groupBy("service_id").agg(F.count("*").alias("apis"))
    return E.service_records(raw, E.ADAPTERS["listed"]).join(apis, "service_id", "left").select("identity", "name", F.coalesce("apis", F.lit(0)).alias("apis"))


@query("select o_orderkey as id, o_orderpriority || ', [\"' || o_orderstatus as name, round(o_totalprice, 2) as price, 2 as n from orders")
def source_elements(t: Tables) -> DataFrame:
    """Orders written as files of one array each, of five thousand keys, and read back from stretches of these."""
    root = f"{shared_dir(t.spark).rstrip('/')}/arrays-{uuid.uuid4().hex}"
    element = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(', ["'), "o_orderstatus").alias("name"), F.round("o_totalprice", 2).alias("price"), F.array(F.lit(1), F.lit(2)).alias("tags")))
    whole = t.orders.groupBy(F.floor(F.col("o_orderkey") / 5000).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(element), ",\n"), F.lit("]")).alias("value"))
    whole.write.partitionBy("part").text(root)
    got = read_json_elements(t.spark, root, "id long, name string, price double, tags array<int>")
    return got.select("id", "name", "price", F.size("tags").alias("n"))


# -- trace files: orders as records, their lines as calls

_LINES = """with l as (select o_orderkey, o_orderstatus <> 'P' as read, o_orderpriority, case when o_orderpriority like '1%' then 'G1' when o_orderpriority like '2%' then 'G2' when o_orderpriority like '3%' then 'G3' else 'unknown' end as g, l_suppkey, l_partkey, l_linestatus = 'O' as args, l_returnflag <> 'R' as outs from orders join lineitem on l_orderkey = o_orderkey),
r as (select o_orderkey as id, any_value(g) as g, any_value(read) as ok, case when any_value(read) then count(*) else 0 end as calls, case when any_value(read) then count(distinct l_suppkey) else 0 end as services, case when any_value(read) then count(distinct l_partkey) else 0 end as apis, any_value(read) and bool_or(args) as arguments, any_value(read) and bool_or(outs) as outputs from l group by 1),
i as (select *, case when ok then 'ok' else 'unsupported_record_schema' end as status, calls >= 2 and services >= 2 and arguments and outputs as eligible from r)"""


def _indexed_orders(t: Tables) -> str:
    """Writes orders as files of one keyed object each, of a thousand keys and one priority, and indexes them by a stream; the folder of the index."""
    root = f"{shared_dir(t.spark).rstrip('/')}/traces-{uuid.uuid4().hex}"
    node = F.struct(F.lit("Tool").alias("role"), F.struct(
        F.concat(F.lit("p"), "l_partkey", F.lit("_for_s"), "l_suppkey").alias("name"),
        F.when(F.col("l_linestatus") == "O", F.to_json(F.struct("l_quantity"))).otherwise("").alias("arguments"),
        F.when(F.col("l_returnflag") != "R", F.array("l_quantity")).otherwise(F.array().cast("array<double>")).alias("response"),
    ).alias("message"))
    lines = t.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("double"))
    by = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(F.collect_list(node).alias("answer_details"))
    asked = F.concat(F.lit('Query "'), "o_orderkey", F.lit("\\é")).alias("query")
    record = F.when(F.col("o_orderstatus") == "P", F.to_json(F.struct(asked))).otherwise(F.to_json(F.struct(asked, F.struct("answer_details").alias("answer"))))
    group = F.when(F.col("o_orderpriority").rlike("^[123]"), F.concat(F.lit("in_G"), F.substring("o_orderpriority", 1, 1))).otherwise("other")
    pairs = by.select(F.floor(F.col("o_orderkey") / 1000).alias("part"), group.alias("grp"), F.concat(F.lit('"'), "o_orderkey", F.lit('": '), record).alias("pair"))
    whole = pairs.groupBy("grp", "part").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("pair"), ",\n"), F.lit("}")).alias("value"))
    whole.repartition("grp", "part").write.partitionBy("grp", "part").text(f"{root}/files")
    I.update_index(t.spark, f"{root}/files", f"{root}/out", f"{root}/mark", "keyed", pattern="*.txt")
    return f"{root}/out"


@query(f"{_LINES} select cast(id as varchar) as id, g as \"group\", calls, services, apis, arguments, outputs, status, eligible from i")
def trace_index(t: Tables) -> DataFrame:
    group = F.when(F.col("group") == "", "unknown").otherwise(F.col("group"))
    return I.current_index(t.spark, _indexed_orders(t)).select(F.col("record_id").alias("id"), group.alias("group"), "calls", "services", "apis", "arguments", "outputs", "status", "eligible")


@query(f"""{_LINES} select * from (select 'total' as counter, 'records' as value, count(*) as n from i union all select 'total', 'multicall', count(*) filter (calls >= 2) from i union all select 'total', 'multiservice', count(*) filter (services >= 2) from i union all select 'total', 'eligible', count(*) filter (eligible) from i
union all select 'status', status, count(*) from i group by status union all select 'layout', 'keyed', count(*) from i union all select 'group', g, count(*) from i group by g)""")
def trace_counters(t: Tables) -> DataFrame:
    return I.counters(t.spark, _indexed_orders(t)).select("counter", "value", F.col("n").cast("long").alias("n"))
