"""Queries over samples, dependencies, manifests and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridex.operators import depend as E
from veridex.operators import manifests as M
from veridex.operators import sampling as S
from veridex.plans.registry import Tables, query, sql_norm
from veridex.streaming import sse

# -- samples

_HASH = "sha256('{seed}' || chr(1) || {cols})"


def _h(seed: str, *cols: str) -> str:
    return "sha256(concat_ws(chr(1), " + ", ".join([f"'{seed}'", *cols]) + "))"


@query(f"with r as (select *, row_number() over (partition by o_orderpriority, o_orderstatus order by {_h('r', 'o_orderkey')}, o_orderkey) as r from orders) select o_orderkey from r where r <= 5")
def sample_reservoir(t: Tables) -> DataFrame:
    return S.stratified_reservoir(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 5, "r").select("o_orderkey")


@query(f"with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by {_h('rr', 'p_brand', 'p_partkey')}, p_partkey) as turn from part), o as (select *, row_number() over (order by turn, p_brand) as position from r) select p_partkey, position from o where position <= 60")
def sample_round_robin(t: Tables) -> DataFrame:
    return S.round_robin(t.part, "p_brand", "p_partkey", 60, "rr").select("p_partkey", F.col("position").cast("long").alias("position"))


@query("""with c as (select p_type, count(*) as n from part group by 1), r as (select *, n * 100.0::double / sum(n) over () as raw from c), f as (select *, floor(raw)::bigint as fl from r), o as (select *, 100 - sum(fl) over () as lft, row_number() over (order by round(raw - fl, 12) desc, n desc, p_type) as k from f)
select p_type, n, fl + case when k <= lft then 1 else 0 end as quota from o""")
def sample_quotas(t: Tables) -> DataFrame:
    return S.quotas(t.part.groupBy("p_type").agg(F.count("*").alias("n")), "p_type", 100)


@query(f"""with c as (select p_type, count(*) as n from part group by 1), r as (select *, n * 100.0::double / sum(n) over () as raw from c), f as (select *, floor(raw)::bigint as fl from r), o as (select *, 100 - sum(fl) over () as lft, row_number() over (order by round(raw - fl, 12) desc, n desc, p_type) as k from f),
q as (select p_type, fl + case when k <= lft then 1 else 0 end as quota from o), s as (select p_partkey, p_type, row_number() over (partition by p_type order by {_h('p', 'p_partkey')}, p_partkey) as r from part) select p_partkey from s join q using (p_type) where r <= quota""")
def sample_proportional(t: Tables) -> DataFrame:
    return S.proportional_sample(t.part, "p_type", "p_partkey", 100, "p").select("p_partkey")


@query("""with p as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, count(*) over (partition by o_custkey) as len from orders),
w as (select *, list_transform(generate_series(0, 3), lambda i: round_even(i * (len - 1) / 3::double, 0)::int) as w from p) select o_orderkey from w where len <= 4 or list_contains(w, pos::int)""")
def sample_spread(t: Tables) -> DataFrame:
    return S.spread_sample(t.orders, "o_custkey", "o_orderkey", 4).select("o_orderkey")


@query(f"""with a as (select doc_id, source, n_chars from documents), f as (select *, 'random' as part from a order by {_h('qa', 'doc_id')}, doc_id limit 70), r1 as (select * from a where doc_id not in (select doc_id from f)),
t as (select *, row_number() over (partition by source order by {_h('qa', 'source', 'doc_id')}, doc_id) as turn from r1), s as (select doc_id, 'round_robin' as part from t order by turn, source limit 20),
r2 as (select * from r1 where doc_id not in (select doc_id from s)), k as (select doc_id, 'risk' as part from r2 order by n_chars desc, doc_id limit 10) select doc_id, part from f union all select * from s union all select * from k""")
def sample_qa(t: Tables) -> DataFrame:
    return S.qa_sample(t.documents.select("doc_id", "source", "n_chars"), "doc_id", "source", "n_chars", "qa").select("doc_id", "part")


@query(f"with o as (select p_partkey, row_number() over (partition by p_brand order by {_h('s', 'p_partkey')}, p_partkey) = 1 as first from part) select p_partkey from o order by case when first then 0 else 1 end, {_h('s', 'p_partkey')}, p_partkey limit 40")
def sample_smoke(t: Tables) -> DataFrame:
    return S.smoke_sample(t.part, ["p_brand"], "p_partkey", 40, "s").select("p_partkey")


@query("""with f as (select p_partkey, row_number() over (partition by p_brand order by p_partkey) = 1 as k, p_size = 50 and row_number() over (partition by p_size = 50 order by p_partkey) = 1 as m1, p_type = 'PROMO' and row_number() over (partition by p_type = 'PROMO' order by p_partkey) = 1 as m2 from part)
select p_partkey from f order by case when m1 or m2 then 0 when k then 1 else 2 end, p_partkey limit 40""")
def sample_diverse(t: Tables) -> DataFrame:
    must = {"large": F.col("p_size") == 50, "promo": F.col("p_type") == "PROMO"}
    return S.choose_diverse(t.part, must, "p_brand", "p_partkey", 40).select("p_partkey")


@query("""with d as (select *, row_number() over (partition by p_name order by p_partkey) as r from (select p_partkey, p_name || p_brand as p_name, p_type from part)), u as (select *, row_number() over (partition by p_type order by p_partkey) as q from d where r = 1)
select p_partkey from u order by case when q <= case p_type when 'PROMO' then 5 when 'SMALL' then 10 else 0 end then 0 else 1 end, p_partkey limit 30""")
def sample_balanced(t: Tables) -> DataFrame:
    rows = t.part.withColumn("signature", F.concat("p_name", "p_brand"))
    return S.balanced_sample(rows, "p_type", "signature", "p_partkey", {"PROMO": 5, "SMALL": 10}, 30).select("p_partkey")


@query(f"""with c as (select doc_id, case when n_chars < 200 then 'short' when toxic = 1 then 'toxic' when quality = 0 then 'poor' end as category from documents left join labels using (doc_id)), r as (select *, row_number() over (partition by category order by {_h('c', 'doc_id')}, doc_id) as r from c where category is not null) select doc_id, category from r where r <= 8""")
def sample_categories(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    cats = {"short": F.col("n_chars") < 200, "toxic": F.col("toxic") == 1, "poor": F.col("quality") == 0}
    return S.category_sample(rows, cats, "doc_id", 8, "c").select("doc_id", "category")


@query("""with e as (select l_orderkey as query_id, l_partkey as candidate_id, l_returnflag as method, min(l_linenumber) as rank, max(l_quantity) as score from lineitem group by 1, 2, 3),
p as (select *, row_number() over (partition by query_id, method order by rank, score desc, candidate_id) as place, case method when 'R' then 1 when 'N' then 2 else 3 end as turn from e),
b as (select query_id, candidate_id, min(place * 10 + turn) as t from p group by 1, 2), o as (select *, row_number() over (partition by query_id order by t, candidate_id) as position from b)
select query_id, candidate_id, position, case when count(*) over (partition by query_id) < 3 then 'INSUFFICIENT_MACHINE_CANDIDATES' else 'READY' end as status from o where position <= 3""")
def sample_challenge(t: Tables) -> DataFrame:
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("candidate_id"), F.col("l_returnflag").alias("method")).agg(F.min("l_linenumber").alias("rank"), F.max("l_quantity").alias("score"))
    return S.challenge_candidates(e, 3, ["R", "N", "A"]).withColumn("position", F.col("position").cast("long"))


# -- dependencies


def turn_values(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Conversations as traces: an assistant's words (of four letters and more, as values are) are outputs, a user's are arguments; the system turn is the query."""
    c = t.conversations
    head = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("query"))
    steps = c.join(head, "conv_id").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("step"), F.when(F.col("text").contains("token"), "failed").otherwise("ok").alias("status"), F.coalesce("query", F.lit("")).alias("query"))
    words = F.array_distinct(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: F.length(w) >= 4))
    values = c.where("role <> 'system'").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("step"), F.posexplode(words).alias("pos", "value"), F.when(F.col("role") == "assistant", "output").otherwise("argument").alias("role"))
    return steps, values.select("trace_id", "step", F.concat(F.lit("$["), "pos", F.lit("]")).alias("path"), "value", "role")


_EDGES = f"""with c as (select conv_id as tr, turn as st, role, text from conversations), q as (select tr, coalesce(max(text) filter (role = 'system'), '') as query from c group by 1), s as (select c.tr, st, case when contains(text, 'token') then 'failed' else 'ok' end as status, {sql_norm('query')} as query from c join q on q.tr = c.tr),
w as (select tr, st, role, list_distinct_ordered from (select tr, st, role, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x) >= 4) as list_distinct_ordered from c where role <> 'system')),
v0 as (select tr, st, role, unnest(list_distinct_ordered) as value, generate_subscripts(list_distinct_ordered, 1) as pos from w), v1 as (select tr, st, role, value, min(pos) as pos from v0 group by 1, 2, 3, 4),
v as (select tr, st, case role when 'assistant' then 'output' else 'argument' end as role, {sql_norm('value')} as norm, '$[' || (row_number() over (partition by tr, st order by pos) - 1) || ']' as path from v1),
fq as (select norm, count(distinct tr) as traces from v where role = 'argument' group by 1),
m as (select distinct u.tr, u.st as f, d.st as g, u.path as fp, d.path as gp, u.norm, case when su.status = 'failed' or sd.status = 'failed' then 'failed_call_or_error_output' when contains(' ' || su.query || ' ', ' ' || u.norm || ' ') then 'query_known_value_reuse'
when exists (select 1 from v z where z.tr = u.tr and z.st = u.st and z.role = 'argument' and z.norm = u.norm) then 'echoed_upstream_input' when coalesce(fq.traces, 0) >= 10 then 'unsupported_edge_type' else 'result_to_input' end as edge_type
from v u join v d on u.tr = d.tr and u.norm = d.norm and u.st < d.st and u.role = 'output' and d.role = 'argument' join s su on su.tr = u.tr and su.st = u.st join s sd on sd.tr = d.tr and sd.st = d.st left join fq on fq.norm = u.norm),
sh as (select distinct u.tr, u.st as f, d.st as g, u.path as fp, d.path as gp, u.norm, 'shared_input_only' as edge_type from v u join v d on u.tr = d.tr and u.norm = d.norm and u.st < d.st and u.role = 'argument' and d.role = 'argument'),
fo as (select * from m union all select * from sh), sq as (select tr, lag(st) over (partition by tr order by st) as f, st as g from s), lo as (select sq.tr, sq.f, sq.g, '' as fp, '' as gp, '' as norm, 'sequence_only' as edge_type from sq where f is not null and not exists (select 1 from fo where fo.tr = sq.tr and fo.g = sq.g)),
e as (select * from fo union all select * from lo)"""


@query(_EDGES + " select tr as trace_id, f as from_step, g as to_step, fp as from_path, gp as to_path, norm, edge_type, edge_type = 'result_to_input' as strong from e")
def depend_edges(t: Tables) -> DataFrame:
    return E.dependency_edges(*turn_values(t)).select("trace_id", "from_step", "to_step", "from_path", "to_path", "norm", "edge_type", "strong")


@query(_EDGES + " select tr as trace_id, count(*) filter (edge_type = 'result_to_input') as strong_edges, count(*) filter (edge_type = 'shared_input_only') as shared_edges, count(*) as edges, case when count(*) filter (edge_type = 'result_to_input') > 0 then 'strong' when count(*) filter (edge_type = 'shared_input_only') > 0 then 'shared_input' else 'sequence' end as evidence from e group by 1")
def depend_evidence(t: Tables) -> DataFrame:
    return E.evidence_class(E.dependency_edges(*turn_values(t)))


@query(_EDGES + " select count(distinct tr) as acyclic_graphs from e")
def depend_acyclic(t: Tables) -> DataFrame:
    edges = E.dependency_edges(*turn_values(t))
    return E.is_acyclic(edges, "trace_id", "from_step", "to_step").agg(F.count_if("acyclic").alias("acyclic_graphs"))


@query("select r_regionkey, count(distinct n_nationkey % 2) as components from region join nation on n_regionkey = r_regionkey group by 1")
def depend_components(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 2).alias("side"))
    first = nodes.groupBy("r_regionkey", "side").agg(F.min("node").alias("first"))
    edges = nodes.join(first, ["r_regionkey", "side"]).select("r_regionkey", F.col("first").alias("a"), F.col("node").alias("b"))
    return E.component_count(edges, nodes, "r_regionkey", "a", "b", "node")


@query("""with l as (select distinct l_orderkey, l_linenumber from lineitem), n as (select l_orderkey, count(*) as k from l group by 1) select l_orderkey, not (l_orderkey % 3 = 0) as acyclic from n where k > 1""")
def depend_cycles(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("u")).distinct()
    after = lines.withColumn("v", F.lead("u").over(Window.partitionBy("l_orderkey").orderBy("u"))).where("v is not null")
    back = lines.where("l_orderkey % 3 = 0").groupBy("l_orderkey").agg(F.max("u").alias("u"), F.min("u").alias("v")).where("u > v")  # the last step leads to the first again
    return E.is_acyclic(after.unionByName(back), "l_orderkey", "u", "v")


@query("""with x as (select l_orderkey as trace_id, list(distinct l_suppkey % 5) as sv, count(*) as calls, count(distinct l_partkey) as dc, count(*) filter (l_returnflag = 'R') as strong from lineitem group by 1)
select trace_id, concat_ws(';', case when strong = 0 then 'no_strong_edge' end, case when len(sv) < 2 then 'single_service' end, case when calls <> dc then 'redundant_call' end, case when list_contains(sv, 4) then 'service_outside_candidates' end, case when 4 <= len(sv) then 'no_negative_candidate' end) as reasons,
strong > 0 and len(sv) >= 2 and calls = dc and not list_contains(sv, 4) and 4 > len(sv) as necessary from x""")
def depend_necessity(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("trace_id")).agg(F.collect_list(F.col("l_suppkey") % 5).alias("services"), F.collect_list("l_partkey").alias("calls"), F.count_if(F.col("l_returnflag") == "R").alias("strong_edges"))
    out = E.necessity(rows.withColumn("candidates", F.array(*(F.lit(i).cast("long") for i in range(4)))))
    return out.select("trace_id", F.array_join("reasons", ";").alias("reasons"), "necessary")


@query("select event_id, '$.k' as path, json_extract_string(props, '$.k') as value from events")
def json_scalars(t: Tables) -> DataFrame:
    return E.flatten_scalars(t.events, "event_id", "props")


# -- manifests


def _manifest(t: Tables) -> DataFrame:
    tasks = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("candidates")).withColumn("query", F.concat(F.lit("order "), "task_id"))
    return M.build_manifest(tasks, t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("document")), "native", "m1")


@query("""with k as (select l_orderkey as task_id, list_sort(list(distinct l_partkey)) as c from lineitem group by 1)
select task_id, sha256(concat_ws(chr(10), 'native', task_id, sha256('order ' || task_id), sha256('["' || array_to_string(c, '","') || '"]'), sha256('rank'), sha256('ranking'), 'm1', sha256('greedy'))) as cache_key, len(c) as n_candidates from k""")
def manifest_native(t: Tables) -> DataFrame:
    return _manifest(t).select("task_id", "cache_key", F.size("visible_input.candidates").cast("long").alias("n_candidates"))


@query("with k as (select distinct l_orderkey as k from lineitem) select 'repeated_key' as issue, 2 * count(*) as n from k where k % 5 = 0 union all select 'empty:model', count(*) from k where k % 7 = 0 union all select 'empty:setting', count(*) from k where k % 11 = 0")
def manifest_issue_count(t: Tables) -> DataFrame:
    sound = _manifest(t)
    odd = lambda field, n: sound.where(f"task_id % {n} = 0").withColumns({"cache_key_fields": F.col("cache_key_fields").withField(field, F.lit("")), "cache_key": F.concat("cache_key", F.lit(field))})
    faulty = sound.unionByName(sound.where("task_id % 5 = 0")).unionByName(odd("model", 7)).unionByName(odd("setting", 11))
    return M.manifest_issues(faulty).groupBy("issue").agg(F.count("*").alias("n"))


@query("select role, count(*) as n, sum(ceil(length(text) / 4))::bigint as tokens, greatest(64, 8 * max(turn)) as answer from conversations group by 1")
def manifest_token_estimates(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.sum(M.token_estimate(F.col("text"))).cast("long").alias("tokens"), M.answer_estimate(F.max("turn")).alias("answer"))


@query("""with x as (select lang, n_chars, doc_id from documents) select lang, ceil(max(n_chars) * 110 / 100.0)::bigint as budget, arg_max(doc_id, n_chars * 1e9 - doc_id) as worst_id, quantile_disc(n_chars, 0.95)::double as p95, quantile_disc(n_chars, 0.5)::double as p50 from x group by 1""")
def manifest_token_budgets(t: Tables) -> DataFrame:
    return M.token_budget(t.documents, "lang", "n_chars", "doc_id")


@query("""select case when o_orderkey % 6 = 0 then 'ok' when o_orderkey % 6 = 1 then 'invalid_json' when o_orderkey % 6 = 2 then 'missing_ranking' when o_orderkey % 6 = 3 then 'duplicate_candidate' when o_orderkey % 6 = 4 then 'unknown_candidate' else 'missing_candidate' end as status, count(*) as n from orders group by 1""")
def manifest_ranking_status(t: Tables) -> DataFrame:
    answers = ['{"ranking":["a","b","c"]}', '{"ranking":["a"', '{"order":["a"]}', '{"ranking":["a","a","b"]}', '{"ranking":["a","b","x"]}', '{"ranking":["c","a"]}']
    answer = F.element_at(F.array(*map(F.lit, answers)), (F.col("o_orderkey") % 6).cast("int") + 1)
    fenced = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    status = M.ranking_status(M.unfenced(fenced), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return t.orders.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""select l_orderkey as task_id, array_to_string(list_sort(list(distinct cast(l_partkey as varchar))), ',') as decoded, (select 'C' || lpad(cast(count(distinct l2.l_partkey) - 1 as varchar), 3, '0') from lineitem l2 where l2.l_orderkey = lineitem.l_orderkey) as last_alias from lineitem group by 1""")
def manifest_aliases(t: Tables) -> DataFrame:
    tasks = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("candidates"))
    rows = tasks.withColumn("m", M.alias_map(F.col("candidates")))
    return rows.select("task_id", F.array_join(M.decode(F.map_keys("m"), F.col("m")), ",").alias("decoded"), F.element_at(F.map_keys("m"), -1).alias("last_alias"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'duplicate' when o_orderkey % 3 = 1 then 'out_of_pool' end as fault, case when o_orderkey % 3 = 0 then 2 when o_orderkey % 3 = 1 then 1 end as place from orders")
def manifest_first_fault(t: Tables) -> DataFrame:
    cut = F.when(F.col("o_orderkey") % 3 == 0, '["a","b","a"').when(F.col("o_orderkey") % 3 == 1, '["a","z","a"').otherwise('["a","b"')
    fault = M.first_fault(cut, F.array(F.lit("a"), F.lit("b")))
    return t.orders.select("o_orderkey", fault.alias("f")).select("o_orderkey", F.col("f.fault").alias("fault"), F.col("f.at").alias("place"))


@query("with a as (select c_custkey, c_acctbal as m from customer), b as (select o_custkey as c_custkey, avg(o_totalprice) as m from orders group by 1) select a.c_custkey, round(b.m - a.m, 6) as delta from a join b using (c_custkey)")
def manifest_deltas(t: Tables) -> DataFrame:
    native = t.customer.select("c_custkey", F.col("c_acctbal").alias("m"))
    challenge = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    return M.native_delta(native, challenge, "c_custkey", "m").select("c_custkey", "delta")


# -- event streams


def _sse_lines(t: Tables) -> DataFrame:
    """Every user's events as a response: an event a delta, purchases finish, signups end it."""
    delta = F.concat(F.lit('data: {"delta":"'), "event_type", F.lit('"}'))
    line = F.when(F.col("event_type") == "purchase", F.lit('data: {"delta":"!","finish_reason":"stop"}')).when(F.col("event_type") == "signup", F.lit("data: [DONE]")).otherwise(delta)
    rows = t.events.select(F.col("user_id").cast("string").alias("request_id"), (F.col("event_id") * 3).alias("at"), F.posexplode(F.array(F.lit(": ping"), line, F.lit(""))).alias("k", "line"))
    return rows.select("request_id", (F.col("at") + F.col("k")).alias("seq"), "line")


@query("""select cast(user_id as varchar) as request_id, count(*)::int as frames, md5(coalesce(string_agg(case event_type when 'purchase' then '!' else event_type end, '' order by event_id) filter (event_type <> 'signup'), '')) as text_md5, bool_or(event_type = 'signup') as done, bool_or(event_type = 'purchase') as terminal,
not (bool_or(event_type = 'signup') and bool_or(event_type = 'purchase')) as retryable from events group by 1""")
def sse_answers(t: Tables) -> DataFrame:
    return sse.assemble(sse.parse_frames(_sse_lines(t))).select("request_id", "frames", F.md5("text").alias("text_md5"), "done", "terminal", "retryable")


@query("with r as (select user_id, event_type, value, event_id, row_number() over (partition by user_id order by event_id desc) as r from events) select user_id, event_type, value from r where r = 1")
def stream_latest(t: Tables) -> DataFrame:
    return sse.latest_status(t.events.select("user_id", "event_type", "value", "event_id"), "user_id", "event_id").select("user_id", "event_type", "value")


@query("select event_id, (select count(*) from events b where b.user_id = a.user_id and epoch_us(b.ts) between epoch_us(a.ts) - 3600000000 and epoch_us(a.ts)) as starts from events a")
def stream_starts(t: Tables) -> DataFrame:
    return sse.starts_in_window(t.events, "user_id", "ts", 3600).select("event_id", "starts")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    return sse.count_stream(t.events, "ts", "event_type")
