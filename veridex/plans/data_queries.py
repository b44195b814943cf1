"""Queries over catalogs, candidates, leakage, duplicates, policies and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import normalize_ascii
from veridex.operators import candidates as C
from veridex.operators import catalog as K
from veridex.operators import dedup as D
from veridex.operators import leakage as L
from veridex.operators import policy as P
from veridex.operators import splits as S
from veridex.operators.gates import gate, gates, schema_violations
from veridex.plans.registry import Tables, query, sql_norm
from veridex.plans.scratch import Scratch
from veridex.streaming.candidates import candidate_stream, current_candidates

# -- catalogs


@query(f"""with r as (select p_brand, p_name, trim(regexp_replace(p_type, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as d, {sql_norm('p_name')} as nn from part)
select p_brand, min(p_name) as p_name, (select d from r x where x.p_brand = r.p_brand order by length(d) desc, d limit 1) as p_type, min(nullif(trim(cast(case when p_name = '' then '' else p_name end as varchar)), '')) as host, count(*) as observed, count(distinct nn) > 1 as name_conflict from r group by p_brand""")
def catalog_upsert(t: Tables) -> DataFrame:
    return K.upsert(t.part.withColumn("host", F.col("p_name")), "p_brand", "p_name", "p_type", "host")


@query("""with l as (select p_name || '/' || p_brand || '/' || p_size as key, count(distinct p_partkey) as n, min(p_partkey) as v from part group by 1)
select p.p_partkey as row_id, case when n = 1 then v end as match_id from part p left join l on l.key = p.p_name || '/' || p.p_brand || '/' || p.p_size""")
def join_unique_match(t: Tables) -> DataFrame:
    key = F.concat_ws("/", "p_name", "p_brand", F.col("p_size").cast("string"))
    rows = t.part.select(F.col("p_partkey").alias("row_id"), key.alias("key"))
    lookup = t.part.select(key.alias("key"), F.col("p_partkey").alias("match_id"))
    return K.unique_match(rows, lookup, "key", "match_id").select("row_id", "match_id")


@query("""with s as (select s_suppkey, s_nationkey, case when s_suppkey % 2 = 0 then cast(s_suppkey as varchar) else 'old' || s_suppkey end as k1, case when s_suppkey % 3 = 0 then null else cast(s_nationkey as varchar) end as k2 from supplier), c as (select c_custkey, cast(c_custkey as varchar) as k1, cast(c_nationkey as varchar) as k2, case when c_acctbal > 5000 then 0 else 1 end as pr from customer),
m as (select s_suppkey, 0 as tier, pr, c_custkey from s join c on s.k1 = c.k1 union all select s_suppkey, 1, pr, c_custkey from s join c on s.k2 = c.k2), r as (select *, rank() over (partition by s_suppkey order by tier, pr) as r from m),
b as (select s_suppkey, min(tier) as tier, count(distinct c_custkey) as n, min(c_custkey) as m from r where r = 1 group by 1)
select s.s_suppkey, tier, case when n = 1 then m end as c_custkey, case when n is null then 'unmatched' when n > 1 then 'ambiguous' else 'matched' end as status from s left join b using (s_suppkey)""")
def join_tiered(t: Tables) -> DataFrame:
    own = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat(F.lit("old"), "s_suppkey"))  # half of the ids are the other source's
    tiers = [(own, F.col("c_custkey").cast("string")), (F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey").cast("string")), F.col("c_nationkey").cast("string"))]
    return K.tiered_match(t.supplier, t.customer, tiers, "s_suppkey", "c_custkey", F.when(F.col("c_acctbal") > 5000, 0).otherwise(1))


@query("""with s as (select 'c' || c_custkey as id, 'A' as source, 'n' || c_nationkey as name, case when c_acctbal > 3000 then c_mktsegment else '' end as host from customer union all select 's' || s_suppkey, 'B', 'N' || s_nationkey, case when s_acctbal > 3000 then 'building' else '' end from supplier)
select 'xw::' || substr(sha256('["' || a.id || '","' || b.id || '"]'), 1, 24) as crosswalk_id, a.source as left_source, a.id as left_service_id, b.source as right_source, b.id as right_service_id, case when a.host <> '' and lower(a.host) = lower(b.host) then 'exact_provider_host_match' else 'ambiguous_no_merge' end as alignment_status
from s a join s b on lower(a.name) = lower(b.name) and a.source < b.source""")
def join_crosswalk(t: Tables) -> DataFrame:
    one = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("service_id"), F.lit("A").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("name"), F.when(F.col("c_acctbal") > 3000, F.col("c_mktsegment")).otherwise("").alias("host"))
    two = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("service_id"), F.lit("B").alias("source"), F.concat(F.lit("N"), "s_nationkey").alias("name"), F.when(F.col("s_acctbal") > 3000, "building").otherwise("").alias("host"))
    return K.name_crosswalk(one.unionByName(two))


@query("""select 'DUPLICATE_API_ID' as code, cast(l_orderkey * 10 + l_linenumber as varchar) as record_id, 'not unique' as detail from lineitem group by l_orderkey * 10 + l_linenumber having count(*) > 1
union all select 'MISSING_PARENT_SERVICE', cast(l_orderkey * 10 + l_linenumber as varchar), cast(l_orderkey as varchar) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')
union all select 'MISSING_SERVICE_FIELD', cast(o_orderkey as varchar), 'name' from orders where o_orderstatus <> 'P' and o_orderpriority = '5-LOW'""")
def catalog_issues(t: Tables) -> DataFrame:
    services = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("service_id"), F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise("x").alias("name"))
    apis = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("api_id"), F.col("l_orderkey").alias("parent_service_id"))
    return K.catalog_issues(services, apis, ["name"])


# -- candidates


def order_tasks(t: Tables) -> DataFrame:
    """An order is a task: its parts are candidates, those returned gold, its priority the query."""
    parts = lambda c: F.array_sort(F.collect_set(c))
    key = F.col("l_partkey").cast("string")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(parts(key).alias("candidates"), parts(F.when(F.col("l_returnflag") == "R", key)).alias("gold"))
    return rows.join(t.orders, "o_orderkey").select(F.col("o_orderkey").alias("task_id"), F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string")).alias("query"), "candidates", "gold")


_TASKS = """with l as (select l_orderkey as task_id, list_sort(list(distinct cast(l_partkey as varchar))) as candidates, coalesce(list_sort(list(distinct cast(l_partkey as varchar)) filter (l_returnflag = 'R')), []) as gold from lineitem group by 1),
tk as (select l.task_id, o_orderpriority || ' ' || o_custkey as query, candidates, gold from l join orders on o_orderkey = task_id)"""


@query(_TASKS + " select task_id, case when len(gold) = 0 then 'empty_gold' when len(candidates) <= len(gold) then 'no_non_gold_candidate' else 'valid' end as status, len(candidates) > greatest(1, len(gold)) as eligible, case when len(gold) = 0 then 'unknown' else 'yes' end as gold_in_candidates from tk")
def candidate_space(t: Tables) -> DataFrame:
    c, g = F.col("candidates"), F.col("gold")
    return order_tasks(t).select("task_id", C.space_status(c, g).alias("status"), C.eligible(F.size(c), F.size(g)).alias("eligible"), C.gold_in_candidates(g, c).alias("gold_in_candidates"))


@query(_TASKS + " select task_id, i as candidate_rank, candidates[i] as candidate, list_contains(gold, candidates[i]) as is_gold, contains(lower(query), candidates[i]) as is_mentioned from tk, lateral (select unnest(generate_series(1, len(candidates))) as i)")
def candidate_rows(t: Tables) -> DataFrame:
    return C.explode_candidates(order_tasks(t)).withColumn("candidate_rank", F.col("candidate_rank").cast("long"))


@query(_TASKS + " select task_id, i as candidate_rank, candidates[i] as candidate, list_contains(gold, candidates[i]) as is_gold, contains(lower(query), candidates[i]) as is_mentioned from tk, lateral (select unnest(generate_series(1, len(candidates))) as i)")
def candidate_streamed(t: Tables) -> DataFrame:
    """The same rows from a stream over files of tasks, two files a batch; every task arrives twice, first without its last candidate."""
    scratch = Scratch(t.spark, "candidate-stream")
    tasks = order_tasks(t).select(F.col("task_id"), "query", "candidates", "gold")
    early = tasks.withColumns({"candidates": F.slice("candidates", F.lit(1), F.size("candidates") - 1), "seq": F.lit(1)})
    files = scratch.keep(early.unionByName(tasks.withColumn("seq", F.lit(2))).orderBy("seq", F.xxhash64("task_id")))
    arriving = t.spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(f"{scratch.root}/{scratch.n}")
    stream = candidate_stream(arriving, f"{scratch.root}/out", f"{scratch.root}/checkpoint", available_now=True)
    stream.awaitTermination()
    return current_candidates(t.spark, f"{scratch.root}/out").withColumn("candidate_rank", F.col("candidate_rank").cast("long"))


@query(_TASKS + " select task_id, array_to_string(candidates, ',') as candidates, array_to_string(gold, ',') as gold from tk")
def candidate_regrouped(t: Tables) -> DataFrame:
    out = C.regroup_candidates(C.explode_candidates(order_tasks(t)))
    return out.select("task_id", F.array_join("candidates", ",").alias("candidates"), F.array_join("gold", ",").alias("gold"))


@query(_TASKS + " select case when len(gold) <= 1 then 'single' when query like '1-%' then 'composable' else 'multi' end as task_type, count(*) as n from tk group by 1")
def candidate_task_types(t: Tables) -> DataFrame:
    kind = C.task_type(F.col("gold"), F.col("query").startswith("1-"))
    return order_tasks(t).groupBy(kind.alias("task_type")).agg(F.count("*").alias("n"))


@query(_TASKS + """, e as (select task_id, unnest(list_filter(candidates, lambda c: not list_contains(gold, c))) as v from tk), r as (select task_id, v, row_number() over (partition by task_id order by sha256('s' || task_id || chr(1) || v), v) as r from e)
select tk.task_id, coalesce(string_agg(v, ',' order by r) filter (r <= 4), '') as negatives from tk left join r using (task_id) group by 1""")
def candidate_negatives(t: Tables) -> DataFrame:
    seed = F.concat(F.lit("s"), F.col("task_id").cast("string"))
    return order_tasks(t).select("task_id", F.array_join(C.deterministic_negatives(F.col("candidates"), F.col("gold"), seed), ",").alias("negatives"))


@query("""with p as (select p_partkey, p_brand, p_type from part), h as (select p_partkey as task_id, p_brand as service, p_type as domain, p_size % 5 as gold_n, [cast(p_partkey as varchar)] as have from part),
n as (select *, greatest(12, gold_n + 1) - 1 as need from h), m as (select task_id, need, cast(p_partkey as varchar) as candidate, case when p_brand = service then 0 else 1 end as o from n join p on p.p_type = n.domain where not list_contains(have, cast(p_partkey as varchar))),
r as (select task_id, need, candidate, row_number() over (partition by task_id order by o, candidate) as r from m) select task_id, candidate, r from r where r <= need""")
def candidate_filled(t: Tables) -> DataFrame:
    tasks = t.part.select(F.col("p_partkey").alias("task_id"), F.col("p_brand").alias("service"), F.col("p_type").alias("domain"), (F.col("p_size") % 5).alias("gold_n"), F.array(F.col("p_partkey").cast("string")).alias("have"))
    pool = t.part.select(F.col("p_partkey").cast("string").alias("candidate"), F.col("p_brand").alias("service"), F.col("p_type").alias("domain"))
    return C.fill_candidates(tasks, pool).withColumn("r", F.col("r").cast("long"))


# -- leakage


@query(r"""with p as (select doc_id, string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}_]') as w from documents), e as (select doc_id, unnest(w) as w, unnest(generate_series(1, len(w))) as k from p),
o as (select doc_id, w, coalesce(sum(length(w) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as start from e)
select doc_id, lower(w) as surface, w as matched, start::int as start_offset, (start + length(w))::int as end_offset, lower(w) = 'review' as generic from o where lower(w) in ('the', 'token', 'review')""")
def leak_surfaces(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.array(F.lit("the"), F.lit("token"), F.lit("review")).alias("surfaces"))
    return L.surface_hits(rows, "doc_id", "text", "surfaces")


@query(r"""with q as (select doc_id, ' ' || array_to_string(list_filter(string_split_regex(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' as q from documents),
w as (select item_id, list_filter(string_split_regex(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^a-z0-9]+'), lambda w: w <> '') as w from benchmark), n as (select item_id * 10 + k as name_id, k, array_to_string(w[:k], ' ') as p from w, range(1, 5) r(k) where len(w) >= k),
f as (select p, count(*) as df from (select distinct p from n where k = 1), q where contains(q, ' ' || p || ' ') group by 1), m as (select name_id, n.p, coalesce(k = 1 and df >= 0.2 * (select count(*) from q), false) or n.p in ('weather', 'search') as common from n left join f on f.p = n.p),
h as (select doc_id, count(*) filter (not common and length(p) >= 3) as telling, count(*) filter (common) as common from q, m where contains(q, ' ' || p || ' ') group by 1)
select doc_id as query_id, case when coalesce(telling, 0) > 0 then 'exact_unique_name_leak' when coalesce(common, 0) > 0 then 'common_word_overlap' else 'no_obvious_leak' end as status, coalesce(telling, 0) as telling, coalesce(common, 0) as common from documents left join h using (doc_id)""")
def leak_phrases(t: Tables) -> DataFrame:
    """Names are the first one to four words of every benchmark item."""
    words = t.benchmark.select("item_id", L.phrase_tokens(F.col("text")).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).where("size(w) >= k")
    names = words.select((F.col("item_id") * 10 + F.col("k")).alias("name_id"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("name"))
    return L.phrase_leaks(t.documents.select(F.col("doc_id").alias("query_id"), "text"), names, common=("weather", "search"), common_share=0.2)


@query("""select source, count(*) filter (contains(lower(text), lang)) as weak, count(*) filter (contains(lower(text), 'token')) as strong, count(*) filter (not contains(lower(text), 'token')) as none from documents group by 1""")
def leak_strengths(t: Tables) -> DataFrame:
    weak, strong = L.leak_strength(F.col("text"), F.col("lang")), L.leak_strength(F.col("text"), F.lit("token"))
    return t.documents.groupBy("source").agg(F.count_if(weak == "weak").alias("weak"), F.count_if(strong == "strong").alias("strong"), F.count_if(strong == "none").alias("none"))


@query(f"select item_id, doc_id from (select item_id, {sql_norm('text')} as i from benchmark) b join (select doc_id, {sql_norm('text')} as d from documents) d on contains(' ' || d || ' ', ' ' || i || ' ')")
def leak_containment(t: Tables) -> DataFrame:
    return L.containment(t.benchmark, t.documents)


# -- duplicates


@query(f"""with r as (select doc_id, {sql_norm('text')} as k, source from documents), x as (select *, row_number() over (partition by md5(k) order by source, doc_id) as r from r) select doc_id from x where r = 1""")
def dedup_winners(t: Tables) -> DataFrame:
    return D.winners(t.documents, [F.md5(normalize_ascii(F.col("text")))], F.col("source"), "doc_id").select("doc_id")


_KEYS = f"""with k as (select doc_id, 'first_line' as key_type, nullif(trim(split_part(text, chr(10), 1)), '') as key from documents union all select doc_id, 'length', source || ':' || n_chars from documents union all select doc_id, 'text_hash', md5({sql_norm('text')}) from documents),
g as (select key_type, key, count(*) as n, min(doc_id) as rep from k where key is not null group by 1, 2 having count(*) > 1), m as (select doc_id, key_type, key, n, rep from k join g using (key_type, key))"""


@query(_KEYS + """, b as (select *, row_number() over (partition by doc_id order by n desc, key_type, key) as r, string_agg(key_type, ';' order by key_type) over (partition by doc_id rows between unbounded preceding and unbounded following) as reason from m)
select d.doc_id, coalesce(b.n, 1) as group_size, coalesce(b.rep = d.doc_id, true) as is_representative, coalesce(b.key_type, '') as key_type, coalesce(reason, '') as reason from documents d left join b on b.doc_id = d.doc_id and r = 1""")
def dedup_key_groups(t: Tables) -> DataFrame:
    return D.key_groups(t.documents, "doc_id", _doc_keys())


def _doc_keys() -> dict:
    return {"text_hash": F.md5(normalize_ascii(F.col("text"))), "length": F.concat_ws(":", "source", F.col("n_chars").cast("string")), "first_line": F.split("text", "\n")[0]}


@query(_KEYS + " select count(distinct key) as duplicate_groups, count(distinct doc_id) as duplicate_rows from m")
def dedup_shared_counts(t: Tables) -> DataFrame:
    return D.shared_key_groups(t.documents, "doc_id", _doc_keys())


@query("""with s as (select case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'dev' else 'test' end as split, md5(text) as text_md5, nullif(trim(source), '') as source from documents),
p as (select split, 'source' as field, source as value from s union all select split, 'text_md5', text_md5 from s) select field, value, string_agg(distinct split, ',' order by split) as splits, count(*) as n from p where value is not null group by 1, 2 having count(distinct split) > 1""")
def split_collisions(t: Tables) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "dev").otherwise("test")
    return D.collisions(t.documents.select(split.alias("split"), F.md5("text").alias("text_md5"), "source"), "split", ["source", "text_md5"])


@query("""with q as (select o_orderkey, o_custkey, o_orderstatus || o_custkey as q from orders), s as (select q, count(distinct o_orderkey) > 1 as linked from q group by 1)
select o_orderkey, case when linked then 'query::' || substr(sha256(q), 1, 24) else 'task::' || o_orderkey end as split_group from q join s using (q)""")
def split_linked_override(t: Tables) -> DataFrame:
    return D.linked_override(t.orders, F.concat("o_orderstatus", F.col("o_custkey").cast("string")), "o_orderkey").select("o_orderkey", "split_group")


@query("""with n as (select case when s_suppkey % 10 = 3 then -s_suppkey else s_suppkey end as s_suppkey, s_name, case when s_suppkey % 7 = 0 then s_nationkey + 1 else s_nationkey end as s_nationkey, s_acctbal + 1 as s_acctbal from supplier)
select o.s_suppkey, 's_nationkey' as field, cast(o.s_nationkey as varchar) as old, cast(n.s_nationkey as varchar) as new from supplier o join n using (s_suppkey) where o.s_nationkey <> n.s_nationkey
union all select s_suppkey, '<row>', 'true', null from supplier where s_suppkey % 10 = 3 union all select -s_suppkey, '<row>', null, 'true' from supplier where s_suppkey % 10 = 3""")
def diff_changed_fields(t: Tables) -> DataFrame:
    new = t.supplier.withColumns({"s_suppkey": F.expr("if(s_suppkey % 10 = 3, -s_suppkey, s_suppkey)"), "s_nationkey": F.when(F.col("s_suppkey") % 7 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")), "s_acctbal": F.col("s_acctbal") + 1})  # an edited copy, some rows under other keys
    return D.changed_fields(t.supplier, new, "s_suppkey", ["s_acctbal"])


# -- policies


def _labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left")


@query("""select doc_id, case when n_chars < 100 then 'remove' when toxic = 1 then 'remove' when quality = 0 then 'uncertain' when quality is not null and toxic is not null then 'keep' else 'uncertain' end as decision, case when n_chars < 100 then 'short' when toxic = 1 then 'toxic' when quality = 0 then 'poor' else '' end as rule from documents left join labels using (doc_id)""")
def policy_fail_closed(t: Tables) -> DataFrame:
    rules = [P.Rule("short", "remove", F.col("n_chars") < 100), P.Rule("toxic", "remove", F.col("toxic") == 1), P.Rule("poor", "uncertain", F.col("quality") == 0)]
    return P.fail_closed(_labelled(t), rules).select("doc_id", "decision", "rule")


@query("""select doc_id, concat_ws(';', case when quality = 0 then 'poor' end, case when n_chars < 100 then 'short' end, case when toxic = 1 then 'toxic' end) as blocking, case when quality is null then 'unlabelled' else '' end as warnings,
case when toxic = 1 then 'toxic' when quality = 0 then 'poor' when n_chars < 100 then 'short' when contains(text, '@') then 'mentions' when quality is null then 'uncertain' else 'keep' end as bucket from documents left join labels using (doc_id)""")
def policy_collect_all(t: Tables) -> DataFrame:
    blocking = [P.Rule("toxic", "block", F.col("toxic") == 1), P.Rule("poor", "block", F.col("quality") == 0), P.Rule("short", "block", F.col("n_chars") < 100)]
    out = P.collect_all(_labelled(t), blocking, [P.Rule("mentions", "leak", F.col("text").contains("@"))], [P.Rule("unlabelled", "warn", F.col("quality").isNull())])
    return out.select("doc_id", "blocking", "warnings", "bucket")


@query("""select doc_id, case when toxic = 1 then 'remove' when n_chars < 100 or quality = 0 then 'downgrade' else 'keep' end as decision, case when n_chars < 100 then 'short' when toxic = 1 then 'toxic' when quality = 0 then 'poor' else '' end as label, concat_ws(';', case when n_chars < 100 then 'short' end, case when toxic = 1 then 'toxic' end, case when quality = 0 then 'poor' end) as reasons from documents left join labels using (doc_id)""")
def policy_hits(t: Tables) -> DataFrame:
    rules = [P.Rule("short", "downgrade", F.col("n_chars") < 100), P.Rule("toxic", "remove", F.col("toxic") == 1), P.Rule("poor", "downgrade", F.col("quality") == 0)]
    return P.hit_policy(_labelled(t), rules, ["remove", "downgrade"]).select("doc_id", "decision", "label", "reasons")


@query(f"""with d as (select doc_id, {sql_norm('text')} as q from documents), s as (select doc_id, q, case when contains(q, 'token') then 'mismatch' when contains(q, 'of the') then 'covered' else 'missing' end as state from d where contains(q, 'the ') union all
select doc_id, q, case when contains(q, '@') then 'mismatch' when contains(q, 'que') then 'covered' else 'missing' end from d where contains(q, ' de ')),
b as (select doc_id, count(*) filter (state = 'mismatch') as mm, count(*) filter (state = 'missing') as mi, count(*) filter (state = 'covered') as co from s group by 1)
select doc_id, case when coalesce(mm, 0) > 0 then 'mismatch' when coalesce(mi, 0) > 0 and coalesce(co, 0) = 0 then 'missing' when coalesce(mi, 0) > 0 then 'uncertain' else 'ok' end as coverage from d left join b using (doc_id)""")
def policy_coverage(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("english", ["the "], ["of the"], ["token"]), ("romance", [" de "], ["que"], ["@"])], "label string, triggers array<string>, positive array<string>, negative array<string>")
    return P.coverage(t.documents, P.keyword_hits(t.documents, "text", rules, "doc_id"), "doc_id")


@query("select doc_id, 'poor;toxic' as flags from labels where quality = 0 and toxic = 1 union all select doc_id, 'poor' from labels where quality = 0 and toxic <> 1 union all select doc_id, 'toxic' from labels where quality <> 0 and toxic = 1")
def policy_dangerous(t: Tables) -> DataFrame:
    rows = t.labels.withColumn("decision", F.lit("keep"))
    return P.dangerous(rows, "decision", {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}).select("doc_id", F.array_join("flags", ";").alias("flags"))


@query("""select user_id, case when max(case when event_type = 'purchase' then value > 20 end) is not null then 'adjudicated' when max(case when event_type = 'click' then value > 20 end) <> max(case when event_type = 'view' then value > 20 end) then 'needs_adjudication' when max(case when event_type = 'click' then value > 20 end) is not null then 'reviewed' when max(case when event_type = 'signup' then value > 20 end) is not null then 'inherited' else 'unreviewed' end as state from events group by 1""")
def policy_reviews(t: Tables) -> DataFrame:
    stage = F.create_map(*(F.lit(x) for kv in (("signup", "inherited"), ("click", "primary"), ("view", "secondary"), ("purchase", "adjudication")) for x in kv))[F.col("event_type")]
    reviews = t.events.select("user_id", stage.alias("stage"), F.when(F.col("value") > 20, "remove").otherwise("keep").alias("decision"))
    return P.resolve_reviews(reviews, "user_id").select("user_id", "state")


# -- identity and splits


_GROUPS = """with recursive k as (select doc_id, 't' || md5(text) as k from documents union all select doc_id, 'l' || source || ':' || n_chars from documents), e as (select distinct a.doc_id as u, b.v from k a join (select k, min(doc_id) as v from k group by 1 having count(*) > 1) b on a.k = b.k where a.doc_id <> b.v),
b as (select u, v from e union select v, u from e), r(node, reach) as (select doc_id, doc_id from documents union select r.node, b.v from r join b on b.u = r.reach), c as (select node as doc_id, min(reach) as grp from r group by 1)"""


def _doc_groups(t: Tables) -> DataFrame:
    return S.identity_groups(t.documents, "doc_id", {"text": F.md5("text"), "length": F.concat_ws(":", "source", F.col("n_chars").cast("string"))})


@query(_GROUPS + ' select doc_id, grp as "group" from c')
def identity_groups(t: Tables) -> DataFrame:
    return _doc_groups(t)


@query(_GROUPS + ", g as (select grp, count(*) as members from c group by 1) select members, count(*) as n from g group by 1")
def identity_group_sizes(t: Tables) -> DataFrame:
    return S.group_hash(_doc_groups(t), "doc_id").groupBy("members").agg(F.count_distinct("group_id").alias("n"))


_SPLIT = """with g as (select o_custkey as grp, min(o_orderpriority) || ':' || floor(log2(count(*)))::int as stratum, count(*) as n from orders group by 1),
r as (select *, row_number() over (partition by stratum order by sha256('20260719:' || grp), grp) as rank from g), u as (select *, (rank * 0.6180339887498949::double) - floor(rank * 0.6180339887498949::double) as u from r),
s as (select grp, stratum, n, case when u < 0.8 then 'train' when u < 0.9 then 'dev' else 'test' end as split from u)"""


def _customer_splits(t: Tables) -> DataFrame:
    groups = t.orders.groupBy(F.col("o_custkey").alias("group")).agg(F.min("o_orderpriority").alias("p"), F.count("*").alias("n"))
    return S.assign_groups(groups.select("group", F.concat_ws(":", "p", F.floor(F.log2(F.col("n"))).cast("string")).alias("stratum"), "n"))


@query(_SPLIT + ' select grp as "group", stratum, n, split from s')
def split_assignment(t: Tables) -> DataFrame:
    return _customer_splits(t)


@query(_SPLIT + ", t as (select split, sum(n)::bigint as n from s group by 1) select split, n, round(n / sum(n) over (), 6) as share, round(n / sum(n) over () - case split when 'train' then 0.8 else 0.1 end, 6) as off_target from t")
def split_audit(t: Tables) -> DataFrame:
    return S.split_audit(t.orders.join(_customer_splits(t).select(F.col("group").alias("o_custkey"), "split"), "o_custkey"), "split")


_MOVED = "case when o_orderkey % 50 = 0 then 'test' else split end as split"


@query(_SPLIT + f""", o as (select o_orderkey, o_custkey, o_orderstatus, {_MOVED} from orders join s on grp = o_custkey), a as (select split, count(*) as n from o group by 1), x as (select max(abs(n / (select count(*) from o) - case split when 'train' then 0.8 else 0.1 end)) as x, count(*) as k from a),
gb as (select count(*) as bad from (select o_custkey from o group by 1 having count(distinct split) > 1)), l as (select count(*) as bad from (select o_orderstatus from o group by 1 having count(distinct split) < 3))
select 'group_in_one_split' as "constraint", bad = 0 as passed, bad::double as observed from gb union all select 'all_splits_present', k = 3, k::double from x union all select 'shares_near_target', x <= 0.05, round(x, 6) from x
union all select 'label_in_all_splits:o_orderstatus', bad = 0, bad::double from l""")
def split_constraints(t: Tables) -> DataFrame:
    rows = t.orders.join(_customer_splits(t).select(F.col("group").alias("o_custkey"), "split"), "o_custkey")
    moved = rows.selectExpr("o_custkey", "o_orderstatus", _MOVED)  # some rows leave their group
    return S.constraint_rows(moved, "split", "o_custkey", ["o_orderstatus"])


# -- gates


@query("""select 'rows' as name, count(*) > 0 as passed, count(*)::double as observed, '> 0' as expected from orders union all select 'ids_unique', count(*) = count(distinct o_orderkey), (count(*) - count(distinct o_orderkey))::double, '0' from orders
union all select 'mean_price', avg(o_totalprice) > 1e9, round(avg(o_totalprice), 6), '> 1e9' from orders""")
def gate_checks(t: Tables) -> DataFrame:
    o = t.orders
    return gates(
        gate(o, "rows", F.count("*"), F.col("observed") > 0, "> 0"),
        gate(o, "ids_unique", F.count("*") - F.count_distinct("o_orderkey"), F.col("observed") == 0, "0"),
        gate(o, "mean_price", F.avg("o_totalprice"), F.col("observed") > 1e9, "> 1e9"),
    )


@query("""select p_partkey, 'p_brand' as field, 'pattern' as rule from part where not regexp_matches(p_brand, '^Brand#[0-9]$') union all select p_partkey, 'p_type', 'enum' from part where p_type not in ('PROMO', 'SMALL') union all select p_partkey, 'p_name', 'minLength' from part where length(p_name) < 10 union all select p_partkey, 'missing', 'required' from part""")
def schema_checks(t: Tables) -> DataFrame:
    schema = {"required": ["missing", "p_brand"], "properties": {"p_brand": {"pattern": "^Brand#[0-9]$"}, "p_type": {"enum": ["PROMO", "SMALL"]}, "p_name": {"minLength": 10}, "missing": {}}}
    return schema_violations(t.part, "p_partkey", schema)
