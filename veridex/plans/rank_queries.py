"""Queries over metrics, statistics and rankers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import STOPWORDS
from veridex.operators import metrics as M
from veridex.operators import rankers as R
from veridex.operators import stats as S
from veridex.plans.registry import Tables, query, sql_norm

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"


def order_rankings(t: Tables) -> DataFrame:
    """Each order's parts by price as ranking; its R parts and its N parts as alternative gold sets."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_partkey", "l_linenumber")))
    flagged = lambda f: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_partkey").cast("string"))))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.transform(items, lambda s: s["l_partkey"].cast("string")).alias("ranking"), F.array(flagged("R"), flagged("N")).alias("alternatives"))
    return rows.where("size(flatten(alternatives)) > 0")


_RANKS = """with items as (select l_orderkey as q, cast(l_partkey as varchar) as c, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber) as rn, l_returnflag as f from lineitem),
u as (select q, c, min(rn) as rn from items group by q, c), r as (select q, c, row_number() over (partition by q order by rn) as rk from u),
alt as (select distinct q, f, c from items where f in ('R', 'N')), size as (select q, f, count(*) as g from alt group by q, f),
h as (select a.q, a.f, r.rk from alt a join r on r.q = a.q and r.c = a.c), n as (select q, count(*) as n from r group by q), ks as (select unnest([1, 3, 5, 10]) as k),
per as (select s.q, s.f, s.g, n.n, 1.0 / min(h.rk) as mrr, count(*) filter (h.rk <= s.g) as top_g from size s join h on h.q = s.q and h.f = s.f join n on n.q = s.q group by all),
atk as (select s.q, s.f, k, s.g, least(k, any_value(n.n)) as top, count(h.rk) filter (h.rk <= k) as hits, coalesce(sum(1 / log2(h.rk + 1)) filter (h.rk <= k), 0) as dcg,
(select sum(1 / log2(i + 1)) from generate_series(1, least(k, s.g)) x(i)) as ideal from size s join h on h.q = s.q and h.f = s.f join n on n.q = s.q cross join ks group by s.q, s.f, k, s.g)"""


@query(_RANKS + """ select per.q as query_id, round(max(mrr), 6) as mrr, max(case when top_g = per.g then 1.0 else 0.0 end) as exact_set_match, round(max(top_g / least(per.g, n)), 6) as multi_label_precision, round(max(top_g / per.g), 6) as multi_label_recall,
round(max(a.hits / a.top), 6) as precision_at_3, round(max(a.hits / a.g), 6) as recall_at_3, round(max(2 * a.hits / (a.top + a.g)), 6) as f1_at_3, max(case when a.hits > 0 then 1.0 else 0.0 end) as hit_at_3, round(max(a.dcg / a.ideal), 6) as ndcg_at_3
from per join atk a on a.q = per.q and a.f = per.f and a.k = 3 group by per.q""")
def metrics_core(t: Tables) -> DataFrame:
    out = M.best_per_metric(order_rankings(t), M.core_scores, ks=(3,))
    names = ["mrr", "exact_set_match", "multi_label_precision", "multi_label_recall", "precision_at_3", "recall_at_3", "f1_at_3", "hit_at_3", "ndcg_at_3"]
    return out.select("query_id", *(F.round(n, 6).alias(n) for n in names))


@query(_RANKS + """ select a.q as query_id, round(max(p.mrr), 6) as mrr, """ + ", ".join(f"round(max(hits / a.g) filter (k = {k}), 6) as recall_at_{k}, max(case when hits = a.g then 1.0 else 0.0 end) filter (k = {k}) as completeness_at_{k}, round(max(dcg / ideal) filter (k = {k}), 6) as ndcg_at_{k}" for k in (1, 5, 10)) + """
from atk a join per p on p.q = a.q and p.f = a.f group by a.q""")
def metrics_reference(t: Tables) -> DataFrame:
    out = M.best_per_metric(order_rankings(t), M.reference_scores, ks=(1, 5, 10))
    return out.select("query_id", F.round("mrr", 6).alias("mrr"), *(F.round(f"{m}_at_{k}", 6).alias(f"{m}_at_{k}") for k in (1, 5, 10) for m in ("recall", "completeness", "ndcg")))


@query("""with items as (select l_orderkey as q, cast(l_partkey as varchar) as c, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber) as rn, l_returnflag as f from lineitem),
gold as (select distinct q, c from items where f in ('R', 'N')), g as (select q, count(*) as g from gold group by q),
h as (select i.q, i.rn, i.c from items i join gold d on d.q = i.q and d.c = i.c)
select g.q as query_id, round(1.0 / min(h.rn), 6) as mrr, min(h.rn)::double as gold_rank, round(count(distinct h.c) filter (h.rn <= 3) / g.g, 6) as recall_at_3,
round(coalesce(sum(1 / log2(h.rn + 1)) filter (h.rn <= 3), 0) / (select sum(1 / log2(i + 1)) from generate_series(1, least(3, g.g)) x(i)), 6) as ndcg_at_3 from g join h on h.q = g.q group by g.q, g.g""")
def metrics_union(t: Tables) -> DataFrame:
    out = M.union_scores(order_rankings(t), ks=(3,))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("mrr", "gold_rank", "recall_at_3", "ndcg_at_3")))


@query("""with i as (select l_orderkey as q, cast(l_partkey as varchar) as c, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber) as rn, l_returnflag as f from lineitem),
p as (select distinct q, c from i where rn <= 2), alt as (select distinct q, f, c from i where f in ('R', 'N')), sp as (select q, count(*) as np from p group by q),
s as (select a.q, a.f, count(*) as g, count(p.c) as hits from alt a left join p on p.q = a.q and p.c = a.c group by a.q, a.f),
x as (select s.q, hits / np as precision, hits / g as recall, 2 * hits / (np + g) as f1, hits / (np + g - hits) as jaccard, (hits = np and hits = g)::int as exact, (np - hits)::double as over, (g - hits)::double as under, np, f,
row_number() over (partition by s.q order by (hits = np and hits = g)::int desc, 2 * hits / (np + g) desc, hits / (np + g - hits) desc, case f when 'R' then 0 else 1 end) as r from s join sp on sp.q = s.q)
select q as query_id, round(case when f1 > 0 then precision else 0 end, 6) as precision, round(case when f1 > 0 then recall else 0 end, 6) as recall, round(f1, 6) as f1, round(jaccard, 6) as jaccard, exact::double as exact_set_match, case when f1 > 0 then over else np end as over_selection, case when f1 > 0 then under else 0 end as under_selection from x where r = 1""")
def metrics_best_set(t: Tables) -> DataFrame:
    rows = order_rankings(t).withColumn("selected", F.slice("ranking", 1, 2))
    out = M.union_scores(rows, ks=(1,), selected="selected")
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "jaccard", "exact_set_match", "over_selection", "under_selection")))


@query("""with i as (select l_orderkey as q, cast(l_partkey as varchar) as c, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber) as rn from lineitem),
g as (select l_orderkey as q, cast(min(l_partkey) as varchar) as gold from lineitem group by 1), p as (select i.q, min(rn) as pos from i join g on g.q = i.q and g.gold = i.c group by 1)
select q as query_id, (pos <= 1)::int::double as hit_at_1, (pos <= 5)::int::double as recall_at_5, (pos <= 10)::int::double as recall_at_10 from p""")
def metrics_expansion(t: Tables) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_partkey", "l_linenumber")))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.transform(items, lambda s: s["l_partkey"].cast("string")).alias("ranking"), F.min("l_partkey").cast("string").alias("gold"))
    return rows.select("query_id", *(v.alias(k) for k, v in M.expansion_scores(F.col("ranking"), F.col("gold")).items()))


@query("""select o_orderpriority, o_orderstatus, count(*) as n, round(avg(o_totalprice), 6) as o_totalprice from orders group by grouping sets ((o_orderpriority), (o_orderstatus), ())""")
def metrics_by_group(t: Tables) -> DataFrame:
    return M.mean_by(t.orders, ["o_orderpriority", "o_orderstatus"], ["o_totalprice"])


@query("""with b as (select o_orderpriority, avg(o_totalprice) as m from orders group by 1) select round((select avg(o_totalprice) from orders), 4) as micro_o_totalprice, round(avg(m), 4) as macro_o_totalprice from b""")
def metrics_macro_micro(t: Tables) -> DataFrame:
    out = M.macro_micro(t.orders, "o_orderpriority", ["o_totalprice"])
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


_KAPPA = """with c as (select quality as a, toxic as b, count(*) as k from labels group by 1, 2), n as (select sum(k)::double as n from c), r as (select a, sum(k) as x from c group by 1), s as (select b, sum(k) as y from c group by 1),
p as (select (select sum(k) from c where a = b) / n as po, (select sum(x * y) from r join s on a = b) / (n * n) as pe, n from n)"""


@query(_KAPPA + " select n::bigint as n, round(po, 6) as raw_agreement, round((po - pe) / (1 - pe), 6) as kappa from p")
def stats_agreement(t: Tables) -> DataFrame:
    return S.agreement(t.labels, "quality", "toxic")


@query("""with b as (select lang, count(*) as n, sum(toxic) as k from documents join labels using (doc_id) group by 1), z as (select 1.959963984540054 as z)
select lang, n, round(greatest(0, (k/n + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) as low, round(least(1, (k/n + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) as high from b, z""")
def stats_wilson(t: Tables) -> DataFrame:
    by = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return by.select("lang", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""select count(*) as n, round(avg((quality = toxic)::int), 6) as agreement, count(*) filter (quality = 1 and toxic <> 1) as dangerous_keeps, count(*) filter (quality <> 1 and toxic = 1) as over_conservative,
round(count(*) filter (quality = 1 and toxic = 1) / count(*) filter (quality = 1), 6) as recall, round(count(*) filter (quality = 1 and toxic = 1) / count(*) filter (toxic = 1), 6) as capture_precision from labels""")
def stats_detector(t: Tables) -> DataFrame:
    return S.detector_report(t.labels, "quality", "toxic")


@query("select o_orderpriority, " + ", ".join(f"count(*) filter (o_orderstatus = '{s}') as {s}" for s in "FOP") + " from orders group by 1")
def stats_crosstab(t: Tables) -> DataFrame:
    return S.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("with c as (select p_brand, p_size, count(*) as k from part group by 1, 2) select p_brand, arg_max(p_size, k * 1000 - p_size) as mode from c group by 1")
def stats_smallest_mode(t: Tables) -> DataFrame:
    return S.smallest_mode(t.part, ["p_brand"], "p_size")


@query("select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as worst from events group by 1")
def stats_nearest_rank(t: Tables) -> DataFrame:
    return S.nearest_rank(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""with c as (select o_orderstatus as s, o_orderpriority as p, count(*) as k from orders group by 1, 2), w as (select p, sum(k) as wk from c group by 1), t as (select s, sum(k) as tn from c group by 1), n as (select sum(wk) as n from w)
select t.s as o_orderstatus, round(sum(abs(coalesce(k, 0) / tn - wk / n)), 6) as l1 from t cross join w cross join n left join c on c.s = t.s and c.p = w.p group by 1""")
def stats_l1_distance(t: Tables) -> DataFrame:
    return S.distribution_distance(t.orders, "o_orderstatus", "o_orderpriority")


@query("""with r as (select l_orderkey as query_id, count(distinct l_partkey) as n, count(distinct l_partkey) filter (l_returnflag = 'R') as m from lineitem group by 1),
f as (select query_id, n, m, unnest(generate_series(1, n - m + 1)) as k from r where m > 0)
select query_id, n, m, round(sum(gamma(n - k + 1) / (gamma(m) * gamma(n - k - m + 2)) / (gamma(n + 1) / (gamma(m + 1) * gamma(n - m + 1))) / k), 6) as random_mrr from f group by 1, 2, 3""")
def stats_random_mrr(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.count_distinct("l_partkey").alias("n"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("m")).where("m > 0")
    return rows.withColumn("random_mrr", F.round(S.random_mrr(F.col("n"), F.col("m")), 6))


@query("""with x as (select toxic, quality, r, (('0x' || substr(sha256('20260806:' || r || ':' || doc_id), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from labels, (select unnest(generate_series(1, 500)) as r)),
w as (select toxic, quality, r, (u > 0.36787944117144233)::int + (u > 0.7357588823428847)::int + (u > 0.9196986029286058)::int + (u > 0.9810118431238462)::int + (u > 0.9963401531726563)::int + (u > 0.9994058151824183)::int as w from x),
m as (select toxic, r, sum(w * quality) / greatest(sum(w), 1)::double as m from w group by 1, 2), o as (select toxic, list(m order by m) as o, count(*) as n from m group by 1), a as (select toxic, avg(quality) as mean from labels group by 1)
select toxic, round(o[13], 9) as low, round(o[487], 9) as high, n as repetitions, round(mean, 9) as mean from o join a using (toxic)""")
def stats_bootstrap(t: Tables) -> DataFrame:
    rows = t.labels.withColumn("_id", F.col("doc_id"))
    out = S.bootstrap_interval(rows, "quality", ["toxic"])
    return out.select("toxic", *(F.round(c, 9).alias(c) for c in ("low", "high", "mean")), "repetitions")


@query()
def stats_bootstrap_values(t: Tables) -> DataFrame:
    return S.bootstrap_by_values(t.lineitem, "l_quantity", ["l_returnflag", "l_linestatus"])


@query("""with base as (select l_orderkey as q, cast(l_partkey as varchar) as c, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber) as rn, l_returnflag as f from lineitem),
u as (select q, c, min(rn) as rn from base group by 1, 2), r as (select q, c, row_number() over (partition by q order by rn) as rk from u), n as (select q, count(*) as n from r group by 1),
alt as (select distinct q, f, c from base where f in ('R', 'N')), g as (select q, f, count(*) as g from alt group by 1, 2), gq as (select q, max(g) as gold_n from g group by 1),
b as (select n.q, n.n, gold_n, case when n.n <= 5 then '2-5' when n.n <= 20 then '6-20' else '21-50' end as bucket, case when n.q % 2 = 0 then 'single_api' else 'multi_api' end as task_type from n join gq on gq.q = n.q),
st as (select task_type, bucket, count(*) as n, max(n) as most from b group by 1, 2), kk as (select b.q, b.task_type, b.bucket, unnest(generate_series(1, least(20, st.most))) as k from b join st using (task_type, bucket)),
f1 as (select kk.task_type, kk.bucket, kk.k, kk.q, max(2.0 * h / (least(kk.k, n.n) + g.g)) as f1 from kk join n on n.q = kk.q join g on g.q = kk.q join lateral (select count(*) as h from alt a join r on r.q = a.q and r.c = a.c where a.q = g.q and a.f = g.f and r.rk <= kk.k) x on true group by 1, 2, 3, 4),
m as (select task_type, bucket, k, round(avg(f1), 12) as f1 from f1 group by 1, 2, 3), best as (select task_type, bucket, k, f1, row_number() over (partition by task_type, bucket order by f1 desc, k) as rr from m),
mc as (select task_type, gold_n, count(*) as c from b group by 1, 2), md as (select task_type, arg_max(gold_n, c * 1000 - gold_n) as usual from mc group by 1)
select st.task_type, st.bucket, st.n, (case when st.task_type like 'single%' then 1 when st.n >= 5 then best.k else usual end)::int as selected_k, case when st.task_type like 'single%' then 1.0 when st.n >= 5 then round(best.f1, 6) end as mean_f1,
case when st.task_type like 'single%' then 'single_task_fixed_1' when st.n >= 5 then 'f1_optimized_topk' else 'task_modal_gold_cardinality' end as rule from st join best using (task_type, bucket) join md using (task_type) where rr = 1""")
def stats_cardinality_policy(t: Tables) -> DataFrame:
    rows = order_rankings(t).withColumn("ranking", F.array_distinct("ranking"))
    return S.fit_cardinality(rows.withColumn("task_type", F.when(F.col("query_id") % 2 == 0, "single_api").otherwise("multi_api")))


@query(_RANKS.replace("[1, 3, 5, 10]", "[5, 10, 20, 50]") + """, b as (select q, k, max(hits / g) as r, max((hits = g)::int) as c from atk group by 1, 2), m as (select k, avg(r) as r, avg(c) as c from b group by 1), l as (select r as r50, c as c50 from m where k = 50)
select coalesce(min(k), 50)::int as selected_k from m, l where r >= 0.95 * r50 and c >= 0.95 * c50""")
def stats_global_k(t: Tables) -> DataFrame:
    scores = M.best_per_metric(order_rankings(t), M.reference_scores, ks=(5, 10, 20, 50))
    return S.select_global_k(scores.agg(*(F.avg(f"{m}_at_{k}").alias(f"{m}_at_{k}") for k in (5, 10, 20, 50) for m in ("recall", "completeness"))))


def conversation_pairs(t: Tables) -> DataFrame:
    """A conversation's first turn asks, its later turns are the candidates."""
    c = t.conversations
    asks = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.min(F.struct("turn", "text")).alias("q"))
    rest = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("candidate_id"), F.col("text").alias("document"))
    return asks.join(rest, "query_id").where("candidate_id > q.turn").select("query_id", F.col("q.text").alias("query"), "candidate_id", "document")


_PAIRS = """with c as (select conv_id, turn, text from conversations), f as (select conv_id, min(turn) as t0 from c group by 1), q as (select c.conv_id, c.text as query, t0 from c join f on f.conv_id = c.conv_id and c.turn = t0),
p as (select q.conv_id as query_id, q.query, c.turn as candidate_id, c.text as document from q join c on c.conv_id = q.conv_id and c.turn > t0)"""


@query(_PAIRS + rf""", d as (select query_id, candidate_id, regexp_extract_all({sql_norm("document")}, '{_TOKEN}') as tk from p), l as (select query_id, candidate_id, len(tk) as len from d),
st as (select query_id, count(*) as n, avg(len) as al from l group by 1), tf as (select query_id, candidate_id, term, count(*) as tf from (select query_id, candidate_id, unnest(tk) as term from d) group by 1, 2, 3),
qt as (select query_id, term, count(*) as times from (select distinct query_id, query from p) z, lateral (select unnest(regexp_extract_all({sql_norm("z.query")}, '{_TOKEN}')) as term) group by 1, 2),
df as (select query_id, term, count(*) as df from tf group by 1, 2),
s as (select tf.query_id, tf.candidate_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(al, 1)))) as score from tf join qt using (query_id, term) join df using (query_id, term) join st using (query_id) join l using (query_id, candidate_id) group by 1, 2),
x as (select l.query_id, l.candidate_id, coalesce(score, 0) as score from l left join s using (query_id, candidate_id))
select query_id, candidate_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, candidate_id) as rank from x""")
def rank_bm25_local(t: Tables) -> DataFrame:
    out = R.bm25_local(conversation_pairs(t))
    return out.select("query_id", "candidate_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(rf"""with d as (select doc_id, regexp_extract_all({sql_norm("text")}, '{_TOKEN}') as tk from documents), st as (select count(*) as n, avg(len(tk)) as al from d),
tf as (select doc_id, len, term, count(*) as tf from (select doc_id, len(tk) as len, unnest(tk) as term from d) group by 1, 2, 3), df as (select term, count(*) as df from tf group by 1),
q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all({sql_norm("text")}, '{_TOKEN}')) as term from benchmark) group by 1, 2),
s as (select item_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(al, 1)))) as score from tf join q using (term) join df using (term) cross join st group by 1, 2),
r as (select item_id as query_id, doc_id as candidate_id, score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from s)
select query_id, candidate_id, round(score, 6) as score, rank from r where rank <= 50""")
def rank_bm25_global(t: Tables) -> DataFrame:
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    documents = t.documents.select(F.col("doc_id").alias("candidate_id"), F.col("text").alias("document"))
    out = R.bm25_global(queries, documents, 50)
    return out.select("query_id", "candidate_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _grams(source: str, ids: str, text: str) -> str:
    return f"select {ids}, ('0x' || substr(sha256(gram), 14, 3))::int & 2047 as bucket, count(*) as c from (select {ids}, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(generate_series(1, length(p) - n + 1), lambda i: substr(p, i, n))))) as gram from (select {ids}, '  ' || {sql_norm(text)} || '  ' as p from {source})) group by all"


@query(_PAIRS + f""", d as ({_grams("p", "query_id, candidate_id", "document")}), qg as ({_grams("(select distinct query_id, query from p)", "query_id", "query")}),
dn as (select query_id, candidate_id, sqrt(sum(c * c)) as dn from d group by 1, 2), qn as (select query_id, sqrt(sum(c * c)) as qn from qg group by 1),
dot as (select d.query_id, d.candidate_id, sum(d.c * qg.c) as dot from d join qg on qg.query_id = d.query_id and qg.bucket = d.bucket group by 1, 2)
select dn.query_id, dn.candidate_id, round(coalesce(dot, 0) / (dn * qn), 6) as score from dn join qn using (query_id) left join dot using (query_id, candidate_id)""")
def rank_ngram_cosine(t: Tables) -> DataFrame:
    return R.ngram_cosine(conversation_pairs(t)).select("query_id", "candidate_id", F.round("score", 6).alias("score"))


def _content(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9]{{2,}}'), lambda w: w not in ({stop})))"


@query(_PAIRS + f", s as (select query_id, candidate_id, len(list_intersect({_content('query')}, {_content('document')}))::double as score from p) select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from s")
def rank_token_overlap(t: Tables) -> DataFrame:
    return R.token_overlap(conversation_pairs(t)).withColumn("rank", F.col("rank").cast("long"))


@query(_PAIRS + " select query_id, candidate_id, row_number() over (partition by query_id order by sha256('7' || chr(1) || query_id || chr(1) || candidate_id), candidate_id) as rank from p")
def rank_random(t: Tables) -> DataFrame:
    return R.random_order(conversation_pairs(t), 7).withColumn("rank", F.col("rank").cast("long"))


@query("""with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from e group by 1, 2), c as (select label, list(x order by i) as c from m group by 1),
s as (select vec_id as query_id, c.label as candidate_id, list_cosine_similarity(embedding::double[], c.c) as score from embeddings, c),
r as (select query_id, candidate_id, round(score, 5) as score, row_number() over (partition by query_id order by round(score, 9) desc, candidate_id) as rank from s) select query_id, candidate_id, score from r where rank = 1""")
def rank_centroids(t: Tables) -> DataFrame:
    out = R.centroid_ranking(t.embeddings).where("rank = 1")
    return out.select("query_id", "candidate_id", F.round("score", 5).alias("score"))
