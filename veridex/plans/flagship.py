"""The flagship plan: retrieve, rank and score, from raw texts to a report by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.operators import leakage, metrics, rankers
from veridex.plans.rank_queries import _TOKEN
from veridex.plans.registry import Tables, query, sql_norm

TOP = 50

_SQL = rf"""with d as (select doc_id, lang, regexp_extract_all({sql_norm("text")}, '{_TOKEN}') as tk from documents), st as (select count(*) as n, avg(len(tk)) as al from d),
tf as (select doc_id, len, term, count(*) as tf from (select doc_id, len(tk) as len, unnest(tk) as term from d) group by 1, 2, 3), df as (select term, count(*) as df from tf group by 1),
q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all({sql_norm("text")}, '{_TOKEN}')) as term from benchmark) group by 1, 2),
s as (select item_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(al, 1)))) as score from tf join q using (term) join df using (term) cross join st group by 1, 2),
r as (select item_id, doc_id, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rk from s), t as (select * from r where rk <= 50),
g as (select item_id, doc_id from (select item_id, {sql_norm("text")} as i from benchmark) b join (select doc_id, {sql_norm("text")} as d from documents) d on contains(' ' || d || ' ', ' ' || i || ' ')),
h as (select g.item_id, count(*) as gold, min(t.rk) as first, count(t.rk) filter (t.rk <= 5) as hits, coalesce(sum(1 / log2(t.rk + 1)) filter (t.rk <= 5), 0) as dcg from g left join t using (item_id, doc_id) group by 1),
l as (select item_id, min(lang) as lang from g join documents using (doc_id) group by 1), x as (select lang, coalesce(1.0 / first, 0) as mrr, hits / gold as recall_at_5, dcg / (select sum(1 / log2(i + 1)) from generate_series(1, least(5, gold)) z(i)) as ndcg_at_5 from h join l using (item_id))
select lang, count(*) as n, round(avg(mrr), 6) as mrr, round(avg(recall_at_5), 6) as recall_at_5, round(avg(ndcg_at_5), 6) as ndcg_at_5 from x group by grouping sets ((lang), ())"""


@query(_SQL)
def flagship_retrieval_report(t: Tables) -> DataFrame:
    """Benchmark items ask, all documents are the corpus, and a document that holds an item's text is its gold answer."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    corpus = t.documents.select(F.col("doc_id").alias("candidate_id"), F.col("text").alias("document"))
    rankings = rankers.as_rankings(rankers.bm25_global(queries, corpus, TOP))
    gold = leakage.containment(t.benchmark, t.documents).join(t.documents.select("doc_id", "lang"), "doc_id")
    gold = gold.groupBy(F.col("item_id").alias("query_id")).agg(F.array(F.collect_set(F.col("doc_id").cast("string"))).alias("alternatives"), F.min("lang").alias("lang"))
    scored = metrics.best_per_metric(rankings.join(gold, "query_id"), metrics.reference_scores, ks=(5,))
    return metrics.mean_by(scored, ["lang"], ["mrr", "recall_at_5", "ndcg_at_5"])
