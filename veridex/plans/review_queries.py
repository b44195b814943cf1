"""Queries over reviews, freezing, answers and coverage samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.operators import reviews as V
from veridex.plans.registry import Tables, query


def order_reviews(t: Tables) -> DataFrame:
    """Orders as completed reviews: the status decides, the priority is the severity."""
    o = t.orders
    decision = F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "remove").otherwise("uncertain")
    severity = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "huge").otherwise("none")
    fixed = {f: F.lit(a[0]) for f, a in V.ALLOWED.items()} | {"final_decision": decision, "severity": severity, "error_type": F.when(F.col("o_custkey") % 2 == 0, "x").otherwise(" "), "reviewed_at": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return o.select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("composable"), *(c.alias(k) for k, c in fixed.items()))


@query("""select o_orderkey, concat_ws(';', case when o_orderpriority like '2%' then 'severity' end, case when o_orderstatus = 'O' and o_custkey % 2 <> 0 then 'error_type' end, case when o_orderstatus not in ('F', 'O') then 'notes' end,
case when o_orderstatus = 'F' and o_orderpriority like '1%' then 'severity:keep' end, case when o_orderkey % 2 <> 0 then 'dependency_check:ordinary' end) as errors from orders""")
def review_contract(t: Tables) -> DataFrame:
    return V.review_errors(order_reviews(t)).select("o_orderkey", F.array_join("errors", ";").alias("errors"))


@query("""select o_orderkey, 'o_orderstatus' as field, o_orderstatus as "left", 'F' as "right" from orders where o_orderstatus <> 'F'""")
def review_disagreements(t: Tables) -> DataFrame:
    return V.disagreements(t.orders, t.orders.withColumn("o_orderstatus", F.lit("F")), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("select count(*) as n, sum(o_orderkey)::bigint as ids from orders where o_orderstatus <> 'O'")
def review_freeze(t: Tables) -> DataFrame:
    decisions = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "remove").otherwise("keep").alias("final_decision"))
    return V.freeze(t.orders, decisions, "o_orderkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query("select p_partkey, case when p_size % 3 = 0 then 'allowed' when p_size % 3 = 1 then null else 'restricted' end as status from part")
def review_source_status(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, "Source-Terms: allowed; source-terms: ALLOWED").when(F.col("p_size") % 3 == 1, "source-terms: allowed source-terms: unknown").otherwise("x source-terms:restricted.")
    return t.part.select("p_partkey", V.source_status(text).alias("status"))


@query("""select l_orderkey, l_linenumber, count(*) as n, sum(case when l_quantity = 7 then 1 else 0 end)::bigint as sevens from lineitem group by 1, 2""")
def scalar_forms(t: Tables) -> DataFrame:
    form = V.normalize_scalar(F.col("l_quantity").cast("string"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(F.when(form == "7", 1).otherwise(0)).alias("sevens"))


@query("""select case o_orderkey % 7 when 0 then 'OK' when 1 then 'EMPTY' when 2 then 'FENCED_PART' when 3 then 'NOT_JSON' when 4 then 'NOT_OBJECT' when 5 then 'REFUSAL' else 'TOO_LONG' end as code, count(*) as n from orders group by 1""")
def answer_codes(t: Tables) -> DataFrame:
    answers = ['```json\n{"a": 1}\n```', "  ", 'see ```{"a":1}```', '{"a": ', "[1, 2]", "I'm sorry, no", "x" * 5000]
    answer = F.element_at(F.array(*map(F.lit, answers)), (F.col("o_orderkey") % 7).cast("int") + 1)
    return t.orders.groupBy(V.answer_code(answer).alias("code")).agg(F.count("*").alias("n"))


@query("""with f as (select p_partkey, p_size > 48 and row_number() over (partition by p_size > 48 order by p_partkey) = 1 as a, p_type = 'SMALL' and row_number() over (partition by p_type = 'SMALL' order by p_partkey) = 1 as b from part)
select p_partkey from f order by case when a or b then 0 else 1 end, p_partkey limit 20""")
def sample_coverage(t: Tables) -> DataFrame:
    return V.coverage_sample(t.part, {"large": F.col("p_size") > 48, "small": F.col("p_type") == "SMALL"}, "p_partkey", 20).select("p_partkey")


@query("select p_partkey, round(p_size * 2.0 + p_retailprice * 0.5, 9) as score from part order by score desc, p_partkey limit 30")
def sample_best(t: Tables) -> DataFrame:
    return V.quality_order(t.part, {"p_size": 2.0, "p_retailprice": 0.5}, "p_partkey", 30).select("p_partkey", "score")
