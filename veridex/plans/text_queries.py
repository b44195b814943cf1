"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions import text as T
from veridex.plans.registry import Tables, query, sql_norm
from veridex.sources.readers import field_inventory

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"
_SLUG = "substr(regexp_replace(regexp_replace(" + sql_norm("p_name || ' ' || p_brand") + ", '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"


@query(f"select doc_id, md5({sql_norm('text')}) as norm_md5, length({sql_norm('text')}) as norm_chars from documents")
def text_normalized(t: Tables) -> DataFrame:
    norm = T.normalize_ascii(F.col("text"))
    return t.documents.select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).cast("long").alias("norm_chars"))


@query()
def text_normalized_exact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("folded_md5"), F.md5(T.normalize_text(F.col("text"), casefold=False)).alias("nfkc_md5"))


@query(f"select doc_id, len(tk) as n_tokens, len(list_distinct(tk)) as n_distinct, md5(array_to_string(tk, '|')) as tokens_md5 from (select doc_id, regexp_extract_all({sql_norm('text')}, '{_TOKEN}') as tk from documents)")
def text_tokens(t: Tables) -> DataFrame:
    tk = t.documents.select("doc_id", T.tokens(F.col("text")).alias("tk"))
    return tk.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), F.size(F.array_distinct("tk")).cast("long").alias("n_distinct"), F.md5(F.array_join("tk", "|")).alias("tokens_md5"))


@query(
    "select item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')), lambda x: x not in "
    f"({', '.join(repr(w) for w in T.STOPWORDS)}))), ' ') as words from benchmark"
)
def text_content_words(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(T.content_tokens(F.col("text")), " ").alias("words"))


@query(f"select p_partkey, 'svc::toolbox::' || case when {_SLUG} = '' or length({_SLUG}) > 64 then substr(sha256('\"' || p_name || ' ' || p_brand || '\"'), 1, 24) else {_SLUG} end as service_id from part")
def text_service_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.service_id(F.lit("ToolBox"), F.concat_ws(" ", "p_name", "p_brand")).alias("service_id"))


@query("select s_suppkey, 'api::svc::x::' || substr(sha256('\"' || s_name || '\"'), 1, 24) as api_id from supplier")
def text_api_ids(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", T.api_id(F.lit("svc::x"), F.col("s_name")).alias("api_id"))


@query(f"select doc_id, sha1({sql_norm('lang')} || chr(10) || {sql_norm('text')}) as signature from documents")
def text_signatures(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.signature(F.col("lang"), F.col("text")).alias("signature"))


@query("""select o_orderkey, substr(sha256('["' || o_orderstatus || '","' || o_orderpriority || '"]'), 1, 24) as h from orders""")
def text_stable_hash(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.stable_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("h"))


@query("""select case when p_size <= 5 then '2-5' when p_size <= 20 then '6-20' when p_size <= 50 then '21-50' when p_size <= 100 then '51-100' else '101+' end as bucket, count(*) as n from part group by 1""")
def text_candidate_buckets(t: Tables) -> DataFrame:
    return t.part.groupBy(T.candidate_bucket(F.col("p_size")).alias("bucket")).agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as sum_k, count(*) filter (cast(json_extract_string(props, '$.k') as bigint) % 2 = 0) as even_k from events group by 1")
def json_path_values(t: Tables) -> DataFrame:
    k = T.to_int(F.get_json_object("props", "$.k"))
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.count_if(k % 2 == 0).alias("even_k"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 0 when o_orderkey % 3 = 1 then 2 else 1 end as n_strings, case when o_orderkey % 3 = 1 then 1 else 0 end as n_alternatives from orders""")
def json_lenient_lists(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).when(F.col("o_orderkey") % 3 == 1, F.to_json(F.array("o_orderstatus", "o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", F.size(T.json_strings(F.col("raw"))).alias("n_strings"), F.size(T.json_string_lists(F.col("raw"))).alias("n_alternatives"))


@query("""select o_orderpriority, cast(substr(o_orderpriority, 1, 1) as bigint) as rank, 0 as text_number, substr(o_orderpriority, 1, 1) = '1' as truthy, count(*) as n from orders group by 1""")
def text_coercions(t: Tables) -> DataFrame:
    head = F.substring("o_orderpriority", 1, 1)
    rows = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return rows.select("o_orderpriority", T.to_int(head).alias("rank"), T.to_int(F.col("o_orderpriority")).cast("int").alias("text_number"), T.truthy(head).alias("truthy"), "n")


@query(r"select page_id, regexp_matches(url, '^[a-z]+[A-Z]|[a-z0-9]_[a-z0-9]|/') as endpoint_like from pages")
def text_endpoint_like(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.is_endpoint_like(F.col("url")).alias("endpoint_like"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(bearer\s+)[A-Za-z0-9._-]+', '\1[REDACTED]', 'g'), '(?i)((?:api[_-]?key|token|secret|password)["'']?\s*[:=]\s*["'']?)[^"''\s,;]+', '\1[REDACTED]', 'g'), '(/home/|/Users/)[^/\s]+', '\1[USER]', 'g')) as redacted_md5 from documents""")
def text_redacted(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


@query("select event_id, true as full_ok, true as date_ok, false as text_ok from events")
def text_iso_timestamps(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select("event_id", T.is_iso_timestamp(F.concat(stamp, F.lit("Z"))).alias("full_ok"), T.is_iso_timestamp(F.substring(stamp, 1, 10)).alias("date_ok"), T.is_iso_timestamp(F.col("event_type")).alias("text_ok"))


@query(
    f"""with g as (select item_id, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(generate_series(1, length(p) - n + 1), lambda i: substr(p, i, n))))) as gram
    from (select item_id, '  ' || {sql_norm("text")} || '  ' as p from benchmark)),
    b as (select item_id, ('0x' || substr(sha256(gram), 14, 3))::int & 2047 as bucket, count(*) as c from g group by 1, 2)
    select item_id, count(*) as buckets, sum(c)::bigint as grams, sum(c * c)::bigint as squared_norm, sum(bucket * c)::bigint as weighted from b group by 1"""
)
def text_hashed_ngrams(t: Tables) -> DataFrame:
    g = t.benchmark.select("item_id", F.explode(T.char_ngrams(F.col("text"))).alias("gram"))
    b = g.groupBy("item_id", T.gram_bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("c"))
    return b.groupBy("item_id").agg(F.count("*").alias("buckets"), F.sum("c").alias("grams"), F.sum(F.col("c") * F.col("c")).alias("squared_norm"), F.sum(F.col("bucket") * F.col("c")).alias("weighted"))


@query("select event_type, count(*) as n, case when count(*) = 0 then 'n/a' else printf('%.2f%%', 100.0 * count(*) filter (value > 10) / count(*)) end as share from events group by 1")
def text_percent(t: Tables) -> DataFrame:
    by = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("k"))
    return by.select("event_type", "n", T.percent(F.col("k"), F.col("n")).alias("share"))


@query("select * from (values ('event_id', 'json'), ('event_type', 'string'), ('props', 'json'), ('value', 'json')) v(field, kind)")
def field_kinds(t: Tables) -> DataFrame:
    return field_inventory(t.events, ["event_id", "event_type", "props", "value"], order="event_id")


@query("select doc_id, md5(trim(lang || ' ' || source || ' ' || trim(text))) as document_md5 from documents")
def text_documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.document_text(F.col("lang"), F.col("source"), F.col("text"))).alias("document_md5"))
