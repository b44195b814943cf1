"""Traces of calls: payloads flattened to scalars, execution status, record assessment and the structural gate of composed tasks."""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import normalize_ascii, present

# Fixed values of the scalar filter.
STOP_VALUES = frozenset("true false null none yes no ok success error result response data get post put delete en us".split())
SECRET_TERMS = ("api_key", "apikey", "token", "secret", "credential", "password", "authorization", "access_key")
# Fixed values of the execution status.
ERROR_TEXT = (
    r"invalid\s+api\s*key", r"unauthori[sz]ed", r"authentication\s+failed", r"forbidden", r"permission\s+denied", r"timeout(?:\s+error)?", r"timed\s+out", r"traceback", r"exception",
    r"application\s+error", r"internal\s+server\s+error", r"bad\s+request", r"not\s+found", r"invalid\s+date", r"http\s*(?:4\d\d|5\d\d)",
)
ERROR_KEYS = ("error", "errors", "exception", "traceback", "failure", "failed")
STATUS_KEYS = ("status", "status_code", "http_status", "httpstatus", "code")
FAILED, SUCCESS = ("failed", "error_only"), ("success", "partial_success")
#: Embedded structures longer than this stay text.
LONGEST_EMBEDDED = 2_000_000


def _decoded(value: object) -> object:
    """JSON or a Python literal inside a string, by its brackets; anything else as it is."""
    if not isinstance(value, str):
        return value
    raw = value.strip()
    if not raw or len(raw) > LONGEST_EMBEDDED or raw[0] + raw[-1] not in ("{}", "[]"):
        return value
    for read in (json.loads, ast.literal_eval):
        try:
            return read(raw)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return value


def _scalars(document: object, root: str) -> Iterator[tuple[str, str, str | None, str]]:
    """(path, nearest key, text, kind) of every scalar in order, embedded structures included, however deep."""
    stack = [(document, root, "")]
    while stack:
        value, path, key = stack.pop()
        inner = _decoded(value)
        if inner is not value:
            stack.append((inner, path + ".decoded", key))
        elif isinstance(value, dict):
            stack += [(v, f"{path}.{k}", str(k).casefold()) for k, v in reversed(value.items())]
        elif isinstance(value, (list, tuple)):
            stack += [(v, f"{path}[{k}]", key) for k, v in reversed(list(enumerate(value)))]
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
            yield path, key, None if value is None else str(value), kind


def flatten(rows: DataFrame, row_id: str, document: str, root: str = "$") -> DataFrame:
    """(row_id, path, key, value, kind) of all scalars of a JSON (or Python-literal) column at every depth.

    Strings that hold a structure are opened as well, under .decoded. Null and
    unreadable documents give their text as one scalar, those included that nest
    deeper than the JSON reader goes.
    """
    kind = rows.schema[row_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, *s) for i, d in zip(frame[row_id], frame[document], strict=True) if d is not None for s in _scalars(_decoded(d), root)]
            yield pd.DataFrame(found, columns=[row_id, "path", "key", "value", "kind"])

    return rows.select(row_id, document).mapInPandas(run, f"`{row_id}` {kind}, path string, key string, value string, kind string")


def _folded(value: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", value or "").casefold().split())


def allowed(path: Column, value: Column, kind: Column) -> Column:
    """Scalars that can tell something: no secret paths, booleans, stop values, short strings or bare punctuation."""
    low, norm = F.lower(path), normalize_ascii(value)
    secret = F.lit(False)
    for term in SECRET_TERMS:
        secret = secret | low.contains(term)
    dull = norm.isin(*sorted(STOP_VALUES), "0", "1", "0.0", "1.0", "")
    return ~secret & kind.isin("string", "number") & ~dull & ((kind == "number") | ((F.length(norm) >= 4) & norm.rlike(r"[\p{L}\p{N}]")))


def execution_status(steps: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys and status of each step's payload: unknown, success, partial_success or error_only.

    An error shows in the text, under an error key, or as a status of 400 to 599 or
    failed; a value is useful outside of status, error and message keys if it is
    no stop value, error text or markup.
    """
    rows = steps.withColumn("_step", F.struct(*keys))
    text = F.lower(F.coalesce(payload, F.lit("")))
    whole = rows.select("_step", text.rlike("|".join(ERROR_TEXT)).alias("says_error"), (F.trim(text).isin("", "{}", "[]")).alias("blank"))
    flat = flatten(rows.select(F.to_json("_step").alias("_key"), F.col(payload).alias("payload")), "_key", "payload")
    value = normalize_ascii(F.col("value"))
    wrong = value.rlike("|".join(ERROR_TEXT))
    code = F.try_to_number(F.regexp_extract("value", r"^\s*(\d{1,9})(?:\.\d*)?\s*$", 1), F.lit("999999999"))
    bad_status = F.col("key").isin(*STATUS_KEYS) & (value.isin("failed", "failure", "error", "error_only") | F.coalesce(code.between(400, 599), F.lit(False)))
    named = F.col("key").isin(*ERROR_KEYS) & (value != "")
    in_path = F.col("path").rlike(r"(?i)\.(?:" + "|".join([*ERROR_KEYS, *STATUS_KEYS, "message", "detail"]) + r")(?:\.|\[|$)")
    useful = ~in_path & F.col("kind").isin("string", "number") & (value != "") & ~value.isin(*sorted(STOP_VALUES)) & ~wrong & ~value.contains("<html") & ~value.contains("<!doctype html")
    by = flat.groupBy("_key").agg(F.bool_or(bad_status | named).alias("has_error"), F.bool_or(useful).alias("useful"))
    out = whole.withColumn("_key", F.to_json("_step")).join(by, "_key", "left")
    error, good = F.col("says_error") | F.coalesce("has_error", F.lit(False)), F.coalesce("useful", F.lit(False))
    status = F.when(F.col("blank"), "unknown").when(error & good, "partial_success").when(error, "error_only").when(good, "success").otherwise("unknown")
    return out.select("_step.*", status.alias("status"))


def assess_records(records: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence status and suggested class of each trace.

    records: trace_id, parse_status; steps: trace_id, step, service, api, status;
    edges: trace_id, edge_type, strong. A strong edge between steps of two services
    or APIs is objective evidence; shared inputs or mere sequence make it parallel.
    """
    s = steps.groupBy("trace_id").agg(F.count("*").alias("n_steps"), F.count_distinct(present(F.col("service"))).alias("n_services"), F.count_distinct(present(F.col("api"))).alias("n_apis"), F.count_if(F.col("status").isin(*FAILED)).alias("failed_calls"))
    e = edges.groupBy("trace_id").agg(F.count_if("strong").alias("strong_edges"), F.count_if(F.col("edge_type") == "shared_input_only").alias("shared"), F.count_if(F.col("edge_type") == "sequence_only").alias("sequence"), F.count_if(F.col("edge_type") != "sequence_only").alias("other"))
    df = records.join(s, "trace_id", "left").join(e, "trace_id", "left").na.fill(0, ["n_steps", "n_services", "n_apis", "failed_calls", "strong_edges", "shared", "sequence", "other"])
    spread = (F.col("n_steps") >= 2) & ((F.col("n_services") >= 2) | (F.col("n_apis") >= 2))
    parse = F.coalesce(present(F.col("parse_status")), F.lit("ok"))
    status = (
        F.when(parse.isin("source_unavailable", "join_ambiguous"), parse).when(parse != "ok", "parse_failed").when((F.col("strong_edges") > 0) & spread, "strong_objective_evidence_available")
        .when(F.col("other") > 0, "no_dependency_evidence").when(F.col("n_steps") >= 2, "sequence_only").otherwise("no_dependency_evidence")
    )
    suggested = F.when(status == "strong_objective_evidence_available", "true_composable_candidate").when(spread & ((F.col("shared") > 0) | (F.col("sequence") > 0)), "parallel_multi").otherwise("no_dependency")
    return df.select("trace_id", status.alias("evidence_status"), suggested.alias("suggested_class"), "strong_edges", "failed_calls", (F.col("failed_calls") > 0).alias("execution_evidence_incomplete"))


STEP = "struct<step:int,service:string,api:string,status:string>"
EDGE = "struct<from_step:int,to_step:int,strong:boolean>"


def necessity_gate(tasks: DataFrame) -> DataFrame:
    """task_id, the reasons why a composed task is structurally ineligible (16, in fixed order) and its machine status.

    tasks: task_id, query, steps (array of step, service, api, status), edges (array
    of from_step, to_step, strong), gold_services, gold_apis, candidate_services,
    candidate_apis (arrays), service_leak, api_leak (booleans), components (of the
    graph), is_dag, redundant (array of from_step, to_step pairs that look like
    recomputation), disconnected (array of services and APIs of calls outside the
    chain). A row's arrays are one trace, so all is row-local.
    """
    strong = F.filter("edges", lambda e: F.coalesce(e["strong"], F.lit(False)))
    step_of = lambda k: F.get(F.filter("steps", lambda s: s["step"] == k), F.lit(0))
    side = lambda e, c: present(step_of(e[c])["service"])
    cross = F.filter(strong, lambda e: side(e, "from_step").isNotNull() & side(e, "to_step").isNotNull() & (side(e, "from_step") != side(e, "to_step")))
    same = F.filter(strong, lambda e: side(e, "from_step") == side(e, "to_step"))
    lost = F.filter(strong, lambda e: side(e, "from_step").isNull() | side(e, "to_step").isNull())
    ends = F.array_distinct(F.flatten(F.transform(strong, lambda e: F.array(e["from_step"], e["to_step"]))))
    failed = lambda k: F.coalesce(step_of(k)["status"].isin(*FAILED), F.lit(False))
    good = lambda k: F.coalesce(step_of(k)["status"].isin(*SUCCESS), F.lit(False))
    space = lambda gold, cand: (F.size(F.array_distinct(gold)) > 0) & (F.size(F.array_except(gold, cand)) == 0) & (F.size(F.array_distinct(cand)) > F.size(F.array_distinct(gold)))
    pairs = F.transform(cross, lambda e: F.struct(e["from_step"].alias("from_step"), e["to_step"].alias("to_step")))
    checks = {
        "empty_query": present(F.col("query")).isNull(),
        "empty_dependency_evidence": F.size(strong) == 0,
        "gold_service_count_lt_2": F.size(F.array_distinct("gold_services")) < 2,
        "gold_api_count_lt_2": F.size(F.array_distinct("gold_apis")) < 2,
        "no_cross_service_strong_edge": F.size(cross) == 0,
        "same_service_only_dependency": (F.size(same) > 0) & (F.size(cross) == 0),
        "unresolved_edge_service_mapping": F.size(lost) > 0,
        "failed_or_error_dependency_edge": F.exists(strong, lambda e: failed(e["from_step"]) | failed(e["to_step"])),
        "failed_or_error_gold_call": F.exists(ends, failed),
        "gold_dependency_core_not_fully_successful": F.exists(ends, lambda k: ~good(k)),
        "exact_blocking_service_name_leak": F.col("service_leak"),
        "exact_blocking_api_name_leak": F.col("api_leak"),
        "service_candidate_space_invalid": ~space(F.col("gold_services"), F.col("candidate_services")),
        "api_candidate_space_invalid": ~space(F.col("gold_apis"), F.col("candidate_apis")),
        "dependency_graph_not_dag": ~F.col("is_dag"),
        "only_redundant_recomputation_dependency": (F.size(cross) > 0) & (F.size(F.array_except(pairs, F.col("redundant"))) == 0),
    }
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())))
    words = F.split(F.regexp_replace(normalize_ascii(F.col("query")), "[^a-z0-9]+", " "), " ")
    relevant = F.exists("disconnected", lambda d: F.size(F.array_intersect(F.filter(F.split(F.regexp_replace(F.lower(d), "[^a-z0-9]+", " "), " "), lambda w: ~w.isin(*QUERY_STOPWORDS)), words)) > 0)
    parallel = relevant | (F.col("components") > 1) | (F.lower("query").rlike(r"\b(?:also|additionally|as well as|furthermore|moreover)\b") & (F.size("disconnected") > 0))
    risk = (F.size("redundant") > 0) | parallel | (F.size("disconnected") > 0)
    api_only = (F.size(same) > 0) & (F.size(cross) == 0) & (F.size(F.array_distinct("gold_apis")) >= 2)
    status = (
        F.when(present(F.col("query")).isNull() | (F.size("steps") == 0), "SOURCE_UNAVAILABLE_HOLD").when(api_only, "API_ONLY_WORKFLOW_CANDIDATE").when(F.size(reasons) > 0, "STRUCTURALLY_INELIGIBLE")
        .when(risk, "STRUCTURALLY_ELIGIBLE_WITH_RISK").otherwise("STRUCTURALLY_ELIGIBLE_FOR_REVIEW")
    )
    return tasks.select("task_id", F.array_join(reasons, ";").alias("reasons"), status.alias("machine_status"), F.size(cross).alias("cross_service_edges"), F.size(same).alias("same_service_edges"))


# Words of a query that no call is told by.
QUERY_STOPWORDS = (
    "", "a", "an", "and", "api", "are", "as", "at", "be", "by", "can", "for", "from", "get", "i", "in", "is", "it", "me", "my", "of", "on", "or",
    "please", "provide", "service", "that", "the", "this", "to", "tool", "use", "want", "with", "you",
)


def signals(query: Column, strong: list[str], medium: list[str], weak: list[str]) -> Column:
    """How many phrases of each class a query holds, and the weighted score 5, 3, 1."""
    q = normalize_ascii(query)
    count = lambda words: sum((q.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(w)}(?![\p{{L}}\p{{N}}_])").cast("int") for w in words), F.lit(0))
    s, m, w = count(strong), count(medium), count(weak)
    return F.struct(s.alias("strong"), m.alias("medium"), w.alias("weak"), (5 * s + 3 * m + w).alias("score"))
