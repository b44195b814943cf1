"""Dependency edges over ordered steps: values that a later step takes over from an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions.text import normalize_ascii
from veridex.operators.graph import connected_components
from veridex.plans.scratch import Scratch

FAILED = ("failed", "error", "timeout")
#: Records that hold a value, from which on it is too common to tell anything.
COMMON = 10


def value_frequency(values: DataFrame) -> DataFrame:
    """In how many traces a normalised argument value occurs."""
    return values.where("role = 'argument'").groupBy("norm").agg(F.count_distinct("trace_id").alias("traces"))


def flatten_scalars(rows: DataFrame, row_id: str, document: str) -> DataFrame:
    """(row_id, path, value) of the top-level scalars of a JSON object column."""
    entries = F.map_entries(F.from_json(document, "map<string,string>"))
    return rows.select(row_id, F.explode(entries).alias("e")).select(row_id, F.concat(F.lit("$."), "e.key").alias("path"), F.col("e.value").alias("value"))


def dependency_edges(steps: DataFrame, values: DataFrame, common: int = COMMON) -> DataFrame:
    """Typed edges between the steps of each trace.

    steps: trace_id, step, status, query; values: trace_id, step, path, value, role
    (output or argument). An output that equals a later argument is, in this
    order: failed_call_or_error_output, query_known_value_reuse,
    echoed_upstream_input, unsupported_edge_type (too common), or result_to_input,
    the only strong one. Equal arguments of two steps are shared_input_only; a step
    that nothing reaches gets sequence_only from the one before.
    """
    v = values.withColumn("norm", normalize_ascii(F.col("value"))).where("norm != ''")
    up, down = v.where("role = 'output'"), v.where("role = 'argument'")
    s = steps.select("trace_id", "step", "status", normalize_ascii(F.col("query")).alias("query"))
    side = lambda df, p: df.select("trace_id", "norm", F.col("step").alias(f"{p}_step"), F.col("path").alias(f"{p}_path"))
    met = side(up, "from").join(side(down, "to"), ["trace_id", "norm"]).where("from_step < to_step")
    met = met.join(s.select("trace_id", F.col("step").alias("from_step"), F.col("status").alias("from_status"), "query"), ["trace_id", "from_step"])
    met = met.join(s.select("trace_id", F.col("step").alias("to_step"), F.col("status").alias("to_status")), ["trace_id", "to_step"])
    echo = down.select("trace_id", "norm", F.col("step").alias("from_step"), F.lit(True).alias("echoed")).distinct()
    met = met.join(echo, ["trace_id", "norm", "from_step"], "left").join(value_frequency(v), "norm", "left")
    kind = (
        F.when(F.col("from_status").isin(*FAILED) | F.col("to_status").isin(*FAILED), "failed_call_or_error_output")
        .when(F.concat(F.lit(" "), "query", F.lit(" ")).contains(F.concat(F.lit(" "), "norm", F.lit(" "))), "query_known_value_reuse")
        .when(F.col("echoed"), "echoed_upstream_input")
        .when(F.col("traces") >= common, "unsupported_edge_type")
        .otherwise("result_to_input")
    )
    key = ["trace_id", "from_step", "to_step", "from_path", "to_path", "norm", "edge_type"]
    edges = met.withColumn("edge_type", kind).select(*key).distinct()
    shared = side(down, "from").join(side(down, "to"), ["trace_id", "norm"]).where("from_step < to_step").withColumn("edge_type", F.lit("shared_input_only")).select(*key).distinct()
    found = edges.unionByName(shared)
    before = F.lag("step").over(Window.partitionBy("trace_id").orderBy("step"))
    lonely = steps.select("trace_id", F.col("step").alias("to_step"), before.alias("from_step")).where("from_step is not null")
    lonely = lonely.join(found.select("trace_id", "to_step").distinct(), ["trace_id", "to_step"], "left_anti")
    sequence = lonely.select("trace_id", "from_step", "to_step", *(F.lit("").alias(c) for c in ("from_path", "to_path", "norm")), F.lit("sequence_only").alias("edge_type"))
    return found.unionByName(sequence).withColumn("strong", F.col("edge_type") == "result_to_input")


def evidence_class(edges: DataFrame) -> DataFrame:
    """Per trace: strong where a strong edge exists, shared where only inputs are shared, else sequence."""
    n = lambda c: F.count_if(c)
    by = edges.groupBy("trace_id").agg(n(F.col("strong")).alias("strong_edges"), n(F.col("edge_type") == "shared_input_only").alias("shared_edges"), F.count("*").alias("edges"))
    return by.withColumn("evidence", F.when(F.col("strong_edges") > 0, "strong").when(F.col("shared_edges") > 0, "shared_input").otherwise("sequence"))


def is_acyclic(edges: DataFrame, graph: str, source: str, target: str) -> DataFrame:
    """(graph, acyclic): graphs whose edges all go up, or all down, have no cycle; the others shrink until only cycles are left.

    A round peels nodes that nothing reaches or that reach nothing, then merges
    nodes with a single predecessor into it (those with coin 1 into one with coin
    0), so that a long chain shrinks by a share in each round. Merging keeps
    cycles; the last of one is an edge from a node to itself. The rounds end when
    nothing can be peeled or merged, without a cap.
    """
    scratch = Scratch(edges.sparkSession, "acyclic")
    all_edges = edges.select(F.col(graph).alias("g"), F.col(source).alias("u"), F.col(target).alias("v"))
    way = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    graphs = scratch.keep(all_edges.groupBy("g").agg((way(F.col("u") < F.col("v")) | way(F.col("u") > F.col("v"))).alias("one_way")))
    unclear = graphs.where(~F.col("one_way")).select("g")
    now = scratch.keep(all_edges.join(unclear, "g", "left_semi").where("u is not null and v is not null").distinct())
    count, turn = now.count(), 0
    while count:
        peeled = now.join(now.select("g", F.col("v").alias("u")).distinct(), ["g", "u"], "left_semi")
        peeled = peeled.join(now.select("g", F.col("u").alias("v")).distinct(), ["g", "v"], "left_semi").select("g", "u", "v")
        peeled = scratch.keep(peeled)
        single = scratch.keep(peeled.groupBy("g", "v").agg(F.count("*").alias("n"), F.min("u").alias("p")).where("n = 1 and p != v").select("g", "v", "p"))
        coin = lambda c: F.xxhash64(F.lit(turn), F.col(c)).bitwiseAND(F.lit(1))  # noqa: E731, B023
        merged = single.where((coin("v") == 1) & (coin("p") == 0))
        kept = peeled.join(merged.select("g", "v"), ["g", "v"], "left_anti")
        moved = kept.join(merged.select("g", F.col("v").alias("u"), "p"), ["g", "u"], "left").select("g", F.coalesce("p", "u").alias("u"), "v")
        after = scratch.keep(moved.distinct())
        left = after.count()
        done = left == count and single.isEmpty()
        scratch.drop(now, peeled, single)
        now, count, turn = after, left, turn + 1
        if done:
            break
    cyclic = now.select("g", F.lit(False).alias("x")).distinct()
    return graphs.join(cyclic, "g", "left").select(F.col("g").alias(graph), F.coalesce("x", F.lit(True)).alias("acyclic"))


def component_count(edges: DataFrame, nodes: DataFrame, graph: str, source: str, target: str, node: str) -> DataFrame:
    """The number of undirected components of each graph, single nodes included."""
    name = lambda c: F.concat_ws("\u0001", F.col(graph).cast("string"), F.col(c).cast("string"))
    found = connected_components(edges.select(name(source).alias("u"), name(target).alias("v")))
    all_nodes = nodes.select(graph, name(node).alias("node"))
    return all_nodes.join(found, "node", "left").groupBy(graph).agg(F.count_distinct(F.coalesce("component", "node")).alias("components"))


def necessity(traces: DataFrame) -> DataFrame:
    """Gate reasons of traces: services (array), calls (array), strong_edges, candidates (array)."""
    reasons = F.array_compact(F.array(
        F.when(F.col("strong_edges") == 0, F.lit("no_strong_edge")),
        F.when(F.size(F.array_distinct("services")) < 2, F.lit("single_service")),
        F.when(F.size("calls") != F.size(F.array_distinct("calls")), F.lit("redundant_call")),
        F.when(F.size(F.array_except("services", "candidates")) > 0, F.lit("service_outside_candidates")),
        F.when(F.size(F.array_distinct("candidates")) <= F.size(F.array_distinct("services")), F.lit("no_negative_candidate")),
    ))
    return traces.withColumn("reasons", reasons).withColumn("necessary", F.size("reasons") == 0)


def json_path(document: str, path: str) -> Column:
    return F.get_json_object(document, path)
