"""Small cases with known answers."""

import random
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridex.functions import text as T
from veridex.functions.text import STOPWORDS
from veridex.operators import candidates, catalog, dedup, depend, gates, graph, joins, leakage, manifests, metrics, policy, rankers, recovery, reviews, rulesets, sampling, splits, stats, traces
from veridex.sources import readers, writers
from veridex.streaming import sse


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_set_and_rank_metrics(spark):
    df = spark.createDataFrame([(["a", "x"], [["a", "b"]]), (["x", "a", "b"], [["a", "b"]]), (["a", "a", "x"], [["a", "b"]])], "ranking array<string>, alternatives array<array<string>>")
    out = metrics.best_per_metric(df, metrics.core_scores, ks=(1, 2, 3)).collect()
    assert (out[0].multi_label_precision, out[0].multi_label_recall, out[0].multi_label_f1) == (0.5, 0.5, 0.5)
    assert (out[1].mrr, out[1].recall_at_1, out[1].recall_at_3) == (0.5, 0.0, 1.0)
    assert out[2].precision_at_2 == 0.5  # repeats in a ranking count once


def test_best_alternative_per_metric_not_union(spark):
    df = spark.createDataFrame([(["a", "c"], [["a"], ["b", "c"]]), (["a"], [[]])], "ranking array<string>, alternatives array<array<string>>")
    out = metrics.best_per_metric(df, metrics.core_scores, ks=(1,)).collect()
    assert len(out) == 1 and out[0].exact_set_match == 1.0
    union = metrics.union_scores(df, ks=(1,)).collect()
    assert union[0].recall_at_1 == pytest.approx(1 / 3) and union[1].mrr == 0.0


def test_kappa_edges(spark):
    same = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert rows(stats.agreement(same, "a", "b")) == [(2, 1.0, 1.0)]
    assert rows(stats.agreement(same.limit(0), "a", "b")) == [(0, 0.0, 0.0)]


def test_wilson_none(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    assert rows(spark.createDataFrame([(0, 0)], "k int, n int").select(low, high)) == [(0.0, 0.0)]


def test_components_chain_cycle_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (1, 2), (None, 3)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert rows(graph.connected_components(spark.createDataFrame([], "u long, v long"))) == []


def test_identity_tokens_stay_in_their_kind(spark):
    df = spark.createDataFrame([(1, "A", "1", "q"), (2, "B", "1", "r"), (3, "C", "9", "q"), (4, "D", "", None)], "id long, source string, local string, query string")
    got = splits.identity_groups(df, "id", {"local": F.concat_ws(":", "source", F.nullif("local", F.lit(""))), "query": F.col("query")})
    assert dict(rows(got)) == {1: 1, 2: 2, 3: 1, 4: 4}


def test_identity_parent_links(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 99)], "id long, parent long")
    assert dict(rows(splits.identity_groups(df, "id", {"none": F.lit(None).cast("string")}, "parent"))) == {1: 1, 2: 1, 3: 3}


def test_split_shares_and_order_independence(spark):
    df = spark.range(1000).select(F.col("id").alias("group"), F.lit("s").alias("stratum"), F.lit(1).alias("n"))
    one, two = (dict((r.group, r.split) for r in splits.assign_groups(x).collect()) for x in (df, df.orderBy(F.desc("group"))))
    assert one == two
    counts = {s: list(one.values()).count(s) for s in ("train", "dev", "test")}
    assert abs(counts["train"] - 800) <= 5 and abs(counts["dev"] - 100) <= 5


def test_candidate_space_order(spark):
    df = spark.createDataFrame([(["a"], []), (["a"], ["b"]), (["a"], ["a"]), (["a", "b"], ["a"])], "c array<string>, g array<string>")
    got = [r[0] for r in df.select(candidates.space_status(F.col("c"), F.col("g"))).collect()]
    assert got == ["empty_gold", "gold_not_subset", "no_non_gold_candidate", "valid"]


def test_unique_and_ambiguous_matches(spark):
    look = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("b", 2)], "k string, v long")
    got = catalog.unique_match(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), look, "k", "v")
    assert rows(got, "k") == [("a", 1), ("b", None), ("c", None)]


def test_description_ties_take_the_first(spark):
    df = spark.createDataFrame([("s", "bb", "n"), ("s", "ab", "N "), ("s", "a", "m")], "id string, d string, name string")
    got = catalog.upsert(df.withColumn("host", F.lit(" ")), "id", "name", "d", "host").collect()[0]
    assert (got.d, got.host, got.name_conflict) == ("ab", None, True)


def test_surface_boundaries_and_offsets(spark):
    df = spark.createDataFrame([(1, "Use  Open\nWeather now", ["open weather", "weather"]), (2, "Openness", ["open"]), (3, "C++ here", ["C++"])], "id long, t string, s array<string>")
    got = {(r.id, r.surface): (r.start_offset, r.end_offset, r.generic) for r in leakage.surface_hits(df, "id", "t", "s").collect()}
    assert got == {(1, "open weather"): (5, 17, False), (1, "weather"): (10, 17, True), (3, "C++"): (0, 3, False)}


def test_dedup_group_prefers_largest(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", "q")], "id long, a string, b string")
    got = {r.id: (r.group_size, r.key_type, r.is_representative, r.reason) for r in dedup.key_groups(df, "id", {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got[2] == (3, "b", True, "a;b") and got[1] == (2, "a", True, "a") and got[4][2] is False


def test_first_match_is_not_strongest(spark):
    rules = [policy.Rule("r1", "rewrite", F.col("x") > 0), policy.Rule("r2", "remove", F.col("x") > 1)]
    got = policy.hit_policy(spark.createDataFrame([(2,), (1,), (0,), (None,)], "x int"), rules, ["remove", "rewrite"]).collect()
    assert [(r.decision, r.label) for r in got] == [("remove", "r1"), ("rewrite", "r1"), ("keep", ""), ("keep", "")]


def test_quotas_sum_to_limit(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "g string, n long")
    assert sum(r.quota for r in sampling.quotas(df, "g", 7).collect()) == 7
    assert [r.quota for r in sampling.quotas(df, "g", 50).orderBy("g").collect()] == [5, 3, 2]


def test_dependency_edges(spark):
    steps = spark.createDataFrame([(1, 1, "ok", "find it"), (1, 2, "ok", "find it"), (1, 3, "ok", "find it")], "trace_id long, step int, status string, query string")
    values = spark.createDataFrame([(1, 1, "o", "X9", "output"), (1, 2, "i", "x9", "argument"), (1, 1, "o2", "find", "output"), (1, 2, "i2", "find", "argument")], "trace_id long, step int, path string, value string, role string")
    got = {(r.from_step, r.to_step, r.edge_type, r.strong) for r in depend.dependency_edges(steps, values).collect()}
    assert got == {(1, 2, "result_to_input", True), (1, 2, "query_known_value_reuse", False), (2, 3, "sequence_only", False)}


def test_shared_coordinates_are_not_strong(spark):
    steps = spark.createDataFrame([(1, 1, "ok", ""), (1, 2, "ok", "")], "trace_id long, step int, status string, query string")
    values = spark.createDataFrame([(1, 1, "lat", "48.1", "argument"), (1, 2, "lat", "48.1", "argument")], "trace_id long, step int, path string, value string, role string")
    assert [r.edge_type for r in depend.dependency_edges(steps, values).collect()] == ["shared_input_only"]


def test_cycles_are_found(spark):
    df = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("h", 1, 2), ("h", 2, 1)], "g string, a int, b int")
    assert dict(rows(depend.is_acyclic(df, "g", "a", "b"))) == {"g": True, "h": False}


def test_cycles_of_long_paths(spark):
    """Paths of more than a thousand edges: in order, with mixed numbers, and closed to a cycle."""
    n = 1201
    mixed = [k * 700 % n for k in range(n)]
    edges = [("up", k, k + 1) for k in range(n)] + [("mixed", a, b) for a, b in zip(mixed, mixed[1:])]
    edges += [("tail", a, b) for a, b in zip(mixed, mixed[1:])] + [("tail", mixed[-1], mixed[-30])] + [("self", 1, 2), ("self", 2, 2)]
    df = spark.createDataFrame(edges, "g string, a int, b int")
    assert dict(rows(depend.is_acyclic(df, "g", "a", "b"))) == {"up": True, "mixed": True, "tail": False, "self": False}


def test_cycles_of_random_graphs(spark):
    rng = random.Random(3)
    edges, want = [], {}
    for g in range(60):
        own = {(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randint(2, 11))}
        left = set(own)
        while gone := {(a, b) for a, b in left if all(a != d for _, d in left)}:
            left -= gone
        want[g] = not left
        edges += [(g, a, b) for a, b in own]
    assert len(set(want.values())) == 2
    assert dict(rows(depend.is_acyclic(spark.createDataFrame(edges, "g long, a int, b int"), "g", "a", "b"))) == want


def test_gates_stop(spark):
    df = spark.range(3)
    checks = gates.gates(gates.gate(df, "some", F.count("*"), F.col("observed") > 0, "> 0"), gates.gate(df, "many", F.count("*"), F.col("observed") > 9, "> 9"))
    with pytest.raises(ValueError, match="many"):
        gates.require(checks)


def test_manifest_flags_forbidden_and_repeated(spark):
    tasks = spark.createDataFrame([(1, "q", ["a"]), (2, "q", ["zz", "a"])], "task_id long, query string, candidates array<string>")
    docs = spark.createDataFrame([("a", "doc")], "candidate_id string, document string")
    m = manifests.build_manifest(tasks, docs, "native", "m")
    assert [c.document for c in m.where("task_id = 2").first().visible_input.candidates] == ["", "doc"]
    assert rows(manifests.manifest_issues(m)) == []
    assert {r.issue for r in manifests.manifest_issues(m.unionByName(m)).collect()} == {"repeated_key"}


LINES = [": hi", "event: x", 'data: {"delta":"a"}', "", 'data: {"delta":', 'data: "b"}', "", 'data: {"finish_reason":"stop"}', "", "data: [DONE]", ""]


def test_sse_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(LINES)] + [("s", 0, 'data: {"delta":"a"}'), ("s", 1, "")], "request_id string, seq long, line string")
    frames = sse.parse_frames(df)
    assert [f.event for f in frames.where("request_id = 'r'").orderBy("frame").collect()][:2] == ["x", "message"]
    batch = {r.request_id: (r.frames, r.text, r.done, r.terminal, r.retryable) for r in sse.assemble(frames).collect()}
    assert batch == {"r": (4, "ab", True, True, False), "s": (1, "a", False, False, True)}
    df.coalesce(1).write.json(str(tmp_path / "in"))
    lines = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    q = sse.assemble_stream(lines).writeStream.outputMode("update").format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    stream = {r.request_id: (r.frames, r.text, r.done, r.terminal, r.retryable) for r in spark.table("answers").collect()}
    assert stream == batch


def test_watermarked_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:20:00', 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = sse.count_stream(src, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").first().n == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "hi"'), ("ü,", "")], "x string, y string")
    writers.write_csv(df, str(tmp_path / "c"), ["y", "x", "gone"])
    back = readers.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["y", "x", "gone"] and {r.x for r in back.collect()} == {"a\nb", "ü,"}
    (tmp_path / "bom.csv").write_bytes("﻿id,n\n1,2\n".encode())
    assert rows(readers.read_any(spark, str(tmp_path / "bom.csv"))) == [("1", "2")]


def test_json_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":1,"v":"old"}\n{"id":1,"v":"new"}\n{"id":2,"v":"x"}\n')
    got = readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), "id")
    assert dict((r.id, r.v) for r in got.collect()) == {1: "new", 2: "x"}
    (tmp_path / "a.json").write_text('[{"id":1},\n {"id":2}]')
    assert readers.read_json_array(spark, str(tmp_path / "a.json")).count() == 2
    inv = readers.inventory(spark, str(tmp_path), "*.json")
    assert inv.first().bytes == (tmp_path / "a.json").stat().st_size
    (tmp_path / "m" / "deep").mkdir(parents=True)
    (tmp_path / "m" / "x.json").write_text('{"id": 7,\n "other": 1}')
    (tmp_path / "m" / "deep" / "y.json").write_text("broken")
    meta = readers.read_metadata(spark, str(tmp_path / "m"), "id int")
    assert sorted((r.file.rsplit("/", 1)[1], r.id) for r in meta.collect()) == [("x.json", 7), ("y.json", None)]
    assert readers.count_elements(spark, str(tmp_path / "a.json")) == 2


def test_zip_members_are_checked(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("ok.txt", "hello")
        z.writestr("../bad.txt", "x")
    got = {r.name: (r.safe, None if r.content is None else bytes(r.content)) for r in readers.read_zip(spark, str(tmp_path / "z.zip")).collect()}
    assert got == {"ok.txt": (True, b"hello"), "../bad.txt": (False, None)}


def test_partition_writer_replaces_only_touched(spark, tmp_path):
    path = str(tmp_path / "p")
    writers.write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, ["k"])
    writers.write_partitioned(spark.createDataFrame([("a", 3)], "k string, v int"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(200).select(F.col("id").alias("_id"), (F.col("id") % 2).alias("v"), F.lit("g").alias("g"))
    r = stats.bootstrap_interval(df, "v", ["g"], repetitions=200).first()
    assert r.low < r.mean < r.high and r.high - r.low < 0.2


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_normalize_text_equals_python(spark, values):
    values = [v for v in values if "\ud800" > v or v == ""] or [""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(T.normalize_text(F.col("v"))).collect()]
    ascii_space = str.maketrans({c: " " for c in "\x1c\x1d\x1e\x1f"})
    want = [" ".join(unicodedata.normalize("NFKC", v).split()).casefold() for v in values]
    assert [g.translate(ascii_space).split() for g in got] == [w.translate(ascii_space).split() for w in want]


def test_every_occurrence_of_a_surface_has_its_offsets(spark):
    df = spark.createDataFrame([(1, "openness open and Open", ["open", "open  and", "C++", ""]), (2, "C++ (c++) xC++", ["c++"])], "id int, t string, s array<string>")
    got = rows(leakage.surface_hits(df, "id", "t", "s").select("id", "surface", "matched", "start_offset", "end_offset"), "id", "surface", "start_offset")
    assert got == [(1, "open", "open", 9, 13), (1, "open", "Open", 18, 22), (1, "open  and", "open and", 9, 17), (2, "c++", "C++", 0, 3), (2, "c++", "c++", 5, 8)]


def test_rewrites_are_verified(spark):
    text, status = leakage.verified_rewrite(F.col("q"), F.col("s"), F.col("a"))
    cases = [
        ("Book flights using the Sky Scan service, please", ["Sky Scan"], [], "Book flights, please", "REWRITE_VALID"), ("Sky Scan finds flights", ["Sky Scan"], [], "Sky Scan finds flights", "REWRITE_NOT_APPLICABLE"),
        ("use GetFare", [], ["GetFare"], "", "REWRITE_UNSAFE_MEANING_LOSS"), ("find cheap fares", ["X"], ["Y"], "find cheap fares", "REWRITE_NOT_APPLICABLE"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "q string, s array<string>, a array<string>")
    assert rows(df.select(text, status)) == [c[3:] for c in cases]


def test_tightening_rules_known_answers(spark):
    base = {"task_type": "single", "semantic": "ok", "wrong_gold_flags": "[]", "domain_flags": "", "representative": "true"}
    cases = [
        ("track my parcel", "container list", {}, "remove", "R6_object_scope_gate"), ("forecast please", "current weather", {}, "downgrade", "R6_object_scope_gate"), ("list users", "users", {}, "keep", ""),
        ("then pay", "users", {"task_type": "Composable"}, "downgrade", "R10_composable_dependency_gate"), ("use it to pay", "users", {"task_type": "Composable"}, "keep", ""), ("list users", "users", {"wrong_gold_flags": "[1]"}, "remove", "R4_wrong_gold_set_gate"),
    ]
    df = spark.createDataFrame([{"query": q, "gold": g, **base, **more} for q, g, more, _, _ in cases])
    assert rows(rulesets.tightening_policy(df).select("decision", "label")) == [c[3:] for c in cases]


def test_scalars_of_embedded_structures(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}], "s": "[True, None]", "t": "{bad}"}'), (2, None), (3, "plain"), (4, "['one', 2]")], "id int, d string")
    got = sorted((r.id, r.path, r.value, r.kind) for r in traces.flatten(df, "id", "d").collect())
    assert got == [
        (1, "$.a[0]", "1", "number"), (1, "$.a[1].b", "x", "string"), (1, "$.s.decoded[0]", "True", "boolean"), (1, "$.s.decoded[1]", None, "null"), (1, "$.t", "{bad}", "string"),
        (3, "$", "plain", "string"), (4, "$[0]", "one", "string"), (4, "$[1]", "2", "number"),
    ]


def test_joins_refuse_what_they_rely_on(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(1, "p")], "id int, w string")
    with pytest.raises(ValueError, match="missing"):
        joins.required_join(a, b, ["id"])
    with pytest.raises(ValueError, match="unique"):
        joins.required_join(a.limit(0), b.unionByName(b), ["id"])
    assert rows(joins.required_join(a.where("id = 1"), b, ["id"])) == [(1, "x", "p")]
    assert rows(joins.id_difference(a, b, "id")) == [(2, "left")]


def test_hard_constraints_name_what_is_broken(spark):
    """A clean assignment passes all that its size allows, and each broken rule is named alone."""
    data = [(i, i, "train" if i % 10 < 8 else "dev" if i % 10 == 8 else "test", f"t{i // 500}", "s", f"t{i // 500}|s", f"c{i}", f"q{i}") for i in range(1000)]
    columns = "row_id int, group int, split string, task string, source string, cell string, content string, query string"
    targets = {"train": 800, "dev": 100, "test": 100}
    original = spark.createDataFrame([(r[0], r[6]) for r in data], "row_id int, content string")
    edges = spark.createDataFrame([(0, 1, "s"), (8, 18, "s")], "u int, v int, source string")
    broken = lambda rows, **k: {r.constraint for r in splits.hard_constraints(spark.createDataFrame(rows, columns), targets, original, ["query"], k.get("edges", edges)).collect() if not r.passed}

    def changed(*places, **new):
        names = [c.split()[0] for c in columns.split(", ")]
        return [tuple(new[k] if k in new and i in places else v for k, v in zip(names, r)) for i, r in enumerate(data)]

    assert not broken(data) and splits.hard_constraints(spark.createDataFrame(data, columns), targets, original, ["query"], edges).count() == 15
    assert broken(changed(2, 9, group=0)) == {"H01_group_unsplit"}
    assert broken(changed(0, 9, query="same")) == {"H03_identity_group_overlap"}
    assert broken(data, edges=spark.createDataFrame([(0, 9, "s")], edges.schema)) == {"H04_relationship_conflicts"}
    assert broken(changed(0, 9, content="c0")) == {"H05_content_duplicate_conflicts", "H12_content_immutable"}
    assert broken(changed(2, split="test")) == {"H06_test_size"} and broken(changed(2, split="dev")) == {"H07_dev_size"}
    assert broken(changed(0, content="edited")) == {"H12_content_immutable"}
    assert broken(changed(2, row_id=5000)) == {"H14_no_row_mutation"} and broken(changed(2, split="lost")) == {"H14_no_row_mutation"} and broken(data[1:] + [data[1]]) >= {"H14_no_row_mutation"}
    assert broken(data, edges=spark.createDataFrame([(0, 1, "other")], edges.schema)) == {"H15_source_local_edges"}
    assert broken(changed(*range(9, 500, 10), task="t1", cell="t1|s")) == {"H02_tasks_in_test", "H08_task_minimum", "H09_source_task_minimum", "H10_named_cell_in_test", "H11_task_dominance"}



def test_rebuilt_candidates_order(spark):
    tasks = spark.createDataFrame([("t", "cheap repair shop", "s1", "d1", ["g"])], "task_id string, query string, service string, domain string, gold array<string>")
    pool = spark.createDataFrame([("a", "s9", "d9", "nothing"), ("b", "s9", "d9", "repair shop"), ("c", "s2", "d1", "x"), ("d", "s1", "d1", "x"), ("e", "s2", "d1", "cheap repair"), ("g", "s1", "d1", "gold")], "candidate string, service string, domain string, document string")
    assert [r.candidate for r in recovery.rebuilt_candidates(tasks, pool, target=6).orderBy("r").collect()] == ["d", "e", "c", "b", "a"]


def test_rebuilt_candidates_equal_a_sort_of_the_pool(spark):
    rng = random.Random(8)
    words = ["cheap", "repair", "shop", "tools", "food", "common"]
    pick = lambda n: " ".join(rng.sample(words, rng.randint(0, n)) + ["common"] * rng.randint(0, 1))
    pool = [(f"c{i:03d}", f"s{rng.randrange(12)}", f"d{rng.randrange(4)}", rng.choice([pick(3), None])) for i in range(400)]
    tasks = [(f"t{i}", pick(4), rng.choice([f"s{rng.randrange(13)}", None]), f"d{rng.randrange(5)}", [f"c{rng.randrange(400):03d}" for _ in range(rng.randint(0, 9))]) for i in range(40)]
    got = recovery.rebuilt_candidates(spark.createDataFrame(tasks, "task_id string, query string, service string, domain string, gold array<string>"), spark.createDataFrame(pool, "candidate string, service string, domain string, document string"), target=6)
    rows = {}
    for r in got.orderBy("task_id", "r").collect():
        rows.setdefault(r.task_id, []).append(r.candidate)
    for t, q, s, d, gold in tasks:
        order = sorted((x for x in pool if x[0] not in gold), key=lambda x: (x[1] != s, x[2] != d, -len(set((x[3] or "").split()) & set(q.split())), x[0]))
        assert rows[t] == [x[0] for x in order[: max(6, len(gold) + 1) - len(gold)]]
    assert not set(words) & set(STOPWORDS)


def test_selection_status(spark):
    r, c = '"ranked_candidate_ids": ["b", "a"]', '"selected_candidate_ids": '
    cases = {
        f"{{{r}, {c}[]}}": "ok", f'{{{c}["a"], {r}}}': "ok", f'{{{r}, {c}["a", "a"]}}': "duplicate_selection", f'{{{r}, {c}["z"]}}': "unknown_selection", f"{{{r}, {c}[1]}}": "selection_not_strings", f"{{{r}, {c}null}}": "selection_not_strings",
        f"{{{r}}}": "unexpected_keys", f'{{{r}, {c}[], "x": 1}}': "unexpected_keys", "[1]": "not_an_object", "{": "invalid_json", '{"ranked_candidate_ids": ["a"], "selected_candidate_ids": []}': "ranking_length",
        '{"ranked_candidate_ids": ["a", "a"], "selected_candidate_ids": []}': "duplicate_candidate", '{"ranked_candidate_ids": ["a", "z"], "selected_candidate_ids": []}': "unknown_candidate", '{"ranked_candidate_ids": "ab", "selected_candidate_ids": []}': "ranking_not_strings",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {x.a: x.s for x in df.select("a", manifests.selection_status(F.col("a"), F.array(F.lit("a"), F.lit("b"))).alias("s")).collect()} == cases


def test_scalars_in_normal_form(spark):
    df = spark.createDataFrame([("ﬁle",), ("１２.50",), ("Cafe\u0301",), (None,)], "v string")
    assert [x[0] for x in df.select(reviews.normalize_scalar(F.col("v"))).collect()] == ["file", "12.5", "caf\u00e9", ""]


def test_files_are_indexed_once_and_appends_repeat_safely(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.txt").write_text("one")
    assert readers.index_files(spark, str(src), out, mark).count() == 1
    (src / "b.txt").write_text("two")
    assert sorted(r.bytes for r in readers.index_files(spark, str(src), out, mark).collect()) == [3, 3]
    assert readers.index_files(spark, str(src), out, mark).count() == 2
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    for batch, some in (("b1", df), ("b2", df.unionByName(spark.createDataFrame([(3, "z")], df.schema))), ("b2", df.unionByName(spark.createDataFrame([(3, "z")], df.schema)))):
        writers.append_new(some, str(tmp_path / "t"), "id", batch)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "b1"), (2, "b1"), (3, "b2")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from veridex.plans.scratch import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: None)
    fake = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    assert shared_dir(fake("local[4]"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(fake("spark://x:7077"))


def test_global_bm25_against_all_pairs(spark, monkeypatch):
    """Exact top k with few pairs scored in full, whether terms are broadcast or joined."""
    import math
    from collections import Counter

    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(words[min(399, int(rng.expovariate(0.03)))] for _ in range(n))
    asked = [(i, f"{text(3)} {' '.join(rng.sample(words[60:], 4))}") for i in range(20)] + [(30, "nothing"), (31, None)]
    corpus = [(i, text(rng.randint(1, 30))) for i in range(1500)] + [(2000, None), (2001, "")]
    queries, docs = spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(corpus, "candidate_id long, document string").repartition(5)
    have = {d: Counter((t or "").split()) for d, t in corpus}
    mean = sum(sum(c.values()) for c in have.values()) / len(have)
    df = Counter(w for c in have.values() for w in c)
    want, sharing = {}, 0
    for q, t in asked:
        scores = {d: sum(math.log(1 + (len(have) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in (t or "").split() if c[w]) for d, c in have.items()}
        order = sorted((d for d in scores if scores[d] > 0), key=lambda d: (-round(scores[d], 9), d))
        sharing += len(order)
        want |= {(q, r): (d, round(scores[d], 9)) for r, d in enumerate(order[:7], 1)}
    scored = []
    listed = rankers._shortlist
    monkeypatch.setattr(rankers, "_shortlist", lambda *a: scored.append(listed(*a).count()) or listed(*a))
    for bound in (rankers.BROADCAST_TERMS, 0):
        monkeypatch.setattr(rankers, "BROADCAST_TERMS", bound)
        assert {(r.query_id, r["rank"]): (r.candidate_id, round(r.score, 9)) for r in rankers.bm25_global(queries, docs, 7).collect()} == want
    assert len(want) == 140 and scored[0] < sharing / 4
    assert rankers.bm25_global(queries, docs.limit(0), 7).count() == 0
