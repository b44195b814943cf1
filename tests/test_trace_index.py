"""Trace files: records by byte ranges, what their calls say, and an index that is the same after interruptions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veridex.operators import trace_records as T
from veridex.streaming import trace_index as I


def call(name, arguments="{}"):
    return {"role": "assistant", "function_call": {"name": name, "arguments": arguments}}


def tool(name, content):
    return {"role": "function", "name": name, "content": content}


def generated(*chains, **more):
    return {"answer_generation": {"query": " ask ", "train_messages": list(chains), **more}}


TWO = [call("get_city_for_maps", '{"q": 1}'), tool("Get City for Maps", '{"id": 3}'), call("find_for_hotels", '{"id": 3}'), tool("", "[]"), call("Finish", '{"return_type": "give_answer", "final_answer": "yes"}')]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind > 3:
        return {rng.choice(['a"', "ü\\", "日,", "}"]) + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}
    return [rng.choice(['x,"]', "", "ß}{", "\n"]), rng.randrange(99), None, [value(rng, depth + 1) for _ in range(rng.randrange(3))]][kind]


@pytest.mark.parametrize("layout", ["keyed", "list"])
def test_ranges_of_random_files(layout):
    rng = random.Random(8)
    for k in range(300):
        held = {f'k{i}"é': value(rng) for i in range(rng.randrange(5))} if layout == "keyed" else [value(rng) for _ in range(rng.randrange(5))]
        content = rng.choice(["", "﻿"]).encode() + (" \n" + json.dumps(held, ensure_ascii=bool(k % 2), indent=rng.choice([None, 1])) + "\n").encode()
        got = T.records(content, "f", layout)
        assert [r[4] for r in got] == list(held.values() if layout == "keyed" else held)
        assert all(T.record_at(content[at : at + n], path) == r for _, path, at, n, r in got)


def test_layouts_and_unreadable_files():
    assert [r[4] for r in T.records(b'{"a": 1, "b": 2, "a": 3}', "f", "keyed")] == [3, 2]
    one, two = T.records('[{"query": "q", "answers": [{"method": "m"}, 5]}]'.encode(), "f", "list")
    assert (one[0], one[1], one[4]) == ("list_0_0_m", "$[0].answers[0]", {"query": "q", "answer": {"method": "m"}}) and two[4] == {"query": "q", "answer": 5}
    assert T.record_at(b'{"query": "q", "answers": [{"method": "m"}, 5]}', two[1]) == two[4]
    assert [r[:2] for r in T.records(b"[1]", "name", "keyed")] == [("name", "$")] and T.records(b"{}", "f", "keyed") == T.records(b" [ ] ", "f", "list") == []
    for bad in (b"", b"{", b"[1,]", b'{"a": 1}}', b"[1] 2", b'{"a" 1}', b"[1 2]", b"\xff", b"[" * 200_000):
        for layout in T.LAYOUTS:
            with pytest.raises(T.UNREADABLE):
                T.records(bad, "f", layout)


def test_what_calls_say():
    query, status, calls, error = T.parsed(generated(TWO))
    assert (query, status, error, calls.made) == ("ask", "ok", "", [("maps", "get_city"), ("hotels", "find")]) and calls.arguments and calls.outputs and calls.observations
    status = lambda r: T.parsed(r)[1]
    other = [call("x"), call("Finish", '{"return_type": "give_up_and_restart"}')]
    assert T.parsed(generated(TWO, other, final_answer='{"final_answer": "yes"}'))[2].made[0][0] == "maps"
    assert T.parsed(generated(TWO, other, finish_type="give_up"))[2].made == [("", "x")]
    assert status(generated(TWO, other)) == "parse_failed" and status(generated(TWO, [], ["no message"])) == "ok" and status(generated([])) == "no_ordered_calls"
    assert [status(r) for r in ({"answer_generation": {}}, {}, 5, None, {"answer": {}})] == ["unsupported_record_schema", "unsupported_record_schema", "parse_failed", "parse_failed", "unsupported_record_schema"]
    wrong = T.parsed(generated([call("a_for_b"), tool("c", "late"), tool("a for b", "own"), tool("a for b", "second")]))[2]
    assert not wrong.arguments and wrong.observations
    assert not T.parsed(generated([call("a"), call("Finish"), tool("a", "late")]))[2].observations
    node = None
    for k in range(5_000):
        node = {"role": "tool", "message": {"name": f"n{k}_for_s", "arguments": {}, "response": "r" if k == 0 else ""}, "next": [node]}
    found = T.parsed({"query": "q", "answer": {"answer_details": [node, {"role": "tool", "message": {"name": "Finish"}}]}})
    assert (found[1], len(found[2].made), found[2].made[0]) == ("ok", 5_000, ("s", "n4999")) and found[2].observations and not found[2].arguments


@pytest.fixture
def traces(tmp_path):
    rng = random.Random(2)
    for k in range(12):
        group = tmp_path / "in" / rng.choice(["G1_answer", "x_g2", "plain"])
        group.mkdir(parents=True, exist_ok=True)
        made = [generated(TWO), generated(TWO[:2]), {"query": "q"}, {"query": "é", "answer": {"answer_details": [{"role": "tool", "message": {"name": "a_for_b", "response": 1}}]}}]
        held = [made, {f"r{i}": rng.choice(made) for i in range(4)}, made[0]][k % 3]
        (group / f"{k}_{['list', 'keyed', 'single'][k % 3]}.json").write_text(json.dumps(held, ensure_ascii=False, indent=k % 2 or None), encoding="utf-8")
    (tmp_path / "in" / "bad_single.json").write_text("{")
    return tmp_path


def test_interrupted_and_whole_runs_agree(spark, traces):
    src, layout_of = str(traces / "in"), F.regexp_extract("path", r"_(\w+)\.json$", 1)
    I.update_index(spark, src, str(traces / "whole"), str(traces / "mark0"), layout_of)
    done = []

    def fails(files, batch, out, layout):
        rows = f"{out}/index/batch={batch}"
        if len(done) == 2:
            I.index_traces(files, layout).write.mode("overwrite").parquet(rows)
            raise OSError("lost")
        done.append(batch)
        I._batch(files, batch, out, layout)

    parts, mark = str(traces / "parts"), str(traces / "mark1")
    with pytest.raises(Exception, match="lost"):
        I.update_index(spark, src, parts, mark, layout_of, 3, write=fails)
    assert I.current_index(spark, parts).select("file").distinct().count() == 6
    I.update_index(spark, src, parts, mark, layout_of, 3)
    rows = lambda out: sorted(map(tuple, I.current_index(spark, out).select(*sorted(I.current_index(spark, out).columns)).collect()))
    count = lambda out: {(r.counter, r.value): r.n for r in I.counters(spark, out).collect()}
    assert rows(parts) == rows(str(traces / "whole")) and count(parts) == count(str(traces / "whole"))
    got = count(parts)
    index = I.current_index(spark, parts).collect()
    assert got["total", "records"] == len(index) == 4 * 4 + 4 * 4 + 4 + 1 and got["total", "eligible"] == sum(r.eligible for r in index) >= 8
    assert got["status", "parse_failed"] == 1 and {v for c, v in got if c == "group"} <= {"G1", "G2", "unknown"}
    (traces / "in" / "late_list.json").write_text("[1]")
    I.update_index(spark, src, parts, mark, layout_of)
    assert count(parts) == got | {("total", "records"): got["total", "records"] + 1, ("status", "parse_failed"): 2, ("layout", "list"): got["layout", "list"] + 1, ("group", "unknown"): got["group", "unknown"] + 1}
    loaded = {r.trace_id: r for r in I.load_records(I.current_index(spark, parts)).collect()}
    for r in index:
        assert (loaded[r.trace_id].failure is not None) == (r.error.startswith("JSONDecodeError")) and (r.error or T.parsed(json.loads(loaded[r.trace_id].record))[0] == r.query)
