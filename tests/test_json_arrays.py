"""Arrays cut into many stretches against the standard reader."""

import json
import random

import pytest

from veridex.sources import json_arrays as J


@pytest.fixture
def small_stretches(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    yield lambda n: [spark.conf.set(k, n) for k in keys]
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind > 4:
        return {rng.choice(['a,"', "b]", "c\\", "é{"]) + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [rng.choice(['x,y"[z', "\\\\", '\\"', "]},", "", "plain", "日本,", "\n,"]) * rng.randrange(4), rng.randrange(1000), None, rng.random() < 0.5][kind]


@pytest.mark.parametrize("stretch", ["40", "300", "1m"])
def test_elements_of_random_arrays(spark, tmp_path, small_stretches, stretch):
    rng = random.Random(int(stretch.rstrip("m")))
    want = {}
    for k in range(6):
        rows = [value(rng) for _ in range(rng.choice([0, 1, 60]))] + (["y" * 700, {"k": ["," * 200] * 3}] if k > 2 else [])
        text = json.dumps(rows, ensure_ascii=bool(k % 2), indent=rng.choice([None, 2]))
        (tmp_path / f"{k}.json").write_text(("﻿" if k == 4 else " \n") + text + "\n", encoding="utf-8")
        want |= {(f"{k}.json", i): v for i, v in enumerate(rows)}
    (tmp_path / "blank.json").write_text(" \n")
    small_stretches(stretch)
    rows = J.json_elements(spark, str(tmp_path)).collect()
    assert {(r.file.rsplit("/", 1)[1], r.position): json.loads(r.element) for r in rows} == want and len(rows) == len(want)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_stretches):
    rows = [{"id": i, "name": f"n{i}, [x", "tags": ["a", "b"]} for i in range(60_000)]
    (tmp_path / "big.json").write_text(json.dumps(rows))
    small_stretches("256k")
    assert J._fragments(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
    got = J.read_json_elements(spark, str(tmp_path), "id long, name string, tags array<string>")
    assert got.count() == 60_000 and got.where("position != id or name != concat('n', id, ', [x') or size(tags) != 2").count() == 0


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not one array"):
        J.json_elements(spark, str(tmp_path))
