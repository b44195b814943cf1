"""Files that are one JSON array, read by many tasks each: a structural scan finds the elements of every stretch of a file.

Spark cuts a file into stretches at commas. What a stretch does to the state of
the scan (inside a string or not, how many brackets are open) depends on its
beginning only in two ways, so every stretch is summed up on its own, the driver
folds one row per stretch, and a second pass cuts elements from known states.
Elements that lie over a border are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veridex.plans.scratch import Scratch

ESCAPED = re.compile(r"\\.", re.S)
OPEN, CLOSE = re.compile(r"[\[{]"), re.compile(r"[\]}]")
State = dict[tuple[str, int], tuple[bool, int]]


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _effect(text: str) -> tuple[int, int, int]:
    """Quotes in the text, and by how many brackets it opens or closes outside of strings if it begins outside, and if it begins inside of one."""
    if '"' not in text:
        return 0, _depth(text), 0
    parts = (ESCAPED.sub("", text) if "\\" in text else text).split('"')
    return len(parts) - 1, sum(map(_depth, parts[::2])), sum(map(_depth, parts[1::2]))


def _depth(text: str) -> int:
    return len(OPEN.findall(text)) - len(CLOSE.findall(text))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True), batch.column("value").to_pylist(), strict=True)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per stretch: whether its quotes are odd, and its brackets for both beginnings."""
    sums: dict[tuple[str, int], list[int]] = {}
    for key, text in _stretches(batches):
        own = sums.setdefault(key, [0, 0, 0])
        quotes, outside, inside = _effect(text)
        if own[0] % 2:
            outside, inside = inside, outside
        own[0], own[1], own[2] = own[0] + quotes, own[1] + outside, own[2] + inside
    rows = [(*k, v[0] % 2 == 1, v[1], v[2]) for k, v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=["file", "start", "odd", "outside", "inside"])


PIECES = "file string, start long, k long, element string, begins boolean, ends boolean"
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("element", pa.string()), ("begins", pa.bool_()), ("ends", pa.bool_())])


def _cut(batches: Iterator[pa.RecordBatch], states: State, at_once: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Elements and pieces of elements, numbered inside their stretch."""
    rows: list[tuple] = []
    now, held, k, begins, inside, depth = None, [], 0, True, False, 0

    def piece(ends: bool) -> tuple:
        return (*now, k, ",".join(held), begins, ends)

    def full() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PIECES)], schema=_PIECES)
        rows.clear()
        return made

    for key, text in _stretches(batches):
        if key != now:
            if held:
                rows.append(piece(False))
            (inside, depth), now, held, k = states[key], key, [], 0
            begins = not inside and depth <= 1
        if depth == 0 and not inside:
            text = text.lstrip("﻿ \t\r\n")
            if text[:1] != "[":
                if text or k:
                    raise ValueError(f"{key[0]}: not one array")
                continue
            text, depth = text[1:], 1
        quotes, outside, within = _effect(text)
        depth += within if inside else outside
        inside ^= quotes % 2 == 1
        if depth == 0 and not inside:
            text = text[: text.rindex("]")]
        held.append(text)
        if depth <= 1 and not inside:
            rows.append(piece(True))
            held, k, begins = [], k + 1, True
            if len(rows) >= at_once:
                yield full()
    if held:
        rows.append(piece(False))
    yield full()


def _folded(rows: list) -> State:
    """The state at the beginning of every stretch."""
    states: State = {}
    file, inside, depth = None, False, 0
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        states[r["file"], r["start"]] = (inside, depth)
        depth += r["inside"] if inside else r["outside"]
        inside ^= r["odd"]
    return states


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, element): the JSON text of every element of the array in each file, by position from 0.

    A file is read by as many tasks as Spark cuts it into, each with one element in
    memory at a time; the driver sees a row per stretch. A file that isn't one
    array raises ValueError; an empty array and a blank file have no elements; a
    byte-order mark is dropped.
    """
    scratch = Scratch(spark, "json")
    fragments = _fragments(spark, path)
    sums = fragments.mapInArrow(_sum_up, "file string, start long, odd boolean, outside long, inside long").collect()
    pieces = scratch.keep(fragments.mapInArrow(partial(_cut, states=_folded(sums)), PIECES))
    counts = {(r["file"], r["start"]): r["n"] for r in pieces.groupBy("file", "start").agg(F.count_if("ends").alias("n")).collect()}
    base, file, so_far = [], None, 0
    for key in sorted((r["file"], r["start"]) for r in sums):
        file, so_far = key[0], so_far if key[0] == file else 0
        base.append((*key, so_far))
        so_far += counts.get(key, 0)
    placed = pieces.join(spark.createDataFrame(base, "file string, start long, base long"), ["file", "start"]).withColumn("position", F.col("base") + F.col("k"))
    whole = placed.where("begins and ends").select("file", "position", "element")
    parts = placed.where("not (begins and ends)").groupBy("file", "position").agg(F.array_sort(F.collect_list(F.struct("start", "element"))).alias("parts"))
    joined = parts.select("file", "position", F.array_join(F.transform("parts", lambda x: x["element"]), ",").alias("element"))
    return whole.unionByName(joined).withColumn("element", F.regexp_replace("element", r"^\s+|\s+$", "")).where("element != ''")


def read_json_elements(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """file, position and the fields of every element; what doesn't fit the schema is null."""
    return json_elements(spark, path).select("file", "position", F.from_json("element", schema).alias("_e")).select("file", "position", "_e.*")
