"""An index of trace records that a stream keeps up to date: byte ranges to load single records by, and counters that merge over batches.

Every batch writes its rows and then its counters into folders of its own, so an
interrupted batch is done again as a whole and nothing is counted twice; the
counters of all batches are their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.operators.trace_records import UNREADABLE, Calls, parsed, record_at, records

_STRINGS, _NUMBERS, _FLAGS = ("file", "layout", "record_id", "path", "query", "status", "error"), ("at", "bytes", "calls", "services", "apis"), ("arguments", "outputs", "observations")
INDEX = ", ".join([*(f"{c} string" for c in _STRINGS), *(f"{c} long" for c in _NUMBERS), *(f"{c} boolean" for c in _FLAGS)])
_INDEX = pa.schema([*((c, pa.string()) for c in _STRINGS), *((c, pa.int64()) for c in _NUMBERS), *((c, pa.bool_()) for c in _FLAGS)])
COUNTERS = ("total", "status", "layout", "group")


def _row(file: str, layout: str, place: tuple, found: tuple[str, str, Calls, str]) -> tuple:
    record_id, path, at, size = place
    query, status, calls, error = found
    services, apis = {s for s, _ in calls.made if s}, {a for _, a in calls.made if a}
    return (file, layout, record_id, path, query, status, error, at, size, len(calls.made), len(services), len(apis), calls.arguments, calls.outputs, calls.observations)


def _of_file(file: str, layout: str, content: bytes) -> Iterator[tuple]:
    name = file.rsplit("/", 1)[-1].removesuffix(".json")
    try:
        held = records(content, name, layout)
    except UNREADABLE as e:
        yield _row(file, layout, (name, "$", 0, len(content)), ("", "parse_failed", Calls(), f"{type(e).__name__}: {e}"))
        return
    for record_id, path, at, size, record in held:
        yield _row(file, layout, (record_id, path, at, size), parsed(record))


def _indexed(batches: Iterator[pa.RecordBatch], at_once: int = 5_000) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def full() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_INDEX)], schema=_INDEX)
        rows.clear()
        return made

    for batch in batches:
        for k in range(batch.num_rows):
            for row in _of_file(*(batch.column(c)[k].as_py() for c in ("path", "layout", "content"))):
                rows.append(row)
                if len(rows) >= at_once:
                    yield full()
    yield full()


def index_traces(files: DataFrame, layout: Column | str = "single") -> DataFrame:
    """A row per record of trace files: file, layout, record_id, path, at, bytes, query, calls, services, apis, arguments, outputs, observations, status, error, trace_id, group, eligible.

    files: path and content (binary); layout says how a file holds records (see
    `trace_records.LAYOUTS`). A file that can't be read is one row, parse_failed.
    group is the G1, G2 or G3 that stands alone in the path. Eligible for a closer
    look are records of two calls and two services with arguments and with outputs
    or observations. trace_id is a digest of file and path.
    """
    rows = files.select("path", (F.lit(layout) if isinstance(layout, str) else layout).alias("layout"), F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(_indexed, INDEX)
    group = F.upper(F.regexp_extract("file", r"(?i)(?:^|[\\/_-])(G[123])(?:[\\/_-]|$)", 1))
    eligible = (F.col("status") == "ok") & (F.col("calls") >= 2) & (F.col("services") >= 2) & F.col("arguments") & (F.col("outputs") | F.col("observations"))
    return rows.withColumns({"trace_id": F.sha1(F.concat("file", F.lit("|"), "path")), "group": group, "eligible": eligible})


def counted(index: DataFrame) -> DataFrame:
    """(counter, value, n): totals of records, of those with several calls or services, of eligible ones, and counts by status, layout and group."""
    total = lambda name, when: F.when(when, F.struct(F.lit("total").alias("counter"), F.lit(name).alias("value")))
    by = lambda name, c: F.struct(F.lit(name).alias("counter"), c.alias("value"))
    group = F.when(F.col("group") == "", "unknown").otherwise(F.col("group"))
    marks = F.array_compact(F.array(
        total("records", F.lit(True)), total("multicall", F.col("calls") >= 2), total("multiservice", F.col("services") >= 2), total("eligible", F.col("eligible")),
        by("status", F.col("status")), by("layout", F.col("layout")), by("group", group),
    ))
    return index.select(F.explode(marks).alias("m")).groupBy("m.counter", "m.value").agg(F.count("*").alias("n"))


def merged(*snapshots: DataFrame) -> DataFrame:
    """Counters of several parts together."""
    rows = snapshots[0]
    for more in snapshots[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("counter", "value").agg(F.sum("n").alias("n"))


def _batch(files: DataFrame, batch: int, out: str, layout: Column | str) -> None:
    rows = f"{out}/index/batch={batch}"
    index_traces(files, layout).write.mode("overwrite").parquet(rows)
    counted(files.sparkSession.read.parquet(rows)).coalesce(1).write.mode("overwrite").parquet(f"{out}/counters/batch={batch}")


def update_index(spark: SparkSession, folder: str, out: str, checkpoint: str, layout: Column | str = "single", files_at_once: int = 10_000, pattern: str = "*.json", write=_batch) -> None:
    """Brings the index below `out` up to date with the files below a folder; each file is read once however often this runs or is interrupted."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    files = files.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(folder).select("path", "content")
    files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(partial(_call, write, out, layout)).trigger(availableNow=True).start().awaitTermination()


def _call(write, out: str, layout: Column | str, files: DataFrame, batch: int) -> None:
    write(files, batch, out, layout)


def counters(spark: SparkSession, out: str) -> DataFrame:
    """The counters of all complete batches together."""
    return merged(spark.read.parquet(f"{out}/counters"))


def current_index(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all complete batches."""
    complete = F.broadcast(spark.read.parquet(f"{out}/counters").select("batch").distinct())  # a row per batch
    return spark.read.parquet(f"{out}/index").join(complete, "batch", "left_semi").drop("batch")


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import json

    from veridex.sources.archives import open_file

    names = ["trace_id", "record", "failure"]
    for batch in batches:
        for row in batch.to_pylist():
            with open_file(row["file"]) as raw:
                raw.seek(row["at"])
                content = raw.read(row["bytes"])
            try:
                got = json.dumps(record_at(content, row["path"]), ensure_ascii=False, allow_nan=True), None
            except (*UNREADABLE, LookupError, AttributeError) as e:
                got = None, f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (row["trace_id"], *got)], names=names)


def load_records(index: DataFrame) -> DataFrame:
    """trace_id, record (JSON text) and failure of indexed records, each read by its own byte range and not with the rest of its file."""
    return index.select("trace_id", "file", "path", "at", "bytes").mapInArrow(_loaded, "trace_id string, record string, failure string")
