"""Server-sent events: frames, joined data lines and answers, in batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "request_id string, frames int, text string, done boolean, terminal boolean, retryable boolean"
_STATE = "event string, data array<string>, parts array<string>, frames int, done boolean, terminal boolean"


def parse_frames(lines: DataFrame) -> DataFrame:
    """Dispatched frames from lines. lines: request_id, seq, line.

    A blank line ends a frame and resets its event name; several data lines are
    joined by a newline; lines that start with a colon are heartbeats.
    """
    w = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumn("frame", F.coalesce(F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(w), F.lit(0)))
    body = lambda name: F.regexp_replace(F.regexp_extract("line", rf"^{name}:(.*)$", 1), "^ ", "")
    data = F.when(F.col("line").startswith("data:"), F.struct("seq", body("data").alias("d")))
    event = F.when(F.col("line").startswith("event:"), F.struct("seq", body("event").alias("e")))
    frames = numbered.groupBy("request_id", "frame").agg(F.array_sort(F.collect_list(data)).alias("data"), F.max(event).alias("event"), F.max(F.when(F.col("line") == "", 1)).alias("ended"))
    frames = frames.where("ended = 1 and size(data) > 0")
    return frames.select("request_id", "frame", F.coalesce("event.e", F.lit("message")).alias("event"), F.array_join(F.transform("data", lambda x: x["d"]), "\n").alias("data"))


def assemble(frames: DataFrame) -> DataFrame:
    """The answer of each request: deltas in order, and whether it both finished and said [DONE] (else it can be retried)."""
    delta = F.get_json_object("data", "$.delta")
    finish = F.get_json_object("data", "$.finish_reason")
    by = frames.groupBy("request_id").agg(
        F.count("*").cast("int").alias("frames"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(delta.isNotNull(), F.struct("frame", delta.alias("d"))))), lambda x: x["d"]), "").alias("text"),
        F.bool_or(F.col("data") == "[DONE]").alias("done"),
        F.coalesce(F.bool_or(finish.isNotNull()), F.lit(False)).alias("terminal"),
    )
    return by.withColumn("retryable", ~(F.col("done") & F.col("terminal")))


def _advance(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import json

    event, data, parts, frames, done, terminal = state.get if state.exists else ("", [], [], 0, False, False)
    data, parts = list(data), list(parts)
    lines = pd.concat(list(batches)).sort_values("seq")["line"]
    for line in lines:
        if line == "":
            if data:
                body = "\n".join(data)
                frames += 1
                if body == "[DONE]":
                    done = True
                else:
                    try:
                        got = json.loads(body)
                    except ValueError:
                        got = {}
                    got = got if isinstance(got, dict) else {}
                    parts += [str(got["delta"])] if got.get("delta") is not None else []
                    terminal = terminal or got.get("finish_reason") is not None
            event, data = "", []
        elif line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))
        elif line.startswith("event:"):
            event = line[6:].removeprefix(" ")
    state.update((event, data, parts, frames, done, terminal))
    yield pd.DataFrame([(key[0], frames, "".join(parts), done, terminal, not (done and terminal))], columns=["request_id", "frames", "text", "done", "terminal", "retryable"])


def assemble_stream(lines: DataFrame) -> DataFrame:
    """The same as a stream of lines arrives: the state of a request after each trigger that touches it."""
    return lines.groupBy("request_id").applyInPandasWithState(_advance, OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def latest_status(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """The last attempt of each request wins."""
    return attempts.groupBy(key).agg(F.max_by(F.struct(*[c for c in attempts.columns if c != key]), order).alias("r")).select(key, "r.*")


def starts_in_window(attempts: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """How many requests of a key began in the window up to each one.

    Every request also stands in the next stretch of time as long as the window,
    so that a busy key is counted stretch by stretch and never sorted as a whole.
    """
    at = F.col(ts).cast("timestamp").cast("double")
    own = F.floor(at / seconds)
    rows = attempts.withColumn("_s", F.explode(F.array(F.struct(own.alias("stretch"), F.lit(True).alias("own")), F.struct((own + 1).alias("stretch"), F.lit(False).alias("own")))))
    w = Window.partitionBy(key, "_s.stretch").orderBy(at).rangeBetween(-seconds, 0)
    return rows.withColumn("starts", F.count("*").over(w)).where("_s.own").drop("_s")


def count_stream(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", by, "n")
