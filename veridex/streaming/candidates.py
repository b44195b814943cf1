"""Candidate spaces from a stream of tasks: exploded, classified and upserted per task, so that replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veridex.operators.candidates import explode_candidates, space_status

COUNTS = ("tasks_read", "tasks_converted", "candidate_rows", "gold_rows", "query_empty", "candidate_empty", "gold_empty")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def convert_batch(tasks: DataFrame, batch: int, out: str) -> None:
    """One batch of tasks (task_id, seq, query, candidates, gold) into folders of its own below `out`; the same batch writes the same folders again.

    Of a task that arrives several times in the batch the largest seq counts. The
    counts are written last: a batch without them is not complete and is not read.
    """
    latest = tasks.groupBy("task_id").agg(F.max_by(F.struct("query", "candidates", "gold"), F.struct("seq", F.xxhash64("query"))).alias("t"), F.count("*").alias("arrivals")).select("task_id", "t.*", "arrivals")
    text = F.trim(F.coalesce("query", F.lit("")))
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    latest = latest.select("task_id", text.alias("query"), some("candidates").alias("candidates"), some("gold").alias("gold"), "arrivals")
    latest = _written(latest.withColumn("status", space_status(F.col("candidates"), F.col("gold"))), f"{out}/tasks/batch={batch}")
    rows = _written(explode_candidates(latest), f"{out}/candidates/batch={batch}")
    empty = lambda c: F.count_if(F.size(c) == 0)
    of_tasks = latest.agg(F.coalesce(F.sum("arrivals"), F.lit(0)).alias("tasks_read"), F.count_if(F.size("candidates") > 0).alias("tasks_converted"), F.count_if(F.col("query") == "").alias("query_empty"), empty("candidates").alias("candidate_empty"), empty("gold").alias("gold_empty"))
    of_rows = rows.agg(F.count("*").alias("candidate_rows"), F.count_if("is_gold").alias("gold_rows"))
    of_tasks.join(of_rows, F.lit(True)).select(*COUNTS).write.mode("overwrite").parquet(f"{out}/counts/batch={batch}")


def candidate_stream(tasks: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts the conversion of a stream of tasks; the checkpoint says which batches are done, and an interrupted one is done again as a whole."""
    writer = tasks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: convert_batch(df, batch, out))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _complete(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/counts").select("batch").distinct()


def current_candidates(spark: SparkSession, out: str) -> DataFrame:
    """task_id, candidate_rank, candidate, is_gold, is_mentioned of every task as it arrived last, from complete batches."""
    done = F.broadcast(_complete(spark, out))  # a row per batch
    last = spark.read.parquet(f"{out}/tasks").join(done, "batch", "left_semi").groupBy("task_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/candidates").join(last, ["task_id", "batch"], "left_semi").drop("batch")


def counters(spark: SparkSession, out: str) -> DataFrame:
    """The counts of all complete batches together."""
    return spark.read.parquet(f"{out}/counts").agg(*(F.sum(c).alias(c) for c in COUNTS))
