"""Small Spark helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.plans.scratch import Scratch

__all__ = ["NO_ID", "Scratch", "keyed", "read"]

#: Stands for a null id while rows are matched; ids are longs below it.
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """_d: doc_id, NO_ID for null; _h: tells rows apart that repeat an id; _t: the text, empty for null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), F.hash(text).alias("_h"), text.alias("_t"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
