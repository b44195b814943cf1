"""Writers: chosen columns as CSV, canonical JSON lines, one folder a partition."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The listed columns in order; others are ignored, missing ones are empty."""
    cells = [F.col(f).cast("string").alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    df.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Compact JSON lines with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Each partition value in a folder of its own; running again replaces only the partitions that the rows touch."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def file_manifest(inventory: DataFrame) -> DataFrame:
    """SHA256SUMS lines of an inventory, by name."""
    return inventory.select(F.concat_ws("  ", "sha256", "name").alias("line"), "name").orderBy("name").select("line")


def append_new(rows: DataFrame, path: str, key: str, batch: str) -> None:
    """Append the rows whose key isn't there yet as partition `batch`; running the same batch again replaces it, so a repeated run adds nothing."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).where(F.col("batch") != batch).select(key).distinct()
        rows = rows.join(known, key, "left_anti")
    except AnalysisException:  # nothing there yet
        pass
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
