"""Readers: CSV with string cells, JSON lines and arrays, dispatch by suffix, file inventories, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veridex.functions.text import json_kind, present
from veridex.sources.archives import zip_members, zip_pieces


def read_csv(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Every cell a string; quotes double, cells may hold newlines, a byte-order mark is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1)
    if fields:
        reader = reader.schema(StructType([StructField(f, StringType()) for f in fields]))
    return reader.csv(path)


def read_jsonl(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """JSON lines; with a key the last line of each key wins (by file and line order)."""
    df = spark.read.json(path)
    if key is None:
        return df
    order = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_line"))
    placed = df.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"))
    return placed.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_file", "_line")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one array: an element a row."""
    return spark.read.option("multiLine", True).json(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("jsonl", "ndjson"):
        return read_jsonl(spark, path)
    if suffix == "json":
        return read_json_array(spark, path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{suffix}")


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every .json file below a folder as one row, with its path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("v")).select("file", "v.*")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, bytes, safe, crc, content: a row per member of every archive with its whole content; unsafe names are listed without.

    A damaged archive or member raises. Members beyond what one value can hold
    are for `archives.zip_pieces`, which also tells what failed.
    """
    members = zip_members(spark, path)
    whole = zip_pieces(members).groupBy("archive", "at").agg(F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("p"), F.max("error").alias("failure"))
    content = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["content"]))
    failed = F.coalesce("error", "failure")
    checked = F.when(failed.isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "name", failed)).cast("binary")).when(F.col("p").isNotNull(), content)
    return members.join(whole, ["archive", "at"], "left").select("archive", "name", "bytes", "safe", "crc", checked.alias("content"))


def field_inventory(rows: DataFrame, fields: list[str], first: int = 100, order: str | None = None) -> DataFrame:
    """(field, kind): what the first non-empty values of each string column all are."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), present(F.col(f).cast("string")).alias("value")) for f in fields))
    each = rows.select(*([order] if order else []), F.explode(pairs).alias("p")).select(*([order] if order else []), "p.*").where("value is not null")
    w = Window.partitionBy("field").orderBy(order or "value")
    some = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).withColumn("k", json_kind(F.col("value")))
    kinds = F.collect_set("k")
    kind = F.when(F.size(kinds) == 1, kinds[0]).when(F.size(F.array_except(kinds, F.array(F.lit("integer"), F.lit("number")))) == 0, "number").otherwise("string")
    found = some.groupBy("field").agg(kind.alias("kind"))
    names = rows.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return names.join(found, "field", "left").select("field", F.coalesce("kind", F.lit("empty")).alias("kind"))


def count_elements(spark: SparkSession, path: str) -> int:
    """Elements of a file that is one JSON array, without keeping any."""
    return spark.read.schema("_x string").option("multiLine", True).json(path).count()


def mine_records(rows: DataFrame, row_id: str, text: str, schema: str) -> DataFrame:
    """(row_id, fields of schema) of JSON records inside pages: contents of application/json scripts, an object or an array each."""
    bodies = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<script[^>]*application/(?:ld\+)?json[^>]*>(.*?)</script>"), F.lit(1))
    found = rows.select(row_id, F.explode(bodies).alias("b"))
    parsed = F.coalesce(F.when(F.ltrim("b").startswith("["), F.from_json("b", f"array<struct<{schema}>>")), F.array(F.from_json("b", f"struct<{schema}>")))
    return found.select(row_id, F.explode(parsed).alias("r")).where("r is not null").select(row_id, "r.*")


def checked_registry(entries: DataFrame, records: DataFrame, forbidden: tuple[str, ...] = ("union", "cross_source", "cross-source", "merged")) -> DataFrame:
    """Entries of a catalog registry with the reasons that block them, and SAFE or BLOCKED.

    entries: catalog_id, path, size, sha256, scope_status, primary (strings); records:
    catalog_id, actual_sha256, candidate_id, name, description, one row a record that
    was read, of all catalogs together.
    """
    by = records.groupBy("catalog_id").agg(F.count_distinct("candidate_id").alias("actual_size"), F.first("actual_sha256").alias("actual_sha256"), F.count_if(present(F.col("candidate_id")).isNull() | (present(F.col("name")).isNull() & present(F.col("description")).isNull())).alias("bad"))
    clash = records.groupBy("catalog_id", "candidate_id").agg(F.count_distinct(F.struct("name", "description")).alias("k")).where("k > 1").select("catalog_id", F.lit(True).alias("clash")).distinct()
    df = entries.join(by, "catalog_id", "left").join(clash, "catalog_id", "left")
    marker = F.lower(F.concat_ws(" ", "catalog_id", "path"))
    named = F.lit(False)
    for word in forbidden:
        named = named | marker.contains(word)
    reasons = F.array_compact(F.array(
        F.when(named, F.lit("FORBIDDEN_MARKER")), F.when(F.col("actual_size").isNull(), F.lit("CATALOG_MISSING")),
        F.when(~F.coalesce(F.col("scope_status").startswith("PASS"), F.lit(False)) | (F.lower(F.coalesce("primary", F.lit(""))) != "true"), F.lit("NOT_PRIMARY_PASSING")),
        F.when(present(F.col("sha256")).isNotNull() & (F.col("sha256") != F.col("actual_sha256")), F.lit("SHA256_MISMATCH")), F.when((F.col("bad") > 0) | F.coalesce("clash", F.lit(False)), F.lit("SCHEMA_INVALID")),
        F.when(F.col("actual_size") != F.coalesce(F.expr("try_cast(size as bigint)"), F.lit(-1)), F.lit("SIZE_MISMATCH")),
    ))
    return df.select("catalog_id", reasons.alias("reasons"), F.when(F.size(reasons) == 0, "SAFE").otherwise("BLOCKED").alias("status"), F.coalesce("actual_size", F.lit(0)).alias("actual_size"))


def index_files(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*") -> DataFrame:
    """The index of a folder's files (path, bytes, SHA-256), brought up to date: a stream whose checkpoint remembers what was read, so a file is hashed once however often this runs."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
