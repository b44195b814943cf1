"""Duplicate groups by several keys, winners by source priority, and collision audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions.text import present


def winners(rows: DataFrame, key: list[Column], priority: Column, row_id: str) -> DataFrame:
    """Of each group of equal keys the row of best source priority, then smallest id."""
    order = Window.partitionBy(*key).orderBy(priority, row_id)
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def _members(rows: DataFrame, row_id: str, keys: dict[str, Column], shared_names: bool) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit("" if shared_names else name).alias("key_type"), present(c).alias("key")) for name, c in sorted(keys.items())))
    each = rows.select(row_id, F.explode(F.array_distinct(pairs)).alias("k")).select(row_id, "k.*").where("key is not null")
    groups = each.groupBy("key_type", "key").agg(F.count("*").alias("group_size"), F.min(row_id).alias("representative")).where("group_size > 1")
    return each.join(groups, ["key_type", "key"])


def key_groups(rows: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """Each row's duplicate group: the largest over all key types (then the first key type), with every reason.

    A row without a group is its own representative. The number of groups that
    rows chose is what counts, so a group nobody chose has no number.
    """
    met = _members(rows, row_id, keys, False)
    best = F.min_by(F.struct("key_type", "key", "group_size", "representative"), F.struct(-F.col("group_size"), F.col("key_type"), F.col("key")))
    chosen = met.groupBy(row_id).agg(best.alias("g"), F.array_join(F.array_sort(F.collect_set("key_type")), ";").alias("reason"))
    return rows.select(row_id).join(chosen, row_id, "left").select(
        row_id,
        F.coalesce("g.group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("g.representative") == F.col(row_id), F.lit(True)).alias("is_representative"),
        F.coalesce("g.key_type", F.lit("")).alias("key_type"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


def shared_key_groups(rows: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """One row of counts where all key types share a namespace: groups of two and more, and rows in any of them."""
    met = _members(rows, row_id, keys, True)
    return met.agg(F.count_distinct("key").alias("duplicate_groups"), F.count_distinct(row_id).alias("duplicate_rows"))


def collisions(rows: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """(field, value, splits, n) of values that more than one split holds."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), present(F.col(f)).alias("value")) for f in fields))
    each = rows.select(split, F.explode(pairs).alias("p")).select(split, "p.*").where("value is not null")
    found = each.groupBy("field", "value").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("n"), F.count_distinct(split).alias("k"))
    return found.where("k > 1").drop("k")


def linked_override(rows: DataFrame, query: Column, task: str) -> DataFrame:
    """The split group of each row: the query's hash where a query spans several tasks, else the task's own."""
    spread = rows.withColumn("q", query).groupBy("q").agg((F.count_distinct(task) > 1).alias("linked"))
    return rows.withColumn("q", query).join(spread, "q").withColumn("split_group", F.when(F.col("linked"), F.concat(F.lit("query::"), F.substring(F.sha2("q", 256), 1, 24))).otherwise(F.concat(F.lit("task::"), F.col(task).cast("string")))).drop("q", "linked")


def changed_fields(old: DataFrame, new: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """(key, field, old, new) of every difference outside the allowed fields; rows on one side only give field <row>."""
    fields = [c for c in old.columns if c in new.columns and c != key and c not in allowed]
    sides = [df.select(F.col(key), F.lit(True).alias(f"{s}_there"), *(F.col(c).cast("string").alias(f"{s}_{c}") for c in fields)) for s, df in (("old", old), ("new", new))]
    both = sides[0].join(sides[1], key, "full_outer")
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new")) for c in fields))
    one_side = F.col("old_there").isNull() | F.col("new_there").isNull()
    row = F.array(F.struct(F.lit("<row>").alias("field"), F.col("old_there").cast("string").alias("old"), F.col("new_there").cast("string").alias("new")))
    return both.select(key, F.explode(F.when(one_side, row).otherwise(F.filter(cells, lambda c: ~c["old"].eqNullSafe(c["new"])))).alias("c")).select(key, "c.*")
