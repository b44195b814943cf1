"""Joins that check what they rely on, and set operations over ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _demand(df: DataFrame, problem: str) -> None:
    found = df.limit(3).collect()
    if found:
        raise ValueError(f"{problem}: {[tuple(r) for r in found]}")


def required_join(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join where every row must have exactly one partner; raises with the first keys that don't."""
    _demand(lookup.groupBy(*keys).count().where("count > 1").select(*keys), "keys are not unique")
    _demand(rows.join(lookup, keys, "left_anti").select(*keys), "keys are missing")
    return rows.join(lookup, keys)


def guarded_join(rows: DataFrame, lookup: DataFrame, keys: list[str], guards: list[str]) -> DataFrame:
    """Join on keys and say for each row which guard columns (source, target, hash of the query) differ between the sides; the status is unmatched, mismatch or matched."""
    other = lookup.select(*keys, *(F.col(g).alias(f"_{g}") for g in guards), F.lit(True).alias("_there"))
    wrong = F.array_compact(F.array(*(F.when(~F.col(g).eqNullSafe(F.col(f"_{g}")), F.lit(g)) for g in guards)))
    met = rows.join(other, keys, "left")
    differs = F.when(F.col("_there"), wrong).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("_there").isNull(), "unmatched").when(F.size(differs) > 0, "mismatch").otherwise("matched")
    return met.withColumns({"differs": differs, "status": status}).drop("_there", *(f"_{g}" for g in guards))


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids that only one side has; empty where both have the same set."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def append_branches(branches: dict[str, DataFrame], name: str = "branch") -> DataFrame:
    """Rows of branches with different columns, missing ones null, each with its branch's name."""
    out = None
    for label, df in branches.items():
        rows = df.withColumn(name, F.lit(label))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no branches")
    return out


def enriched(rows: DataFrame, key: str, sides: list[DataFrame], fields: dict[str, list[str]]) -> DataFrame:
    """Rows with the first field that isn't blank among the columns listed for each target, after a required join with every side."""
    out = rows
    for k, side in enumerate(sides):
        out = required_join(out, side.select(key, *(F.col(c).alias(f"_{k}_{c}") for c in side.columns if c != key)), [key])
    pick: dict[str, Column] = {}
    for target, columns in fields.items():
        known = [c for c in (x for name in columns for x in (name, *(f"_{k}_{name}" for k in range(len(sides))))) if c in out.columns]
        pick[target] = F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in known), F.lit(""))
    done = out.withColumns(pick)
    return done.drop(*(c for c in done.columns if c.startswith("_")))
