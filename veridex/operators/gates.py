"""Gates: named checks with what was observed and expected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(df: DataFrame, name: str, observed: Column, passed: Column, expected: str) -> DataFrame:
    """One row; `observed` is an aggregate, `passed` a condition on the column observed."""
    return df.agg(observed.cast("double").alias("observed")).select(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), F.round("observed", 6).alias("observed"), F.lit(expected).alias("expected"))


def gates(*rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def require(checks: DataFrame) -> None:
    """Raise on the first failed gate, by name."""
    bad = checks.where(~F.col("passed")).orderBy("name").limit(1).collect()
    if bad:
        raise ValueError(f"gate {bad[0]['name']} failed: observed {bad[0]['observed']}, expected {bad[0]['expected']}")


def schema_violations(df: DataFrame, row_id: str, schema: dict) -> DataFrame:
    """(row_id, field, rule) for required, enum, pattern and minLength of a JSON-Schema-like dict of string fields."""
    required = set(schema.get("required", ()))
    checks = []
    for field, rules in schema["properties"].items():
        value = F.col(field).cast("string") if field in df.columns else F.lit(None).cast("string")
        tests = {}
        if field in required:
            tests["required"] = value.isNull()
        if "enum" in rules:
            tests["enum"] = ~value.isin(*rules["enum"])
        if "pattern" in rules:
            tests["pattern"] = ~value.rlike(rules["pattern"])
        if "minLength" in rules:
            tests["minLength"] = F.length(value) < rules["minLength"]
        checks += [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"))) for rule, bad in tests.items()]
    return df.select(row_id, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(row_id, "v.*")
