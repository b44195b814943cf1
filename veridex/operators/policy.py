"""Rule cascades over rows: ordered decisions, collected hits, keyword tables and their evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import normalize_ascii


@dataclass(frozen=True)
class Rule:
    """A named condition with the action that it asks for."""

    name: str
    action: str
    when: Column


def first_match(rules: list[Rule], default: str, value: str = "action") -> Column:
    """The action (or name) of the first rule that holds; a null condition doesn't hold."""
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.when, F.lit(False)), rule.action if value == "action" else rule.name).otherwise(out)
    return out


def hits(rules: list[Rule]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(r.when, F.lit(False)), F.lit(r.name)) for r in rules)))


def strongest(rules: list[Rule], order: list[str], default: str) -> Column:
    """The strongest action of all rules that hold; `order` lists actions from strongest."""
    out = F.lit(default)
    for action in reversed(order):
        some = [F.coalesce(r.when, F.lit(False)) for r in rules if r.action == action]
        for c in some:
            out = F.when(c, action).otherwise(out)
    return out


def fail_closed(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """First match decides; a row is kept only where every condition is known, otherwise it is uncertain."""
    known = F.lit(True)
    for r in rules:
        known = known & r.when.isNotNull()
    decided = first_match(rules, "")
    return df.withColumns({"decision": F.when(decided != "", decided).when(known, "keep").otherwise("uncertain"), "rule": first_match(rules, "", "name")})


def collect_all(df: DataFrame, blocking: list[Rule], later: list[Rule], warnings: list[Rule]) -> DataFrame:
    """All blocking hits, the first of fixed priority as bucket; then later rules (service leaks), then warnings, then keep."""
    found = hits(blocking)
    bucket = F.when(F.size(found) > 0, found[0])
    bucket = F.coalesce(bucket, F.nullif(first_match(later, "", "name"), F.lit("")), F.when(F.size(hits(warnings)) > 0, "uncertain"), F.lit("keep"))
    return df.withColumns({"blocking": F.array_join(F.array_sort(F.array_distinct(found)), ";"), "warnings": F.array_join(F.array_sort(hits(warnings)), ";"), "bucket": bucket})


def hit_policy(df: DataFrame, rules: list[Rule], order: list[str], default: str = "keep") -> DataFrame:
    """The decision is the strongest action, the label the first hit in order, which need not be the strongest."""
    found = hits(rules)
    return df.withColumns({"decision": strongest(rules, order, default), "label": F.coalesce(F.get(found, F.lit(0)), F.lit("")), "reasons": F.array_join(found, ";")})


def keyword_hits(df: DataFrame, text: str, rules: DataFrame, row_id: str) -> DataFrame:
    """(row_id, label, state) for rules whose triggers a text holds: covered if also a positive word, else missing; a negative word makes it mismatch.

    rules: label, triggers, positive, negative (arrays of lower-case phrases), a small table.
    """
    q = normalize_ascii(F.col(text))
    rows = df.select(row_id, q.alias("q")).join(rules, F.expr("exists(triggers, t -> contains(q, t))"))
    any_of = lambda c: F.expr(f"exists({c}, t -> contains(q, t))")
    state = F.when(any_of("negative"), "mismatch").when(any_of("positive"), "covered").otherwise("missing")
    return rows.select(row_id, "label", state.alias("state"))


def coverage(rows: DataFrame, states: DataFrame, row_id: str) -> DataFrame:
    """Mismatch beats missing without any cover, which beats uncertain; covered rows are ok, rows without a rule too."""
    by = states.groupBy(row_id).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("mismatch", "missing", "covered")))
    n = lambda k: F.coalesce(k, F.lit(0))
    verdict = F.when(n("mismatch") > 0, "mismatch").when((n("missing") > 0) & (n("covered") == 0), "missing").when((n("missing") > 0), "uncertain").otherwise("ok")
    return rows.select(row_id).join(by, row_id, "left").select(row_id, verdict.alias("coverage"))


def dangerous(df: DataFrame, decision: str, flags: dict[str, Column]) -> DataFrame:
    """Kept rows that carry a blocking flag."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in flags.items())))
    return df.where(F.col(decision) == "keep").withColumn("flags", names).where("size(flags) > 0")


def resolve_reviews(reviews: DataFrame, task: str) -> DataFrame:
    """The standing decision of a task: adjudication over agreement of primary and secondary over the inherited one; disagreement needs adjudication.

    reviews: task, stage (inherited, primary, secondary, adjudication), decision.
    """
    by = reviews.groupBy(task).pivot("stage", ["inherited", "primary", "secondary", "adjudication"]).agg(F.max("decision"))
    state = (
        F.when(F.col("adjudication").isNotNull(), "adjudicated")
        .when(F.col("primary").isNotNull() & F.col("secondary").isNotNull() & (F.col("primary") != F.col("secondary")), "needs_adjudication")
        .when(F.col("primary").isNotNull(), "reviewed")
        .when(F.col("inherited").isNotNull(), "inherited")
        .otherwise("unreviewed")
    )
    final = F.when(state != "needs_adjudication", F.coalesce("adjudication", "primary", "inherited"))
    return by.select(task, state.alias("state"), final.alias("final_decision"))
