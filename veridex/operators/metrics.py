"""Set and rank metrics with several acceptable gold sets, in four dialects that must not be mixed.

All work on columns: `ranking` array<string>, `alternatives` array<array<string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_SETS = "array<array<string>>"


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def set_scores(predicted: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall, F1, Jaccard, exact match, completeness, over- and under-selection of two sets (gold not empty)."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    hits = overlap(p, g)
    size_p, size_g = F.size(p), F.size(g)
    return {
        "precision": F.when(size_p > 0, hits / size_p).otherwise(0.0),
        "recall": hits / size_g,
        "f1": 2 * hits / (size_p + size_g),
        "jaccard": hits / (size_p + size_g - hits),
        "exact_set_match": ((hits == size_p) & (hits == size_g)).cast("double"),
        "completeness": (hits == size_g).cast("double"),
        "over_selection": (size_p - hits).cast("double"),
        "under_selection": (size_g - hits).cast("double"),
    }


def first_hit(ranking: Column, gold: Column) -> Column:
    """The rank of the first relevant entry, null if there is none."""
    places = F.filter(F.transform(ranking, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull())
    return F.array_min(places)


def reciprocal_rank(ranking: Column, gold: Column) -> Column:
    return F.coalesce(1.0 / first_hit(ranking, gold), F.lit(0.0))


def ndcg(ranking: Column, gold: Column, k: int) -> Column:
    gains = F.transform(F.slice(ranking, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.lit(k), F.size(gold))), lambda i: 1.0 / F.log2(i + 1.0))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(gold) > 0, add(gains) / add(ideal)).otherwise(0.0)


def core_scores(ranking: Column, gold: Column, ks: tuple[int, ...] = (1, 3, 5), predicted: Column | None = None) -> dict[str, Column]:
    """The core dialect for one gold set; without a prediction the top |gold| entries are it."""
    ranking, gold = F.array_distinct(ranking), F.array_distinct(gold)
    chosen = set_scores(predicted if predicted is not None else F.slice(ranking, F.lit(1), F.size(gold)), gold)
    out = {"mrr": reciprocal_rank(ranking, gold), "exact_set_match": chosen["exact_set_match"], "multi_label_precision": chosen["precision"], "multi_label_recall": chosen["recall"], "multi_label_f1": chosen["f1"]}
    for k in ks:
        top = set_scores(F.slice(ranking, 1, k), gold)
        out |= {f"precision_at_{k}": top["precision"], f"recall_at_{k}": top["recall"], f"f1_at_{k}": top["f1"], f"hit_at_{k}": (top["recall"] > 0).cast("double"), f"ndcg_at_{k}": ndcg(ranking, gold, k)}
    return out


def reference_scores(ranking: Column, gold: Column, ks: tuple[int, ...] = (1, 3, 5, 10)) -> dict[str, Column]:
    """The reference dialect: adds completeness, has no precision or F1."""
    ranking, gold = F.array_distinct(ranking), F.array_distinct(gold)
    out = {"mrr": reciprocal_rank(ranking, gold)}
    for k in ks:
        top = set_scores(F.slice(ranking, 1, k), gold)
        out |= {f"recall_at_{k}": top["recall"], f"hit_at_{k}": (top["recall"] > 0).cast("double"), f"completeness_at_{k}": top["completeness"], f"ndcg_at_{k}": ndcg(ranking, gold, k)}
    return out


def best_per_metric(df: DataFrame, scores, ranking: str = "ranking", alternatives: str = "alternatives", **more) -> DataFrame:
    """Score every alternative by itself, then take the best of each metric; rows without a gold set are dropped."""
    alts = F.filter(F.col(alternatives), lambda a: F.size(a) > 0)
    named = lambda a: F.struct(*(v.alias(k) for k, v in scores(F.col(ranking), a, **more).items()))
    names = list(scores(F.col(ranking), F.array(F.lit("")), **more))
    scored = df.withColumn("_s", F.transform(alts, named)).where(F.size("_s") > 0)
    return scored.select(*df.columns, *(F.array_max(F.transform("_s", lambda s: s[k])).alias(k) for k in names))  # noqa: B023


def union_scores(df: DataFrame, ks: tuple[int, ...] = (1, 3, 5), selected: str | None = None) -> DataFrame:
    """The union dialect: rank metrics on the union of alternatives, set metrics from the alternative with the best (exact match, F1, Jaccard); an empty gold gives 0."""
    relevant = F.array_distinct(F.flatten("alternatives"))
    ranking = F.col("ranking")
    recall = lambda k: F.when(F.size(relevant) > 0, overlap(F.slice(ranking, 1, k), relevant) / F.size(relevant)).otherwise(0.0)
    out = {"mrr": reciprocal_rank(ranking, relevant)}
    for k in ks:
        out |= {f"recall_at_{k}": recall(k), f"hit_at_{k}": (recall(k) > 0).cast("double"), f"ndcg_at_{k}": ndcg(ranking, relevant, k)}
    out["gold_rank"] = F.coalesce(first_hit(ranking, relevant), F.lit(0)).cast("double")
    if selected:
        names = list(set_scores(F.col(selected), F.array(F.lit(""))))
        key = ("exact_set_match", "f1", "jaccard")
        scored = F.transform(F.filter("alternatives", lambda a: F.size(a) > 0), lambda a, i: F.struct(*(set_scores(F.col(selected), a)[k].alias(f"_{k}") for k in key), (-i).alias("i"), *(v.alias(k) for k, v in set_scores(F.col(selected), a).items())))
        best = F.array_max(scored)
        none = {k: F.lit(0.0) for k in names} | {"over_selection": F.size(F.array_distinct(F.col(selected))).cast("double")}
        out |= {k: F.when(F.coalesce(best["_f1"], F.lit(0.0)) > 0, best[k]).otherwise(none[k]) for k in names}
    return df.select(*df.columns, *(v.alias(k) for k, v in out.items()))


def expansion_scores(ranking: Column, gold: Column) -> dict[str, Column]:
    """One gold id: hit at 1 and recall at 5 and 10."""
    at = F.array_position(ranking, gold)
    return {f"{n}_at_{k}": ((at > 0) & (at <= k)).cast("double") for n, k in (("hit", 1), ("recall", 5), ("recall", 10))}


def mean_by(df: DataFrame, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """Means by each dimension alone and over all rows, as grouping sets in one pass."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = df.groupingSets(sets, *map(F.col, dimensions))
    return grouped.agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def macro_micro(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """micro: the mean over rows; macro: the mean of the groups' means."""
    by = df.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))
    weigh = [F.round(F.sum(F.col(m) * F.col("n")) / F.sum("n"), 6).alias(f"micro_{m}") for m in metrics]
    return by.agg(*weigh, *(F.round(F.avg(m), 6).alias(f"macro_{m}") for m in metrics))
