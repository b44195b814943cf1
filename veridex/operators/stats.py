"""Agreement, intervals, percentiles, distributions and fitted cut-offs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions.text import candidate_bucket

#: The normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a proportion; nothing observed gives (0, 0)."""
    p = successes / total
    denominator = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / denominator
    margin = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / denominator
    none = total <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + margin))


def agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """n, raw agreement and Cohen's kappa of two label columns (no rows: 0; certain agreement by chance: 1 or 0)."""
    a, b = F.col(left).cast("string"), F.col(right).cast("string")
    cells = df.select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("k"))
    total = cells.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("k")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col("a").alias("label")).agg(F.sum("k").alias("x"))
    columns = cells.groupBy(F.col("b").alias("label")).agg(F.sum("k").alias("y"))
    chance = rows.join(columns, "label").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    n, po, pe = F.col("n"), F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    both = total.join(chance, F.lit(True))  # one row each
    kappa = F.when(n.isNull(), 0.0).when(pe == 1.0, F.when(po == 1.0, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return both.select(F.coalesce(n, F.lit(0)).alias("n"), F.round(F.coalesce(po, F.lit(0.0)), 6).alias("raw_agreement"), F.round(kappa, 6).alias("kappa"))


def detector_report(df: DataFrame, truth: str, flagged: str) -> DataFrame:
    """Agreement, missed and false flags, recall and capture of a detector against review decisions (0/1 columns)."""
    t, f = F.col(truth) == 1, F.col(flagged) == 1
    n = lambda c: F.count_if(c)
    return df.agg(
        F.count("*").alias("n"),
        F.round(F.avg((t == f).cast("double")), 6).alias("agreement"),
        n(t & ~f).alias("dangerous_keeps"),
        n(~t & f).alias("over_conservative"),
        F.round(F.try_divide(n(t & f), n(t)), 6).alias("recall"),
        F.round(F.try_divide(n(t & f), n(f)), 6).alias("capture_precision"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def smallest_mode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals."""
    return df.groupBy(*group).agg(F.mode(F.col(value), True).alias("mode"))


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles that are observed values: the one at ceil(p * n)."""
    exact = [F.expr(f"percentile_disc({p}) within group (order by {value})").alias(name) for name, p in shares.items()]
    return df.groupBy(*group).agg(F.count("*").alias("n"), *exact, F.max(value).alias("worst"))


def distribution_distance(df: DataFrame, part: str, label: str) -> DataFrame:
    """For each part, the sum over labels of |share in the part - share in all rows|."""
    cells = df.groupBy(part, label).agg(F.count("*").alias("k"))
    whole = cells.groupBy(label).agg(F.sum("k").alias("all_k"))
    totals = cells.groupBy(part).agg(F.sum("k").alias("part_n"))
    n = whole.agg(F.sum("all_k").alias("n"))
    grid = totals.join(whole, F.lit(True)).join(n, F.lit(True))  # parts x labels, both few
    filled = grid.join(cells, [part, label], "left")
    return filled.groupBy(part).agg(F.round(F.sum(F.abs(F.coalesce("k", F.lit(0)) / F.col("part_n") - F.col("all_k") / F.col("n"))), 6).alias("l1"))


def random_mrr(n: Column, m: Column) -> Column:
    """The expected reciprocal rank of the first of m relevant entries in a random order of n.

    Sum over r of C(n-r, m-1) / C(n, m) / r; each term follows from the one before.
    """
    first = F.struct((m / n).alias("p"), (m / n).alias("s"))
    step = lambda acc, r: F.struct((acc["p"] * (n - r - m + 2) / (n - r + 1)).alias("p"), (acc["s"] + acc["p"] * (n - r - m + 2) / (n - r + 1) / r).alias("s"))
    more = F.when(n - m + 1 >= 2, F.sequence(F.lit(2), (n - m + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when((m > 0) & (m <= n), F.aggregate(more, first, step)["s"])


def bootstrap_interval(df: DataFrame, value: str, group: list[str], repetitions: int = 500, seed: int = 20260806) -> DataFrame:
    """A 95 % bootstrap interval of each group's mean.

    Row i of repetition r weighs as a Poisson(1) draw that a hash of (seed, r, row)
    fixes, so resamples need no shuffle of rows and come out the same everywhere:
    u is the first 52 bits of the SHA-256 of seed, r and row. Sums are partly
    aggregated before they are shuffled, so what moves is repetitions times groups.
    """
    u = (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("_id").cast("string")), 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]  # Poisson(1) distribution function
    weight = sum((F.when(F.col("u") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("u", u).withColumn("w", weight)
    means = rows.groupBy(*group, "r").agg((F.sum(F.col("w") * F.col(value)) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    at = lambda q: F.array_sort(F.collect_list("m"))[int(q * (repetitions - 1))]
    bounds = means.groupBy(*group).agg(at(0.025).alias("low"), at(0.975).alias("high"), F.count("*").alias("repetitions"))
    return bounds.join(df.groupBy(*group).agg(F.avg(value).alias("mean")), group) if group else bounds


def bootstrap_by_values(df: DataFrame, value: str, group: list[str], repetitions: int = 500, seed: int = 20260806, level: float = 0.95) -> DataFrame:
    """A bootstrap interval of each group's mean from its distinct values, in time that grows with the rows once and not with every repetition.

    Rows are counted by group and value first. In a repetition, a value that c rows
    have is drawn Poisson(c) times, as the sum of c rows that weigh Poisson(1) each;
    a mean is taken over what was drawn. Draws depend on the seed, the group and
    the value alone, so results are the same for every partitioning. What moves is
    groups x repetitions for each batch. Repetitions that draw nothing, as small
    groups have, count out. Null and NaN values are left out, a group
    without others has no row.
    """
    name = F.to_json(F.struct(*(F.col(f"`{g}`") for g in group))) if group else F.lit("")
    x = F.col(f"`{value}`").cast("double")
    counts = df.select(name.alias("_g"), x.alias("_x")).where("_x is not null and not isnan(_x)").groupBy("_g", "_x").agg(F.count("*").alias("_c"))
    keyed = counts.withColumn("_key", F.xxhash64(F.lit(seed), "_g", "_x"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, rows in frame.groupby("_g"):
                drawn, total = np.zeros(repetitions), np.zeros(repetitions)
                for key, v, c in zip(rows["_key"], rows["_x"], rows["_c"], strict=True):
                    w = np.random.Generator(np.random.Philox(key=int(key) & ((1 << 64) - 1))).poisson(c, repetitions)
                    drawn += w
                    total += w * v
                yield pd.DataFrame({"_g": g, "r": np.arange(repetitions), "w": drawn, "s": total})

    sums = keyed.mapInPandas(draw, "_g string, r long, w double, s double").groupBy("_g", "r").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    bounds = sums.where("m is not null").groupBy("_g").agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("b"), F.count("*").alias("repetitions"))
    means = counts.groupBy("_g").agg((F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("mean"), F.sum("_c").alias("n"))
    named = df.select(name.alias("_g"), *(F.col(f"`{g}`") for g in group)).dropDuplicates(["_g"])
    out = bounds.join(means, "_g").join(named, "_g")
    return out.select(*(F.col(f"`{g}`") for g in group), F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), "repetitions", "mean", "n")


def fit_cardinality(df: DataFrame, max_k: int = 20, least_rows: int = 5, fixed: str | None = None) -> DataFrame:
    """The number of entries to select for each task type and candidate bucket.

    df: task_type, ranking, alternatives. Single-answer tasks take one; a stratum
    of at least `least_rows` takes the K of best mean F1 (smallest on a tie), any
    other the usual gold size of its task. With `fixed` only that task type takes
    one, and with least_rows=1 no stratum falls back: the other dialect.
    """
    rows = df.withColumn("alternatives", F.filter("alternatives", lambda a: F.size(a) > 0)).where("size(alternatives) > 0")
    rows = rows.withColumns({"bucket": candidate_bucket(F.size("ranking")), "gold_n": F.array_max(F.transform("alternatives", F.size))})
    fallback = rows.groupBy("task_type").agg(F.mode("gold_n", True).alias("usual"))
    size = rows.groupBy("task_type", "bucket").agg(F.count("*").alias("n"), F.max(F.size("ranking")).alias("most"))
    at_k = rows.join(size, ["task_type", "bucket"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_k), F.col("most")))))
    top = F.slice("ranking", F.lit(1), F.col("k"))
    f1 = F.array_max(F.transform("alternatives", lambda a: 2.0 * F.size(F.array_intersect(a, top)) / (F.size(top) + F.size(F.array_distinct(a)))))
    means = at_k.withColumn("f1", f1).groupBy("task_type", "bucket", "k").agg(F.round(F.avg("f1"), 12).alias("f1"))
    best = means.groupBy("task_type", "bucket").agg(F.max_by(F.struct("k", "f1"), F.struct("f1", -F.col("k"))).alias("b"))
    out = size.join(best, ["task_type", "bucket"]).join(fallback, "task_type")
    single = F.col("task_type").startswith("single_") if fixed is None else F.col("task_type") == fixed
    enough = F.col("n") >= least_rows
    return out.select(
        "task_type", "bucket", "n",
        F.when(single, 1).when(enough, F.col("b.k")).otherwise(F.col("usual")).cast("int").alias("selected_k"),
        F.when(single, 1.0).when(enough, F.round("b.f1", 6)).alias("mean_f1"),
        F.when(single, "single_task_fixed_1").when(enough, "f1_optimized_topk").otherwise("task_modal_gold_cardinality").alias("rule"),
    )


def select_global_k(means: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50), share: float = 0.95) -> DataFrame:
    """The smallest K that keeps `share` of recall and completeness at the largest K; one row of means in."""
    last = ks[-1]
    enough = [F.when((F.col(f"recall_at_{k}") >= share * F.col(f"recall_at_{last}")) & (F.col(f"completeness_at_{k}") >= share * F.col(f"completeness_at_{last}")), k) for k in ks]
    return means.select(F.coalesce(*enough, F.lit(last)).alias("selected_k"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def mrr_gate(observed: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether the mean reciprocal rank of random rankings is as near to its analytical value as it must be. Both sides have one column `mrr`."""
    a, b = observed.agg(F.avg("mrr").alias("observed")), expected.agg(F.avg("mrr").alias("expected"))
    off = F.abs(F.col("observed") - F.col("expected"))
    return a.join(b, F.lit(True)).select("observed", "expected", F.coalesce(off <= tolerance, F.lit(False)).alias("passed"))


def mean_of_shared(rows: DataFrame, row_id: str, name: str, value: str) -> DataFrame:
    """(name, mean) of the metrics that every row has; others are left out."""
    n = rows.agg(F.count_distinct(row_id).alias("_n"))
    by = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(name).agg(F.count_distinct(row_id).alias("_k"), F.avg(value).alias("mean"))
    return by.join(F.broadcast(n), F.lit(True)).where("_k = _n").select(name, "mean")
