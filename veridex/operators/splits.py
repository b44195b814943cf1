"""Identity groups and group-aware train/dev/test splits with audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions.text import present
from veridex.operators.graph import connected_components

RATIOS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def identity_edges(rows: DataFrame, row_id: str, tokens: dict[str, Column], parent: str | None = None) -> DataFrame:
    """(u, v): each row with the first row that shares one of its identity tokens; a parent reference links rows that exist.

    A token counts inside its name only, so equal ids of different sources don't link unless the column says so.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), present(c).alias("token")) for k, c in tokens.items()))
    each = rows.select(row_id, F.explode(pairs).alias("p")).select(row_id, "p.*").where("token is not null").distinct()
    star = each.groupBy("kind", "token").agg(F.min(row_id).alias("v"), F.count("*").alias("k")).where("k > 1")
    edges = each.join(star, ["kind", "token"]).select(F.col(row_id).alias("u"), "v").where("u != v")
    if parent:
        known = rows.select(F.col(row_id).alias("v"))
        edges = edges.unionByName(rows.select(F.col(row_id).alias("u"), F.col(parent).alias("v")).where("v is not null").join(known, "v", "left_semi").select("u", "v"))
    return edges.distinct()


def identity_groups(rows: DataFrame, row_id: str, tokens: dict[str, Column], parent: str | None = None) -> DataFrame:
    """row_id and group: the smallest row reachable over shared tokens."""
    found = connected_components(identity_edges(rows, row_id, tokens, parent))
    return rows.select(row_id).join(found.withColumnRenamed("node", row_id), row_id, "left").select(row_id, F.coalesce("component", F.col(row_id)).alias("group"))


def group_hash(groups: DataFrame, row_id: str) -> DataFrame:
    """A stable id of each group: the hash of its sorted members, taken from per-member hashes so that no group is gathered."""
    digest = groups.groupBy("group").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64(F.col(row_id))).alias("x"), F.sum(F.xxhash64(F.col(row_id)).cast("decimal(38,0)")).alias("s"))
    return digest.select("group", "members", F.concat(F.lit("split::component::"), F.substring(F.sha2(F.concat_ws(":", "members", "x", "s"), 256), 1, 24)).alias("group_id"))


def assign_groups(profiles: DataFrame, ratios: dict[str, float] = RATIOS, seed: int = 20260719) -> DataFrame:
    """Whole groups to splits, balanced inside every stratum. profiles: group, stratum (with the group's size class), n.

    In a stratum, groups are ranked by hash and dealt by golden-ratio steps,
    which fill every split at its ratio after any number of groups. Ranks are
    counted inside 4,096 ranges of the hash, after the groups of earlier ranges, so
    that a large stratum is sorted in parts.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("group").cast("string")), 256)
    hashed = profiles.withColumn("_h", digest).withColumn("_part", F.substring("_h", 1, 3))
    parts = hashed.groupBy("stratum", "_part").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy("stratum").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("stratum", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("stratum", "_part").orderBy("_h", "group"))
    place = F.expr("(rank * 0.6180339887498949D) % 1")
    dealt = hashed.join(parts, ["stratum", "_part"]).withColumn("rank", inside + F.col("_before")).withColumn("u", place)
    split, high = F.lit(None).cast("string"), 0.0
    for name, ratio in ratios.items():
        high += ratio
        split = F.when(split.isNull() & (F.col("u") < high), name).otherwise(split)
    return dealt.select("group", "stratum", "n", F.coalesce(split, F.lit(list(ratios)[-1])).alias("split"))


def split_audit(rows: DataFrame, split: str, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """Rows, share and distance from the target for each split."""
    totals = rows.groupBy(split).agg(F.count("*").alias("n"))
    n = F.sum("n").over(Window.partitionBy(F.lit(1)))
    target = F.create_map(*(x for k, v in ratios.items() for x in (F.lit(k), F.lit(v))))
    return totals.select(split, "n", F.round(F.col("n") / n, 6).alias("share"), F.round(F.col("n") / n - F.coalesce(target[F.col(split)], F.lit(0.0)), 6).alias("off_target"))


def constraint_rows(rows: DataFrame, split: str, group: str, labels: list[str], tolerance: float = 0.05) -> DataFrame:
    """(constraint, passed, observed) of hard split rules: one split a group, every split has rows, labels reach every split, shares near the target."""
    one = rows.groupBy(group).agg(F.count_distinct(split).alias("k")).agg(F.count_if(F.col("k") > 1).alias("bad")).select(F.lit("group_in_one_split").alias("constraint"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("double").alias("observed"))
    there = rows.agg(F.count_distinct(split).alias("k")).select(F.lit("all_splits_present").alias("constraint"), (F.col("k") == 3).alias("passed"), F.col("k").cast("double").alias("observed"))
    near = split_audit(rows, split).agg(F.max(F.abs("off_target")).alias("x")).select(F.lit("shares_near_target").alias("constraint"), (F.col("x") <= tolerance).alias("passed"), F.round("x", 6).alias("observed"))
    out = one.unionByName(there).unionByName(near)
    for label in labels:
        lost = rows.groupBy(label).agg(F.count_distinct(split).alias("k")).agg(F.count_if(F.col("k") < 3).alias("bad"))
        out = out.unionByName(lost.select(F.lit(f"label_in_all_splits:{label}").alias("constraint"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("double").alias("observed")))
    return out


def hard_constraints(
    rows: DataFrame, targets: dict[str, int], original: DataFrame, identities: list[str], edges: DataFrame, small: int = 20, least: int = 20, cell_least: int = 5, large: int = 1000, dominance: tuple[float, float] = (0.15, 0.7),
    ratio_tolerance: float = 0.05, relaxed: float = 0.0,
) -> DataFrame:
    """(constraint, passed, observed) for H01 to H15 of a finished assignment; observed counts violations, or is the measured number.

    rows: row_id, group, split, task, source, cell (task and source), content (a
    fingerprint) and the columns of `identities`. original: row_id and content
    before the assignment. edges: (u, v, source), the relations that groups come
    from. H01 groups in several splits; H03 identity tokens in several splits; H04
    edges between splits; H05 contents in several splits; H12 rows whose content
    isn't the original; H14 ids that are new, gone or repeated, and rows without a
    known split; H15 edges that leave their source. A constraint about tasks or
    cells looks at every one of them. `small` and `large` are least numbers of
    groups and rows for a minimum and for a ratio to be asked; `relaxed` is the
    share that sizes may be off. Null contents and tokens say nothing.
    """
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("split").isNull() | ~F.col("split").isin(*targets)).alias("odd"), *(F.count_if(F.col("split") == s).alias(s) for s in targets))
    torn_of = lambda key, df=rows: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("k"))
    groups = torn_of("group").agg(F.count_if(F.col("k") > 1).alias("torn"))
    contents = torn_of("content").agg(F.count_if(F.col("k") > 1).alias("copies"))
    tokens = rows.select("split", F.explode(F.array(*(F.when(present(F.col(f)).isNotNull(), F.struct(F.lit(f).alias("field"), present(F.col(f)).alias("value"))) for f in identities))).alias("token"))
    tokens = torn_of("token", tokens).agg(F.count_if(F.col("k") > 1).alias("shared"))
    end = lambda side: rows.select(F.col("row_id").alias(side), F.col("split").alias(f"split_{side}"), F.col("source").alias(f"source_{side}"))
    related = edges.select("u", "v", F.col("source").alias("own")).join(end("u"), "u").join(end("v"), "v")
    related = related.agg(F.count_if(F.col("split_u") != F.col("split_v")).alias("cut"), F.count_if((F.col("source_u") != F.col("source_v")) | (F.col("source_u") != F.col("own"))).alias("foreign"))
    ids = rows.groupBy("row_id").agg(F.count("*").alias("now"), F.min("content").alias("low"), F.max("content").alias("high")).join(original.groupBy("row_id").agg(F.count("*").alias("then"), F.min("content").alias("was")), "row_id", "full")
    known = lambda k: F.coalesce(k, F.lit(0))
    ids = ids.agg(F.count_if(known("now") != known("then")).alias("mutated"), F.count_if((F.col("low") != F.col("was")) | (F.col("high") != F.col("was"))).alias("edited"))
    of = lambda key: rows.groupBy(key).agg(F.count("*").alias("total"), F.count_distinct("group").alias("groups"), F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "dev").alias("dev"))
    sizes = n.select(F.col("n").alias("all"), F.col("test").alias("all_test"))
    least_of = lambda most: F.when(F.col("groups") >= small, most).otherwise(1)
    tasks = of("task").join(F.broadcast(sizes), F.lit(True)).agg(
        F.count_if(F.col("test") == 0).alias("without"), F.count_if(F.col("test") < least_of(least)).alias("few"),
        F.count_if(F.col("test") / F.greatest("all_test", F.lit(1)) > F.least(F.lit(dominance[1]), F.col("total") / F.col("all") + dominance[0]) + 1e-12).alias("dominant"),
    )
    off = lambda k: F.abs(F.col(k) / F.col("total") - F.lit(targets.get(k, 0)) / F.col("all")) > ratio_tolerance + 1e-12
    cells = of("cell").join(F.broadcast(sizes), F.lit(True)).agg(
        F.count_if((F.col("groups") >= small) & (F.col("test") < cell_least)).alias("few_cells"), F.count_if((F.col("total") >= large) & (F.col("groups") >= small) & (off("dev") | off("test"))).alias("off_cells"),
        F.count_if((F.col("total") > 0) & (F.col("test") == 0) & (F.col("groups") >= 3)).alias("lost_cells"),
    )
    one = n
    for part in (groups, contents, tokens, related, ids, tasks, cells):
        one = one.join(part, F.lit(True))  # each is a single row
    miss = lambda k: F.abs(F.col(k) - targets[k]) > max(1, int(targets[k] * relaxed)) if relaxed else F.col(k) != targets[k]
    bad = lambda *names: (sum((F.col(k) for k in names), F.lit(0)) == 0, sum((F.col(k) for k in names), F.lit(0)))
    checks = {
        "H01_group_unsplit": bad("torn"), "H02_tasks_in_test": bad("without"), "H03_identity_group_overlap": bad("shared"), "H04_relationship_conflicts": bad("cut"), "H05_content_duplicate_conflicts": bad("copies"),
        "H06_test_size": (~miss("test"), F.col("test")), "H07_dev_size": (~miss("dev"), F.col("dev")), "H08_task_minimum": bad("few"), "H09_source_task_minimum": bad("few_cells"), "H10_named_cell_in_test": bad("lost_cells"),
        "H11_task_dominance": bad("dominant"), "H12_content_immutable": bad("edited"), "H13_large_source_task_ratio": bad("off_cells"), "H14_no_row_mutation": bad("mutated", "odd"), "H15_source_local_edges": bad("foreign"),
    }
    each = F.array(*(F.struct(F.lit(k).alias("constraint"), passed.alias("passed"), seen.cast("double").alias("observed")) for k, (passed, seen) in checks.items()))
    return one.select(F.explode(each).alias("c")).select("c.*")


def scope_audit(rows: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """For each identity field: distinct values, values that several sources use, rows under them, and star edges before and after values are scoped by source."""
    each = rows.select(F.col(source).alias("_s"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), present(F.col(f)).alias("value")) for f in fields))).alias("x")).select("_s", "x.*").where("value is not null")
    cells = each.groupBy("field", "value", "_s").agg(F.count("*").alias("n"))
    values = cells.groupBy("field", "value").agg(F.count("*").alias("sources"), F.sum("n").alias("n"))
    return values.groupBy("field").agg(
        F.count("*").alias("distinct_values"), F.count_if(F.col("sources") > 1).alias("shared_values"), F.sum(F.when(F.col("sources") > 1, F.col("n")).otherwise(0)).alias("affected_rows"),
        F.sum(F.col("n") - 1).alias("edges_before"), F.sum(F.col("n") - F.col("sources")).alias("edges_after"),
    )


def group_profiles(rows: DataFrame, group: str, labels: dict[str, list[str]]) -> DataFrame:
    """Groups with equal count vectors together: a profile (counts of every listed label), how many groups and rows have it, and its first group."""
    counts = [F.count_if(F.col(column) == value).alias(f"{column}={value}") for column, values in labels.items() for value in values]
    vectors = rows.groupBy(group).agg(F.count("*").alias("n"), *counts)
    names = [c for c in vectors.columns if c not in (group, "n")]
    return vectors.groupBy(F.to_json(F.array(*names)).alias("profile"), "n").agg(F.count("*").alias("groups"), F.min(group).alias("first_group"))


def recommended(candidates: DataFrame) -> DataFrame:
    """The valid assignment that is best in this order: task dominance, cell, task and source distance, smallest task and cell (more is better), moved rows and groups, hash."""
    order = ["maximum_task_test_share", "cell_test_l1", "task_test_l1", "source_test_l1", F.desc("minimum_task_test_rows"), F.desc("minimum_eligible_cell_test_rows"), "moved_rows", "moved_groups", "assignment_hash"]
    return candidates.where("valid").orderBy(*order).limit(1)
