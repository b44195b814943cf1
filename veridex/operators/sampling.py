"""Deterministic samples: by hash, by stratum, in turns, by quota, evenly spread, diverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(seed), *(F.col(c).cast("string") for c in columns)), 256)


def stratified_reservoir(rows: DataFrame, strata: list[str], row_id: str, k: int, seed: str) -> DataFrame:
    """The k rows of smallest hash in every stratum."""
    order = Window.partitionBy(*strata).orderBy(hash_key(seed, row_id), row_id)
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def round_robin(rows: DataFrame, stratum: str, row_id: str, k: int, seed: str) -> DataFrame:
    """k rows, one of each stratum in turn (strata by name, rows by hash), with their position."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_key(seed, stratum, row_id), row_id))
    picked = rows.withColumn("turn", turn).where(F.col("turn") <= k).orderBy("turn", stratum).limit(k)
    return picked.withColumn("position", F.row_number().over(Window.orderBy("turn", stratum)))


def quotas(counts: DataFrame, group: str, limit: int) -> DataFrame:
    """Largest-remainder shares of `limit`; all rows where there are no more than that. counts: group, n."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    raw = F.col("n") * limit / total
    base = counts.withColumns({"total": total, "raw": raw}).withColumn("floor", F.floor("raw"))
    left = limit - F.sum("floor").over(Window.partitionBy(F.lit(1)))
    order = Window.orderBy(F.desc(F.round(F.col("raw") - F.col("floor"), 12)), F.desc("n"), group)
    dealt = base.withColumns({"left": left, "r": F.row_number().over(order)})
    share = F.when(F.col("total") <= limit, F.col("n")).otherwise(F.col("floor") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0))
    return dealt.select(group, "n", share.cast("long").alias("quota"))


def proportional_sample(rows: DataFrame, group: str, row_id: str, limit: int, seed: str) -> DataFrame:
    share = quotas(rows.groupBy(group).agg(F.count("*").alias("n")), group, limit).select(group, "quota")
    order = Window.partitionBy(group).orderBy(hash_key(seed, row_id), row_id)
    return rows.withColumn("r", F.row_number().over(order)).join(share, group).where("r <= quota").drop("r", "quota")


def spread_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n evenly spaced rows of each group in order: positions i * (len - 1) / (n - 1), half to even."""
    w = Window.partitionBy(group)
    placed = rows.withColumns({"at": F.row_number().over(w.orderBy(order)) - 1, "len": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("len") - 1) / F.lit(max(n - 1, 1)), 0).cast("int"))
    return placed.where((F.col("len") <= n) | F.array_contains(wanted, F.col("at"))).drop("at", "len")


def qa_sample(rows: DataFrame, row_id: str, stratum: str, risk: str, seed: str, n_random: int = 70, n_turns: int = 20, n_risk: int = 10) -> DataFrame:
    """Three parts without overlap: random rows, then strata in turn, then the riskiest; all rows where there are fewer."""
    h = hash_key(seed, row_id)
    first = rows.orderBy(h, row_id).limit(n_random).withColumn("part", F.lit("random"))
    rest = rows.join(first.select(row_id), row_id, "left_anti")
    second = round_robin(rest, stratum, row_id, n_turns, seed).drop("turn", "position").withColumn("part", F.lit("round_robin"))
    rest = rest.join(second.select(row_id), row_id, "left_anti")
    third = rest.orderBy(F.desc(risk), row_id).limit(n_risk).withColumn("part", F.lit("risk"))
    return first.unionByName(second).unionByName(third)


def smoke_sample(rows: DataFrame, strata: list[str], row_id: str, k: int, seed: str) -> DataFrame:
    """One row of each stratum by hash, then by hash alone until there are k."""
    own = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_key(seed, row_id), row_id))
    return rows.withColumn("tier", F.when(own == 1, 0).otherwise(1)).orderBy("tier", hash_key(seed, row_id), row_id).limit(k).drop("tier")


def choose_diverse(rows: DataFrame, must: dict[str, Column], key: str, order: str, k: int) -> DataFrame:
    """Mandatory predicates first (the first row of each), then the first row of each key, then in order. `order` tells rows apart."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first"))
    flagged = rows.join(firsts.select(F.col("_first").alias(order), F.lit(1).alias("_key")), order, "left")
    tier = F.when(F.col("_key") == 1, 1).otherwise(2)
    if must:  # one partially aggregated row: the first of every predicate
        least = rows.agg(F.array_compact(F.array(*(F.min(F.when(c, F.col(order))) for c in must.values()))).alias("_must"))
        flagged = flagged.join(F.broadcast(least), F.lit(True))
        tier = F.when(F.array_contains("_must", F.col(order)), 0).otherwise(tier)
    return flagged.withColumn("tier", tier).orderBy("tier", order).limit(k).drop("_key", "_must")


def balanced_sample(rows: DataFrame, bucket: str, dedupe: str, order: str, quota: dict[str, int], total: int) -> DataFrame:
    """Bucket quotas over rows with distinct signatures, then backfill in order."""
    firsts = rows.groupBy(dedupe).agg(F.min(order).alias(order))  # the first row of each signature, partly aggregated; `order` tells rows apart
    distinct = rows.join(firsts.select(order), order, "left_semi")
    share = F.coalesce(F.create_map(*(x for k, v in quota.items() for x in (F.lit(k), F.lit(v))))[F.col(bucket)], F.lit(0))
    head = distinct.withColumn("r", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).where(F.col("r") <= max(quota.values(), default=0)).where(F.col("r") <= share)  # the first bound is a number, so that tasks keep their first rows only before they meet
    ahead = head.select(order, F.lit(0).alias("tier"))
    return distinct.join(F.broadcast(ahead), order, "left").withColumn("tier", F.coalesce("tier", F.lit(1))).orderBy("tier", order).limit(total)


def category_sample(rows: DataFrame, categories: dict[str, Column], row_id: str, k: int, seed: str) -> DataFrame:
    """k rows of each category; a row belongs to the first category that holds."""
    name = F.lit(None).cast("string")
    for label, cond in reversed(list(categories.items())):
        name = F.when(F.coalesce(cond, F.lit(False)), label).otherwise(name)
    return stratified_reservoir(rows.withColumn("category", name).where("category is not null"), ["category"], row_id, k, seed)


def challenge_candidates(evidence: DataFrame, need: int, methods: list[str]) -> DataFrame:
    """Candidates drawn from the methods' ranked lists in turn until `need` are there.

    evidence: query_id, candidate_id, method, rank, score. Lists go by (rank, -score,
    id); a candidate stands where its first turn comes, turns by place then method order.
    """
    place = F.row_number().over(Window.partitionBy("query_id", "method").orderBy("rank", F.desc("score"), "candidate_id"))
    turn = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    best = evidence.withColumn("place", place).groupBy("query_id", "candidate_id").agg(F.min(F.struct(F.col("place"), turn.alias("turn"))).alias("t"))
    order = Window.partitionBy("query_id").orderBy("t.place", "t.turn", "candidate_id")
    drawn = best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= need)
    have = F.count("*").over(Window.partitionBy("query_id"))
    return drawn.select("query_id", "candidate_id", "position", F.when(have < need, "INSUFFICIENT_MACHINE_CANDIDATES").otherwise("READY").alias("status"))


def hashed_pools(rows: DataFrame, pools: dict[str, int], pool: str, row_id: str, seed: str) -> DataFrame:
    """The rows of smallest hash in every pool, at most max(30 t, t + 100) for a pool of target t: a reserve to choose from."""
    cap = F.create_map(*(F.lit(x) for k, t in pools.items() for x in (k, max(30 * t, t + 100) if t > 0 else 0)))
    order = Window.partitionBy(pool).orderBy(hash_key(seed, pool, row_id), row_id)
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= F.coalesce(cap[F.col(pool)], F.lit(0)))


def cover_duplicates(chosen: DataFrame, pool: DataFrame, row_id: str, group: str, position: str, least: int, seed: str) -> DataFrame:
    """The chosen rows, the last of them without a duplicate group replaced by duplicates of the pool until `least` have one.

    chosen has `position`; both sides have row_id and group (null: no duplicate).
    Replacements come by hash and take over the position.
    """
    have = chosen.agg(F.count(group).alias("have"))
    back = chosen.where(F.col(group).isNull()).orderBy(F.desc(position)).limit(least)
    back = back.withColumn("r", F.row_number().over(Window.orderBy(F.desc(position)))).join(F.broadcast(have), F.lit(True)).where(F.col("r") <= least - F.col("have"))
    spare = pool.where(F.col(group).isNotNull()).join(chosen.select(row_id), row_id, "left_anti").orderBy(hash_key(seed, group, row_id), row_id).limit(least)
    spare = spare.withColumn("r", F.row_number().over(Window.orderBy(hash_key(seed, group, row_id), row_id)))
    swapped = back.select("r", position, F.col(row_id).alias("_out")).join(spare, "r")
    kept = chosen.join(swapped.select(F.col("_out").alias(row_id)), row_id, "left_anti").select(row_id, group, position, F.lit(False).alias("replaced"))
    return kept.unionByName(swapped.select(row_id, group, position, F.lit(True).alias("replaced")))


def secondary_sample(chosen: DataFrame, task: str, row_id: str, counts: dict[str, int], default: int, seed: str) -> DataFrame:
    """Rows of each task that a second reader sees as well: by hash, a number for every task."""
    want = F.coalesce(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))[F.col(task)], F.lit(default))
    order = Window.partitionBy(task).orderBy(hash_key(seed, row_id), row_id)
    return chosen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= want).drop("r")


def challenge_set(tasks: DataFrame, evidence: DataFrame, catalog: DataFrame, methods: list[str], target: int, seed: int) -> DataFrame:
    """Tasks of a machine challenge in order, main ones before reserves, with their state.

    tasks: task_id, position (main before reserve), alternatives (arrays of accepted
    ids); evidence: query_id, candidate_id, method, rank, score; catalog:
    candidate_id. A task has max(10, accepted ids + largest alternative) candidates:
    the accepted ones and others drawn from the methods' lists in turn, shuffled by
    hash. Accepted ids outside of the catalog or too little evidence drop it, and the
    next in order steps in. Returns task_id, position, candidates, status (READY,
    GOLD_NOT_IN_CATALOG, INSUFFICIENT_MACHINE_CANDIDATES) and used.
    """
    gold = tasks.select("task_id", "position", F.array_distinct(F.flatten("alternatives")).alias("gold"), F.coalesce(F.array_max(F.transform("alternatives", F.size)), F.lit(0)).alias("largest"))
    each = gold.select("task_id", F.explode("gold").alias("candidate_id"))
    lost = each.join(catalog, "candidate_id", "left_anti").select("task_id").distinct().withColumn("lost", F.lit(True))
    size = F.greatest(F.lit(10), F.size("gold") + F.col("largest"))
    known = evidence.join(catalog, "candidate_id", "left_semi").join(each.withColumnRenamed("task_id", "query_id"), ["query_id", "candidate_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id", "method").orderBy("rank", F.desc("score"), "candidate_id"))
    turn = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    best = known.withColumn("place", place).groupBy("query_id", "candidate_id").agg(F.min(F.struct(F.col("place"), turn.alias("turn"))).alias("t"))
    drawn = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("t.place", "t.turn", "candidate_id")))
    need = gold.select(F.col("task_id").alias("query_id"), (size - F.size("gold")).alias("need"))
    chosen = drawn.join(need, "query_id").where("r <= need").groupBy(F.col("query_id").alias("task_id")).agg(F.collect_list("candidate_id").alias("more"))
    rows = gold.join(lost, "task_id", "left").join(chosen, "task_id", "left").withColumn("more", F.coalesce("more", F.array().cast(evidence.schema["candidate_id"].dataType.simpleString().join(["array<", ">"]))))
    status = F.when(F.col("lost"), "GOLD_NOT_IN_CATALOG").when(F.size("gold") + F.size("more") < size, "INSUFFICIENT_MACHINE_CANDIDATES").otherwise("READY")
    mixed = F.transform(F.array_sort(F.transform(F.concat("gold", "more"), lambda c: F.struct(F.sha2(F.concat_ws("\u0001", F.lit(str(seed)), F.col("task_id").cast("string"), c.cast("string")), 256).alias("h"), c.alias("c")))), lambda s: s["c"])
    rows = rows.select("task_id", "position", status.alias("status"), F.when(status == "READY", mixed).alias("candidates"))
    ready = rows.where("status = 'READY'").orderBy("position", "task_id").limit(target).select("task_id", F.lit(True).alias("used"))
    return rows.join(ready, "task_id", "left").select("task_id", "position", "candidates", "status", F.coalesce("used", F.lit(False)).alias("used"))
