"""State at a time, differences between snapshots and versions, gaps-and-islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from skeinlab.operators import ordered


def at_time(history: DataFrame, edges: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Symbols whose first version is at or before a time, and the edges among them."""
    s = history.groupBy("symbol_id").agg(F.min("created_us").alias("first")).filter(F.col("first") <= at).select("symbol_id")
    e = edges.join(s.select(F.col("symbol_id").alias("source_id")), "source_id", "left_semi").join(s.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi")
    return s, e


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """added / removed / updated / same keys between two snapshots."""
    j = before.select(key, F.col(content).alias("_b"), F.lit(1).alias("_x")).join(after.select(key, F.col(content).alias("_a"), F.lit(1).alias("_y")), key, "full")
    return j.select(key, F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "updated").otherwise("same").alias("change"))


def field_diff(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Names of the fields of two maps that were added, removed and changed, each sorted."""
    b, a = F.col(before), F.col(after)
    both = F.array_intersect(F.map_keys(b), F.map_keys(a))
    return pairs.withColumns({
        "fields_added": F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b))),
        "fields_removed": F.array_sort(F.array_except(F.map_keys(b), F.map_keys(a))),
        "fields_changed": F.array_sort(F.filter(both, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))),
    })


def sessions(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Quiet-period sessions: a row later than `gap` after the one before opens the next."""
    w = W.partitionBy(key).orderBy(at)
    s = events.withColumn("_new", (F.col(at) - F.lag(at).over(w) > gap).cast("int")).withColumn("session", F.sum(F.coalesce("_new", F.lit(1))).over(w))
    return s.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n"))


def fail_streaks(status: DataFrame, key: str, order: list[str], threshold: int = 2) -> DataFrame:
    """Streak of failures at each row: a pass resets it, an ambiguous row keeps it; a failure at the threshold is a violation."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    s = status.withColumn("_run", F.sum((F.col("status") == "pass").cast("int")).over(w))
    run = W.partitionBy(key, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("streak", F.sum((F.col("status") == "fail").cast("int")).over(run))
    return s.withColumn("violation", (F.col("status") == "fail") & (F.col("streak") >= threshold)).drop("_run")


def merge_ranges(ranges: DataFrame, key: str, start: str, end: str, gap: int) -> DataFrame:
    """Ranges no more than `gap` apart merged."""
    w = W.partitionBy(key).orderBy(start, end)
    r = ranges.withColumn("_e", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    r = r.withColumn("_g", F.sum((F.col("_e").isNull() | (F.col(start) > F.col("_e") + gap)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("_g")


def quiet_points(events: DataFrame, at: str, quiet: int, by: str | None = None) -> DataFrame:
    """Events after which nothing comes for `quiet` or longer: there a debounced action fires. The last one fires, too."""
    if by:
        followed = events.withColumn("_later", F.lead(at).over(W.partitionBy(by).orderBy(at)))
    else:  # rows of one time are told apart by what they hold
        followed = ordered.next_value(events, [at, F.xxhash64(*events.columns)], at, "_later")
    return followed.filter(F.col("_later").isNull() | (F.col("_later") - F.col(at) >= quiet)).drop("_later")


def held_back(files: DataFrame, git: DataFrame, at: str, quiet: int, by: str) -> DataFrame:
    """File events with `held`: whether a git event of the same `by` is pending, that is, came less than `quiet` before."""
    both = files.select(by, at, "path", F.lit(1).alias("_side")).unionByName(git.select(by, at, F.lit(None).cast("string").alias("path"), F.lit(0).alias("_side")))
    last = F.max(F.when(F.col("_side") == 0, F.col(at))).over(W.partitionBy(by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("held", F.coalesce(F.col(at) - last < quiet, F.lit(False))).filter("_side = 1").drop("_side")
