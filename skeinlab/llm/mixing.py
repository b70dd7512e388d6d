"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target share of the words and a weight schedule over training time. The schedule,
integrated, gives the source's cumulative demand for words; its inverse gives each document copy the
training position at which its middle word falls due, and documents are range-sorted by position.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from skeinlab.llm.common import WORD, Scratch, bounded_broadcast, partitions, with_prefix

WEIGHTS = (5.0, 2.0, 1.0)
#: Relative rate of each weight class at equally spaced training times: heavy sources lead, light ones follow.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Targets by source from (source, source_size): shares of all words by weight, stopped at `most` times the size.

    Handing the excess on by weight until no source is above its stop ends at one level L with target =
    min(stop, L * weight); in order of stop / weight the stopped sources come first, so running sums give L.
    Works on one row for each source.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("_ratio", "_rank")
    every = W.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", w).withColumn("_stop", F.col("source_size") * float(most))
    t = t.withColumn("_ratio", F.col("_stop") / F.col("_w"))
    t = t.withColumn("_level", (F.sum("source_size").over(every) - (F.sum("_stop").over(by_ratio) - F.col("_stop"))) / (F.sum("_w").over(every) - (F.sum("_w").over(by_ratio) - F.col("_w"))))
    t = t.withColumn("_open", F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_rank", "_level")))
    t = t.withColumn("_level", F.coalesce(F.min("_open").over(every)["_level"], F.lit(float("inf"))))
    target = F.when(F.col("_level") >= F.col("_ratio"), F.col("_stop")).otherwise(F.col("_level") * F.col("_w"))
    return t.select("source", "source_size", F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int").alias("weight_class"), target.alias("target"))


def _extra_copies(most: int):
    """Fold of a source's size histogram, largest first: how many rows of each size get one more copy.

    The wanted fraction of each size is taken, rounded, and what that leaves over or overdraws is carried
    to the next smaller size, so all sizes are represented alike and the words taken end near the target.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        full = min(most, int(target // total)) if total else 1
        rest = target - full * total
        part = rest / total if total and full < most else 0.0
        carry, out = 0.0, []
        for size, n in zip(rows["size"], rows["n"], strict=True):
            carry += part * size * n
            k = max(0, min(int(n), int(carry / size + 0.5))) if size else 0
            carry -= k * size
            out.append(k)
        return pd.DataFrame({"source": rows["source"], "size": rows["size"], "full": full, "extra": out})

    return fold


def demand_position(words: Column, target: Column, weight_class: Column, schedules=SCHEDULES) -> Column:
    """Training time in [0, 1] at which a source's cumulative demand reaches `words` of `target`.

    A schedule is piecewise linear between equally spaced times; its integral is quadratic on each piece
    and is inverted there in closed form.
    """
    share = F.when(target > 0, F.least(words / target, F.lit(1.0))).otherwise(F.lit(0.0))
    out = F.lit(None).cast("double")
    for c, rates in enumerate(schedules):
        h = 1.0 / (len(rates) - 1)
        areas = [(a + b) / 2 * h for a, b in zip(rates, rates[1:], strict=False)]
        total, at, mine = sum(areas), 0.0, F.lit(1.0)
        for k in reversed(range(len(areas))):
            lo, a, slope = sum(areas[:k]), rates[k], (rates[k + 1] - rates[k]) / h
            y = F.greatest(share * total - lo, F.lit(0.0))
            x = y / a if slope == 0 else (y * 2) / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + y * (2 * slope), F.lit(0.0))))
            piece = F.least(F.lit(k * h) + x, F.lit(1.0))
            mine = piece if k == len(areas) - 1 else F.when(share * total < lo + areas[k], piece).otherwise(mine)
            at = lo
        out = F.when(weight_class == c, mine).otherwise(out)
    return out


def curriculum_plan(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), weights=WEIGHTS, schedules=SCHEDULES, most: int = MOST_REPEATS, seed: int = 17, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: keys, source, size, source_size, target, taken, copies, positions (array, ascending).

    Null text has size 0 and is never taken; the null source is a source of its own, last; repeated rows
    count each; an empty table gives no rows. Reruns agree: choices depend on keys and text sizes only.
    No document is taken more than `most` times.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    thin = docs.select(
        F.struct(*keys).alias("_key"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), *[F.col("_key")[k] for k in keys]))
    name = F.col("source").asc_nulls_last()
    rows = with_prefix(scratch, thin, [name, F.col("size").asc(), F.col("_h").asc(), F.col("_key").asc()], "size", "sizes")
    counts = scratch.cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.min("_index").alias("_first")), "counts")
    targets = scratch.cut(source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "targets")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    few = bounded_broadcast(targets)
    hist = counts.join(few, same(counts, targets, "source")).select(counts["source"], "size", "n", "source_size", "target")
    extra = hist.groupBy("source").applyInPandas(_extra_copies(most), "source string, size long, full int, extra long")
    extra = scratch.cut(extra, "extra")
    n_sizes = extra.count()
    sized = bounded_broadcast(extra, n_sizes)
    firsts = bounded_broadcast(counts.select("source", "size", "_first"), n_sizes)
    rows = rows.join(sized, same(rows, extra, "source", "size")).select(*[rows[c] for c in ("_key", "source", "size", "_h", "_index")], "full", "extra")
    rows = rows.join(firsts, same(rows, counts, "source", "size")).select(*[rows[c] for c in ("_key", "source", "size", "_h", "_index", "full", "extra")], "_first")
    copies = (F.col("full") + F.when(F.col("_index") - F.col("_first") < F.col("extra"), 1).otherwise(0)).cast("int")
    plan = scratch.cut(rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).drop("full", "extra", "_first"), "plan")
    each = plan.filter("copies > 0").select("source", "size", "_index", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_epoch"), "_h").withColumnRenamed("_index", "_row")
    each = each.withColumn("_h", F.xxhash64("_h", "_epoch"))
    queue = with_prefix(scratch, each, [name, F.col("_epoch").asc(), F.col("_h").asc(), F.col("_row").asc()], "size", "queue")
    starts = queue.groupBy("source").agg(F.min("_before").alias("_start"), F.sum("size").alias("_taken"))
    starts = scratch.cut(starts.join(few, same(starts, targets, "source")).select(starts["source"], "_start", "_taken", "weight_class"), "starts")
    queue = queue.join(bounded_broadcast(starts), same(queue, starts, "source")).select(
        "_row", demand_position(F.col("_before") - F.col("_start") + F.col("size") / 2, F.col("_taken"), F.col("weight_class"), schedules).alias("_at")
    )
    due = queue.groupBy("_row").agg(F.array_sort(F.collect_list("_at")).alias("positions"))  # at most `most` each
    out = plan.join(due, plan["_index"] == due["_row"], "left")
    return out.join(few, same(out, targets, "source")).select(
        *[out["_key"][k].alias(k) for k in keys], out["source"], "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", F.coalesce("positions", F.array().cast("array<double>")).alias("positions"),
    )


def training_order(plan: DataFrame) -> DataFrame:
    """One row for each taken copy, range-sorted by training position."""
    out = plan.select("*", F.explode("positions").alias("position")).drop("positions")
    return out.repartitionByRange(partitions(plan.sparkSession), "position").sortWithinPartitions("position")
