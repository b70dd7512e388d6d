"""Structured Streaming: debounced paths, contract streaks, shift velocity, change events, debounced access counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinlab.operators import aggregates
from skeinlab.sources import tables


def debounce(events: DataFrame, key: str, at: str, gap: str = "300 milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row for each key and quiet period: (key, started, ended, n), emitted when the period has closed."""
    s = F.session_window(at, gap)
    out = events.withWatermark(at, late).groupBy(key, s.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def contract_streaks(status: DataFrame, key: str, order: str, threshold: int = 2) -> DataFrame:
    """Leaky bucket with state: failures in a row, reset by a pass, held by an ambiguous row; a row for each violation."""
    kind = status.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        for df in [pd.concat(list(batches)).sort_values(order)]:
            for at, s in zip(df[order], df["status"], strict=True):
                streak = 0 if s == "pass" else streak + (s == "fail")
                if s == "fail" and streak >= threshold:
                    out.append((k[0], at, streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=[key, order, "streak"])

    okind = status.schema[order].dataType.simpleString()
    return status.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {okind}, streak long", "streak long", "append", GroupStateTimeout.NoTimeout)


def velocity_sink(path: str, weights: DataFrame, noise: float, alpha: float) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that appends each batch's shift and moving average; a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = aggregates.velocity(batch.withColumn("_b", F.lit(number)), weights, "_b", noise).first()
        shift = row["shift"] if row else 0.0
        old = spark.read.parquet(path).filter(F.col("batch") < number).orderBy(F.col("batch").desc()).first() if number else None
        now = alpha * shift + (1 - alpha) * old["velocity"] if old else shift
        out = spark.createDataFrame([(float(shift), float(now), number)], "shift double, velocity double, batch int")
        tables.replace_partition(out, path, "batch")

    return write


def change_sink(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that merges change events into a table kept as versions; readers take the newest."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = batch if number == 0 else tables.merge(spark.read.parquet(f"{path}/v={number - 1}"), batch, keys, order)
        merged.filter("NOT coalesce(deleted, false)").write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def first_accesses(events: DataFrame, key: str, at: str, within: str = "5 minutes") -> DataFrame:
    """First access of each key within the period; the rest is dropped, state included, by watermark."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def classify_head_change(branch_changed: Column, parents: Column, moved: Column) -> Column:
    """branch_switch, merge, pull or null from a change of HEAD."""
    return F.when(branch_changed, "branch_switch").when(moved & (parents > 1), "merge").when(moved, "pull")
