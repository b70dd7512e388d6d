"""Work along a global order without one task for all rows: range partitions, and one row of totals for each of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from skeinlab.session import cut


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows dealt out by ranges of the order, with the number of their range, `_part`; ranges follow each other."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def with_sums(df: DataFrame, order: list[Column | str], **values: Column) -> DataFrame:
    """Adds _index (number of earlier rows) and, for each value, the sum of it over earlier rows as before_<name>.

    The order has to tell all rows apart. Each range sums its own rows; the totals of the ranges, one row for each,
    give what comes before it.
    """
    values = {"_index": F.lit(1).cast("long"), **values}
    rows = in_ranges(df.withColumns({f"_v{k}": v for k, v in enumerate(values.values())}), *order)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(*[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(values))])
    over = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t{k}").over(over), F.lit(0)).alias(f"_o{k}") for k in range(len(values))])
    out = rows.withColumns({f"_b{k}": F.coalesce(F.sum(f"_v{k}").over(inside), F.lit(0)) for k in range(len(values))}).join(F.broadcast(totals), "_part")
    names = [n if n == "_index" else f"before_{n}" for n in values]
    return out.select(*df.columns, *[(F.col(f"_b{k}") + F.col(f"_o{k}")).alias(n) for k, n in enumerate(names)])


def at_index(df: DataFrame, order: list[Column | str], index: Column) -> DataFrame:
    """The rows at a place that is an expression of `_n`, the number of rows."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return with_sums(df, order).join(F.broadcast(n)).filter(F.col("_index") == index).drop("_index", "_n")


def next_value(df: DataFrame, order: list[Column | str], value: str, into: str) -> DataFrame:
    """Adds the value of the row that follows in the order; null for the last one."""
    rows = cut(with_sums(df, order))
    later = rows.select((F.col("_index") - 1).alias("_index"), F.col(value).alias(into))
    return rows.join(later, "_index", "left").drop("_index")


def first_rows(df: DataFrame, key: list[str], order: list[str], k: int, spread: int = 16) -> DataFrame:
    """The first k rows of each key with their `place` from 1; keys are dealt out, so that no key's rows meet before they are k for each part."""
    part = W.partitionBy(*key, "_salt").orderBy(*order)
    few = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(spread))).withColumn("place", F.row_number().over(part)).filter(F.col("place") <= k)
    return few.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= k).drop("_salt")


def smoothed(df: DataFrame, order: str, value: str, alpha: float, into: str) -> DataFrame:
    """Adds s, where s is the value itself in the first row and then s * (1 - alpha) + value * alpha.

    A range of rows takes what came before it to a multiple of it plus a sum of its own. Ranges are folded alone,
    then the ranges' own two numbers one after the other, and each row adds its share of what came before.
    """
    rows = in_ranges(df, order)
    schema = T.StructType([*rows.schema.fields, T.StructField("_own", T.DoubleType()), T.StructField("_keep", T.DoubleType())])

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        own, s = np.empty(len(p)), 0.0
        for k, x in enumerate(p[value].to_numpy(float)):
            s = s * (1 - alpha) + x * alpha
            own[k] = s
        return p.assign(_own=own, _keep=(1 - alpha) ** np.arange(1, len(p) + 1))

    rows = cut(rows.groupBy("_part").applyInPandas(fold, schema))
    ends = rows.groupBy("_part").agg(F.max_by("_own", F.struct(-F.col("_keep"), F.col(order))).alias("own"), F.min("_keep").alias("keep"), F.min_by(value, order).cast("double").alias("first"))
    every = ends.agg(F.array_sort(F.collect_list(F.struct("_part", "own", "keep", "first"))).alias("e"))  # one entry for each range
    start = F.struct(F.array().cast("array<struct<_part:int,_before:double>>").alias("out"), F.get("e", F.lit(0))["first"].alias("s"))
    step = lambda a, x: F.struct(F.array_append(a["out"], F.struct(x["_part"].alias("_part"), a["s"].alias("_before"))).alias("out"), (a["s"] * x["keep"] + x["own"]).alias("s"))
    before = every.select(F.inline(F.aggregate("e", start, step, lambda a: a["out"])))
    return rows.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_own") + F.col("_keep") * F.col("_before")).alias(into))
