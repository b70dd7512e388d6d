"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skeinlab.llm.common import Scratch, with_prefix


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), order: tuple[Column, ...] = ()) -> DataFrame:
    """Cut documents, in order of the columns `order` and then of `id_col`, into `n_shards` contiguous shards of near-equal bytes.

    Sizes are UTF-8 bytes plus one. Per-partition totals give every row its global byte offset; a row
    goes to the shard that its middle byte falls in, so shard sizes differ by at most the largest row.
    Returns id, size, text_crc32, `keep` columns, shard and slot (gapless from 0 in each shard).

    Null text has no bytes (size 1) and the CRC of the empty text; null ids sort first; equal ids are
    ordered by size and CRC, so repeated rows each get a slot; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col), *[F.col(k) for k in keep], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[c.alias(f"_order{k}") for k, c in enumerate(order)])
    by = [*[F.col(f"_order{k}").asc() for k in range(len(order))], F.col(id_col).asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    rows = with_prefix(Scratch(docs.sparkSession), thin, by, "size", "shards")
    rows = rows.withColumn("shard", F.least(F.expr(f"((_before * 2 + size) * {n_shards}) div (_total * 2)"), F.lit(n_shards - 1)).cast("int"))
    first = rows.groupBy("shard").agg(F.min("_index").alias("_first"))  # n_shards rows
    return rows.join(F.broadcast(first), "shard").select(id_col, *keep, "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"))
