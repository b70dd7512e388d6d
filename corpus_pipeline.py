"""A training corpus from raw documents: filter, de-duplicate, decontaminate, mix, shard.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs; all but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlab.llm import decontaminate, mixing, neardup, quality, sharding
from skeinlab.llm.common import Scratch, bounded_broadcast, partitions, table, with_row_ids

N_SHARDS = 8


def _without(rows: DataFrame, uids: DataFrame, name: str) -> DataFrame:
    """Rows whose uid is not among `uids`."""
    gone = Scratch(rows.sparkSession).cut(uids.select(F.col("uid").alias("gone")).distinct(), name)
    return rows.join(bounded_broadcast(gone), rows["uid"] == gone["gone"], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep.

    Null and empty texts fail the base rules; repeated rows are judged alike; a null language or source is a
    group of its own; further columns of any name go through; an empty table gives no rows.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang", "source")
    return quality.quality_outliers(packed, carry=("row",)).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each near-duplicate component (5-word shingles, similarity 0.8).

    Rows without an id, or that share one, are compared on their own texts and yield to a row with an id of
    its own; of equal rows one stays. Texts without words are linked with nothing and all stay, but for
    equal rows without an id of their own. Further columns of any name go through; an empty table gives no rows.
    """
    rows, odd = with_row_ids(docs)
    found = neardup.row_components(rows.select("uid", "text"))
    kept = _without(rows, found.filter("uid <> component"), "near-copies")
    return (kept.dropDuplicates(["uid"]) if odd else kept).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Each row is judged on its own text, whatever its id; null and empty texts stay; repeated rows go or stay
    together; further columns of any name go through; an empty table or benchmark is well.
    """
    rows, _ = with_row_ids(docs)
    return _without(rows, decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="uid"), "contaminated").select("row.*")


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Rows are told apart by two 64-bit hashes of all columns; identical rows are planned each and their copies
    add up. Null and empty texts have no words and are never taken; ties in position are in order of the
    hashes; the null source is a source of its own; further columns of any name go through; an empty table
    gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64(row).alias("key_a"), F.xxhash64(F.lit(7), row).alias("key_b"), "text", "source")
    key = ["key_a", "key_b"]
    plan = mixing.curriculum_plan(keyed, keys=tuple(key))
    plan = Scratch(spark).cut(plan.filter("size(positions) > 0").groupBy(*key).agg(F.flatten(F.collect_list("positions")).alias("positions"), F.count(F.lit(1)).alias("many")), "plan-rows")
    # Rows that are repeated would each bring all positions: of equal rows one stays.
    many = plan.filter("many > 1").limit(1).count()
    once = keyed.select("row", *key).join(bounded_broadcast(plan), key)
    once = once.dropDuplicates(key) if many else once
    copies = once.select("row", *key, F.explode("positions").alias("training_position"))
    return copies.repartitionByRange(partitions(spark), "training_position").sortWithinPartitions("training_position", *key).select("row.*")


def byte_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining row, whole, with its size, text_crc32, shard and slot, in the order in which the rows were written.

    That order is by file number, file and row. Null texts have one byte; repeated rows each get a slot;
    columns of the names added here are replaced; an empty table gives no rows.
    """
    name = F.col("_metadata.file_name")
    written = (F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), "doc_id", "text", *[c.alias(f"written_{k}") for k, c in enumerate(written)])
    out = sharding.shard_by_bytes(packed, N_SHARDS, keep=("row",), order=tuple(F.col(f"written_{k}") for k in range(3)))
    added = ("size", "text_crc32", "shard", "slot")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing_weights", mixing_weights),
    ("byte_shards", byte_shards),
]
#: The stages are iterative or probabilistic and have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result but the last written to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Scratch(spark).cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
