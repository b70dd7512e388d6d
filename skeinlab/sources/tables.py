"""Merges by key, replaced partitions, chunked JSONL requests and results, integrity checks."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

_MANIFEST = "commit string, attempt string, at long, tables array<string>"


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], order: str, keep: list[str] = ()) -> DataFrame:
    """Upsert: the newest row of each key; `keep` columns take the greatest value seen (counters survive updates)."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys)
    for c in keep:
        both = both.withColumn(c, F.max(c).over(w))
    return both.withColumn("_r", F.row_number().over(w.orderBy(F.col(order).desc(), F.col("_new").desc()))).filter("_r = 1").drop("_r", "_new")


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that `df` holds."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(by).mode("overwrite").parquet(path)


def write_snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    replace_partition(df.withColumn("snapshot_id", F.lit(snapshot_id)), path, "snapshot_id")


def latest_rows(df: DataFrame, at: str) -> DataFrame:
    """Rows of the latest run."""
    top = df.agg(F.max(at).alias("_m"))
    return df.join(F.broadcast(top), F.col(at) == F.col("_m"), "left_semi")


def pending_requests(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates (id, prompt_hash) whose hash is new."""
    return candidates.join(done.select("id", "prompt_hash"), ["id", "prompt_hash"], "left_anti")


def write_requests(df: DataFrame, path: str, chunk: int) -> None:
    """JSONL request files of at most `chunk` lines."""
    df.write.option("maxRecordsPerFile", chunk).mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of JSONL results."""
    raw = spark.read.text(path).filter(F.btrim("value") != "")
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = raw.select("value", row.alias("r"))
    return parsed.filter("r._bad IS NULL").select("r.*").drop("_bad"), parsed.filter("r._bad IS NOT NULL").select("value")


def fsck(symbols: DataFrame, records: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): rows of each table that lack their counterpart, by anti-joins on id."""
    def count(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")

    return (
        count("record_without_symbol", records.join(symbols, "id", "left_anti"))
        .unionByName(count("symbol_without_record", symbols.join(records, "id", "left_anti")))
        .unionByName(count("vector_without_record", vectors.join(records, "id", "left_anti")))
        .unionByName(count("record_without_vector", records.join(vectors, "id", "left_anti")))
        .unionByName(count("edge_without_source", edges.join(symbols, edges["source_id"] == symbols["id"], "left_anti")))
        .unionByName(count("edge_without_target", edges.join(symbols, edges["target_id"] == symbols["id"], "left_anti")))
    )


def consume(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(oldest n requests, the rest)."""
    head = queue.orderBy("requested_at", "id").limit(n)
    return head, queue.join(head.select("id"), "id", "left_anti")


def coalesce_blob(main: Column, mirror: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(main), F.lit("")), mirror)


def write_staged(tables: dict[str, DataFrame], root: str, commit: str) -> None:
    """Several tables as one commit: each attempt writes to folders of its own, and one line of the manifest then names it.

    Readers (`read_committed`) take the latest attempt of each commit that the manifest names, so an attempt that
    fails leaves all as it was, whether the commit is new or written again, and attempts never share a file.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = f"a{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/tables/{name}/attempt={attempt}")
    line = spark.createDataFrame([(commit, attempt, time.time_ns(), sorted(tables))], _MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(commit, attempt, at, tables) of the latest attempt of each commit."""
    lines = spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    return lines.groupBy("commit").agg(F.max(F.struct("at", "attempt", "tables")).alias("_m")).select("commit", "_m.attempt", "_m.at", "_m.tables")


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """All rows of a table from the commits that are done, with their `commit`; none if there are none.

    Attempts are partitions of the table and are joined to the manifest; nothing of either comes to the driver.
    """
    done = manifest(spark, root).filter(F.array_contains("tables", name)).select("commit", "attempt")
    if done.isEmpty():
        return None
    return spark.read.parquet(f"{root}/tables/{name}").join(done, "attempt").drop("attempt")


def copy_missing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The target with those rows of the source whose keys it lacks: a one-off copy that may run again."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def migrate(df: DataFrame, version: int, steps: list) -> tuple[DataFrame, int]:
    """A table after the steps (functions of a DataFrame) beyond its version, and the version that it then has."""
    for step in steps[version:]:
        df = step(df)
    return df, max(version, len(steps))


def apply_changes(symbols: DataFrame, edges: DataFrame, changed: DataFrame, new_edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges after one change of files: removed ids go with the edges they are the source of, changed symbols
    replace what they were, and their edges are replaced by the new ones."""
    touched = changed.select("id").unionByName(removed.select("id")).distinct()
    kept = symbols.join(touched, "id", "left_anti").unionByName(changed)
    links = edges.join(touched.select(F.col("id").alias("source_id")), "source_id", "left_anti").unionByName(new_edges)
    return kept, links


def change_records(before: DataFrame, after: DataFrame, trigger: str, at: int, similarity: Column) -> DataFrame:
    """One fingerprint row for each symbol whose prompt hash is new: delta of meaning and what caused it.

    before and after: (id, prompt_hash, source_hash, neighbor_hash, config_hash, embedding).
    """
    b = before.select("id", *[F.col(c).alias(f"old_{c}") for c in ("prompt_hash", "source_hash", "neighbor_hash", "config_hash", "embedding")])
    j = after.join(b, "id", "left").filter(~F.col("prompt_hash").eqNullSafe(F.col("old_prompt_hash")))
    moved = lambda c: (~F.col(c).eqNullSafe(F.col(f"old_{c}"))).alias(c.replace("_hash", "_changed"))
    return j.select("id", F.col("old_prompt_hash").alias("previous_prompt_hash"), "prompt_hash", F.lit(trigger).alias("trigger"), F.lit(at).alias("at"), (F.lit(1.0) - similarity).alias("delta_sem"), *[moved(c) for c in ("source_hash", "neighbor_hash", "config_hash")])
