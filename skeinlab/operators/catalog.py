"""Lookups by id, name, path and time; notes, intents and queues; left joins that show what lacks a record."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def for_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among `ids` (one column of the same name). A semi join: Spark broadcasts a short list by itself."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def by_name(symbols: DataFrame, name: str, first: bool = False) -> DataFrame:
    """Symbols of one qualified name in order of path and id; with `first`, one row at most."""
    out = symbols.filter(F.col("qualified_name") == name).orderBy("file_path", "id")
    return out.limit(1) if first else out


def module_files(symbols: DataFrame, module: str, language: str) -> DataFrame:
    """Distinct paths of a language that are the module's path or lie below it, sorted."""
    path = F.col("file_path")
    return symbols.filter((F.col("language") == language) & ((path == module) | path.startswith(f"{module}/"))).select("file_path").distinct().orderBy("file_path")


def newest(df: DataFrame, at: str, limit: int, key: str = "id") -> DataFrame:
    """The newest rows, ties by greater key."""
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(max(1, limit))


def notes(df: DataFrame, limit: int, since_ms: int | None = None, archived: bool = False, file_ref: str | None = None, tags: list[str] = ()) -> DataFrame:
    """Notes, newest first: not archived unless asked for, since a time, that refer to a file, that have all of the tags."""
    out = df if archived else df.filter("NOT is_archived")
    out = out.filter(F.col("created_at") >= since_ms) if since_ms is not None else out
    out = out.filter(F.array_contains("file_refs", file_ref)) if file_ref is not None else out
    out = out.filter(has_all(F.col("tags"), tags)) if tags else out
    return newest(out, "created_at", limit)


def has_all(tags: Column, wanted: list[str]) -> Column:
    """Whether all wanted tags are among `tags`; nothing wanted is always there."""
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]).cast("array<string>"), tags)) == 0


def with_record(left: DataFrame, records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All rows of `left` with the columns of their record, if any, and whether they have one."""
    r = records.select(key, *columns, F.lit(True).alias("has_record"))
    return left.join(r, key, "left").withColumn("has_record", F.coalesce("has_record", F.lit(False)))


def at_version(history: DataFrame, version: int, key: str = "symbol_id") -> DataFrame:
    return history.filter(F.col("version") == version)


def at_time(history: DataFrame, at: int, time: str, key: str = "symbol_id") -> DataFrame:
    """Each key's last version up to a time."""
    struct = F.struct(*[F.col(c) for c in history.columns if c != key])
    return history.filter(F.col(time) <= at).groupBy(key).agg(F.max_by(struct, F.struct(time, "version")).alias("_v")).select(key, "_v.*")


def latest_change(history: DataFrame, inside: Column, key: str = "symbol_id") -> DataFrame:
    """Each key's latest version, but the first, that lies inside a window."""
    first = F.min("version").over(W.partitionBy(key))
    found = history.withColumn("_inside", inside).withColumn("_first", first).filter("_inside AND version > _first")
    return found.groupBy(key).agg(F.max("version").alias("version"))


def file_log(commits: DataFrame, path, limit: int) -> DataFrame:
    """Commits (commit, at) that touch a file, newest first."""
    return newest(commits.filter(F.col("file") == path).select("commit", "at"), "at", limit, "commit")


def commit_files(commits: DataFrame, commit, excluded: Column | None = None) -> DataFrame:
    """Distinct files of a commit, but those excluded."""
    out = commits.filter(F.col("commit") == commit)
    out = out.filter(~excluded) if excluded is not None else out
    return out.select("file").distinct()


def changed_between(old: DataFrame, new: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Paths that two snapshots do not share, or whose contents differ."""
    j = old.select(path, F.col(content).alias("_a"), F.lit(True).alias("_old")).join(new.select(path, F.col(content).alias("_b"), F.lit(True).alias("_new")), path, "full")
    return j.filter(F.col("_old").isNull() | F.col("_new").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).select(path)


def restore_keys(results: DataFrame, keymap: DataFrame) -> DataFrame:
    """Results with their full keys; keys that the map does not shorten stay as they are."""
    m = keymap.select(F.col("short").alias("key"), "full_key")
    return results.join(m, "key", "left").withColumn("key", F.coalesce("full_key", "key")).drop("full_key")


# States of a write intent in order; the last two end it.
INTENT_STATES = ("pending", "sqlite_done", "vector_done", "graph_done", "complete", "failed")


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def incomplete_intents(intents: DataFrame, failed_too: bool = False) -> DataFrame:
    """Intents that have not ended, oldest first; on request those that failed, too."""
    ended = ["complete"] if failed_too else ["complete", "failed"]
    return intents.filter(~F.col("status").isin(ended)).orderBy("created_at", "intent_id")


def next_status(status: Column) -> Column:
    """The state after this one; a failed intent starts anew, a complete one stays."""
    out = F.when(status == "failed", "pending").when(status == "complete", "complete")
    for a, b in zip(INTENT_STATES, INTENT_STATES[1:-1], strict=False):
        out = out.when(status == a, b)
    return out


def replay_intents(intents: DataFrame, failed_too: bool = False, batch: int = 100) -> DataFrame:
    """Oldest incomplete intents of a batch with the state that replaying them leads to next."""
    return incomplete_intents(intents, failed_too).limit(batch).withColumn("next_status", next_status(F.col("status")))


def update_status(intents: DataFrame, updates: DataFrame, now_ms: int) -> DataFrame:
    """Intents after updates (intent_id, status); the end of an intent sets its time of completion."""
    u = updates.select("intent_id", F.col("status").alias("_to"))
    out = intents.join(u, "intent_id", "left").withColumn("status", F.coalesce("_to", "status"))
    done = F.when(F.col("_to").isin("complete", "failed"), F.lit(now_ms)).otherwise(F.col("completed_at"))
    return out.withColumn("completed_at", done).drop("_to")


def pop(queue: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """(the n rows of highest score, first come first, and the rest) of (id, score, seq)."""
    head = queue.orderBy(F.col("score").desc(), "seq").limit(n)
    return head, queue.join(head.select("id"), "id", "left_anti")


def structural_events(symbols: DataFrame, at: str, since: int | None = None, limit: int = 50) -> DataFrame:
    """Files by their newest symbol: (file_path, n, latest)."""
    out = symbols.filter(F.col(at) >= since) if since is not None else symbols
    return out.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("latest")).orderBy(F.col("latest").desc(), "file_path").limit(limit)


def ranked_catalog(symbols: DataFrame, centrality: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Symbols by centrality, number of dependents and name, with their place."""
    n = edges.select("source_id", F.col("target_id").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("dependents"))
    out = symbols.join(centrality.select("id", "centrality"), "id", "left").join(n, "id", "left").na.fill(0, ["dependents"]).na.fill(0.0, ["centrality"])
    order = [F.col("centrality").desc(), F.col("dependents").desc(), F.col("qualified_name"), F.col("id")]
    top = out.orderBy(*order).limit(limit)  # the place is counted among these only
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


def semantic_drift(current: DataFrame, baseline: DataFrame, similarity: Column, least: float) -> DataFrame:
    """Records whose vectors (`now`, `then`) have come apart by at least `least`: (id, similarity, magnitude)."""
    j = current.join(baseline, "id").withColumn("similarity", similarity).filter("similarity IS NOT NULL")
    return j.withColumn("magnitude", F.lit(1.0) - F.col("similarity")).filter(F.col("magnitude") >= least).select("id", "similarity", "magnitude")


def cutoff(now: dt.datetime, period: str | None) -> dt.datetime:
    """Start of a period of `skeinlab.functions.specs.period`."""
    from skeinlab.functions.specs import period as seconds

    return now - dt.timedelta(seconds=seconds(period)[1])
