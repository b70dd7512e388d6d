"""Recall of notes and ranking of candidates: fused ranks, raised by recent use; symbols for a task by graph and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from skeinlab.functions import exprs as X
from skeinlab.operators import graph, search
from skeinlab.session import store


def _ranked(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("score").desc(), F.col("id").cast("string")).limit(limit)


def boosted(df: DataFrame, base: str, now_ms: int) -> DataFrame:
    """score: `base` raised by recent and frequent use (accesses, last_ms)."""
    return df.withColumn("score", X.recency_access_boost(F.col(base), F.col("accesses"), F.col("last_ms"), F.lit(now_ms)))


def rank_candidates(lexical: DataFrame, semantic: DataFrame, facts: DataFrame, now_ms: int, prefix: str, limit: int) -> DataFrame:
    """Fused and boosted candidates (key, id, score) of two lists of (id, rank); facts has accesses and last_ms by id."""
    out = boosted(search.fuse([lexical, semantic]).join(facts.select("id", "accesses", "last_ms"), "id"), "rrf", now_ms)
    out = out.withColumn("key", F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string")))
    return out.orderBy(F.col("score").desc(), "key").limit(limit).select("key", "id", "score")


def rank_tests(rows: DataFrame) -> DataFrame:
    """Test intents by their rank alone: (key, id, score)."""
    return rows.select(F.concat(F.lit("test:"), F.col("id").cast("string")).alias("key"), "id", X.rrf(F.col("rank")).alias("score"))


def rank_coupled(coupling: DataFrame, symbols: DataFrame, seeds: int = 10) -> DataFrame:
    """Files coupled to the files of the first `seeds` symbols (rank, file): the strongest link of each, strongest first."""
    files = symbols.orderBy("rank").limit(seeds).select(F.col("file").alias("anchor")).distinct()
    both = coupling.select(F.col("file_a").alias("anchor"), F.col("file_b").alias("file"), "fused_score").unionByName(coupling.select(F.col("file_b").alias("anchor"), F.col("file_a").alias("file"), "fused_score"))
    near = both.join(F.broadcast(files), "anchor")  # at most `seeds` rows
    best = near.groupBy("file").agg(F.max(X.clamp(F.col("fused_score"))).alias("score"), F.min_by("anchor", F.struct(-F.col("fused_score"), F.col("anchor"))).alias("anchor"))
    return best.orderBy(F.col("score").desc(), "file")


def recall(lexical: DataFrame, semantic: DataFrame | None, facts: DataFrame, mode: str, now_ms: int, limit: int) -> tuple[DataFrame, str]:
    """(notes (id, score), mode used). lexical: (id, rank); semantic: (id, rank, similarity), or none.

    Without semantic candidates, and in lexical mode, ranks of the lexical list count; in semantic mode similarities;
    in hybrid mode both ranks, fused. All are raised by recent and frequent use.
    """
    limit = max(1, min(limit, 100))
    used = mode if mode != "lexical" and semantic is not None and semantic.limit(1).count() else "lexical"
    if used == "lexical":
        base = lexical.select("id", X.rrf(F.col("rank")).alias("base"))
    elif used == "semantic":
        base = semantic.select("id", F.col("similarity").alias("base"))
    else:
        base = search.fuse([lexical, semantic.select("id", "rank")]).withColumnRenamed("rrf", "base")
    out = boosted(base.join(facts.select("id", "accesses", "last_ms"), "id"), "base", now_ms)
    return _ranked(out.select("id", "score"), limit), used


def task_symbols(dense: DataFrame, sparse: DataFrame, edges: DataFrame, branch: DataFrame | None = None, top_k: int = 20, beta: float = 0.6, alpha: float = 0.15, iterations: int = 20) -> DataFrame:
    """(id, score): beta of the fused rank and the rest of the PageRank personalised to the first `top_k` and the branch's symbols.

    The fused lists and the scores are written once: seeds, scores and the order of the result do not search again.
    """
    rrf = store(search.fuse([dense, sparse]))
    seeds = rrf.orderBy(F.col("rrf").desc(), "id").limit(max(1, top_k)).select("id")
    seeds = seeds if branch is None else seeds.unionByName(branch.select("id")).distinct()
    ppr = graph.personalized_pagerank(edges, seeds, alpha, iterations)
    out = rrf.join(ppr, "id", "full").select("id", (F.coalesce("rrf", F.lit(0.0)) * beta + F.coalesce("rank", F.lit(0.0)) * (1 - beta)).alias("score"))
    return store(out.filter("score > 0")).orderBy(F.col("score").desc(), "id")


def prepared_order(items: DataFrame, relevance, text: str, *ties: str) -> DataFrame:
    """Items by how often the task's terms occur in them, ties by text and then by further columns."""
    return items.withColumn("relevance", relevance).orderBy(F.col("relevance").desc(), text, *ties)


def within_groups(df: DataFrame, group: str, order: list, name: str = "place") -> DataFrame:
    """Place of each row in its group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long"))
