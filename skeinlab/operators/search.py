"""Search: lexical, exact vector top-k, reciprocal rank fusion and federated ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlab.functions import exprs as X


def lexical(df: DataFrame, query: str, columns: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows whose columns hold the query as a substring in any case; no relevance, ordered by `order`; rank from 1."""
    q = query.lower()
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(q) for c in columns])
    top = df.filter(hit).orderBy(*order).limit(max(1, min(limit, 100)))
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def lexical_terms(df: DataFrame, query: str, columns: list[str], order: list[Column], limit: int) -> DataFrame:
    """Rows that hold any term of the query in any of the columns."""
    import re

    terms = [t for t in dict.fromkeys(re.split(r"[^a-z0-9_/-]+", query.lower())) if t]
    if not terms:
        return df.limit(0)
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(t) for t in terms for c in columns])
    return df.filter(hit).orderBy(*order).limit(limit)


def vector_topk(vectors: DataFrame, query: list[float], k: int, min_score: float | Column | None = None) -> DataFrame:
    """Exact cosine top-k; zero and mismatched vectors are skipped; ties by id. One partial top-k in each partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.withColumn("score", X.cosine(F.col("embedding"), q)).filter("score IS NOT NULL")
    out = out if min_score is None else out.filter(F.col("score") >= min_score)
    return out.orderBy(F.col("score").desc(), "id").limit(k)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds rank from 1. For lists already cut to a top-k."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def fuse(lists: list[DataFrame], k: float = X.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists of (id, rank)."""
    every = reduce(DataFrame.unionByName, [x.select("id", "rank") for x in lists])
    return every.groupBy("id").agg(F.sum(X.rrf(F.col("rank"), k)).alias("rrf"))


def sparse(symbols: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """Symbols by number of keywords met, best match class, best rank; words has one column, token."""
    w = F.broadcast(words.limit(8))
    hit = F.lower(F.concat_ws("\n", "qualified_name", "file_path", "kind")).contains(F.col("token"))
    m = symbols.join(w, hit).withColumn("cls", X.sparse_match(F.col("qualified_name"), F.col("file_path"), F.col("kind"), F.col("token")))
    by = W.partitionBy("token").orderBy("qualified_name", "id")
    m = m.withColumn("r", F.row_number().over(by))
    out = m.groupBy("id", "qualified_name", "file_path").agg(F.countDistinct("token").alias("n_tokens"), F.min("cls").alias("cls"), F.min("r").alias("best"))
    return out.orderBy(F.col("n_tokens").desc(), "cls", "best", "qualified_name", "file_path", "id").limit(limit)


def federated(sources: dict[str, DataFrame], now_ms: int, limit: int) -> DataFrame:
    """Second fusion over ranked lists of (id, rank, accesses, last_ms): boosted and divided by the larger of 1 and the top."""
    parts = [df.select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), "rank", "accesses", "last_ms") for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy("source", "id").agg(F.sum(X.rrf(F.col("rank"))).alias("base"), F.max("accesses").alias("accesses"), F.max("last_ms").alias("last_ms"))
    out = out.withColumn("boosted", X.recency_access_boost(F.col("base"), F.col("accesses"), F.col("last_ms"), F.lit(now_ms)))
    top = out.agg(F.greatest(F.max("boosted"), F.lit(1.0)).alias("top"))
    return out.join(F.broadcast(top), F.lit(True)).select("source", "id", (F.col("boosted") / F.col("top")).alias("score")).orderBy(F.col("score").desc(), "source", "id").limit(limit)


def rerank(fused: DataFrame, scores: DataFrame, window: int, limit: int) -> DataFrame:
    """The first `window` of a fused list by new scores, the rest in fused order. Both lists are top-k sized."""
    w = max(1, min(window, 200))
    pos = ranked(fused, F.col("rrf").desc(), F.col("id"))
    out = pos.join(scores.select("id", "new_score"), "id", "left")
    first = (F.col("rank") <= w) & F.col("new_score").isNotNull()
    order = [F.when(first, 0).otherwise(1), F.when(first, -F.col("new_score")), F.col("rank"), F.col("id")]
    return out.withColumn("final_rank", F.row_number().over(W.orderBy(*order)).cast("long")).filter(F.col("final_rank") <= limit).select("id", "rrf", "final_rank")


def thresholds(manual: DataFrame | None, calibrated: DataFrame, languages: DataFrame, default: float) -> DataFrame:
    """Per language: manual before calibrated before default."""
    out = languages.join(F.broadcast(calibrated.select("language", F.col("threshold").alias("c"))), "language", "left")
    m = F.lit(None).cast("double")
    if manual is not None:
        out, m = out.join(F.broadcast(manual.select("language", F.col("threshold").alias("m"))), "language", "left"), F.col("m")
    return out.select("language", F.coalesce(m, F.col("c"), F.lit(default)).alias("threshold"))
