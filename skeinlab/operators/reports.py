"""Composed reports: diffs of records, coupling predictions, causes, file views, integrity scores, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlab.functions import exprs as X
from skeinlab.operators import graph, ordered


def relevance(text: Column, terms: list[str]) -> Column:
    """Number of times the task's terms of three letters or more occur in a text, in any case."""
    low, out = F.lower(text), F.lit(0)
    for t in dict.fromkeys(t.lower() for t in terms if len(t) >= 3):
        out = out + ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")
    return out


def record_diff(before: Column, after: Column) -> Column:
    """(added, removed), sorted, of two arrays."""
    return F.struct(F.array_sort(F.array_except(after, before)).alias("added"), F.array_sort(F.array_except(before, after)).alias("removed"))


def canonical_json(df: DataFrame, arrays: list[str], scalars: list[str]) -> Column:
    """JSON with sorted names and sorted arrays; equal records have equal text."""
    cols = {**{a: F.array_sort(F.col(a)) for a in arrays}, **{s: F.col(s) for s in scalars}}
    return F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]))


def community_pairs(assignments: DataFrame) -> DataFrame:
    """Unordered pairs of members of one community. For the file-sized graphs whose partitions are compared."""
    a = assignments.select(F.col("id").alias("a"), "community")
    return a.join(assignments.select(F.col("id").alias("b"), "community"), "community").filter("a < b").select("a", "b")


def partition_similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """Jaccard similarity of the pair sets of two partitions, from block counts rather than pairs; 1 if both are empty."""
    pairs = lambda n: n * (n - 1) / 2
    j = first.select("id", F.col("community").alias("x")).join(second.select("id", F.col("community").alias("y")), "id", "full")
    both = j.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("both"))
    one = first.groupBy("community").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("p"))
    two = second.groupBy("community").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("q"))
    t = both.join(one, F.lit(True)).join(two, F.lit(True))
    union = F.col("p") + F.col("q") - F.col("both")
    return t.select(F.when(union == 0, 1.0).otherwise(F.col("both") / F.nullif(union, F.lit(0.0))).alias("jaccard"))


def audit_findings(df: DataFrame, least: str | None = None, category: str | None = None, status: str | None = None, prefix: str | None = None, limit: int = 100) -> DataFrame:
    """Findings by severity, newest first; every condition is optional."""
    rank = X.severity_rank(F.col("severity"))
    out = df.withColumn("rank", rank)
    if least is not None:
        out = out.filter(F.col("rank") >= X.severity_rank(F.lit(least)))
    for name, v in (("category", category), ("status", status)):
        out = out.filter(F.col(name) == v) if v is not None else out
    out = out.filter(F.col("file_path").startswith(prefix)) if prefix is not None else out
    return out.orderBy(F.col("rank").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def git_recency(commits: DataFrame, last: int = 10) -> DataFrame:
    """(file, score): one less a tenth for each commit back, among the last ten; the newest counts."""
    c = commits.select("commit", "at").distinct().orderBy(F.col("at").desc(), F.col("commit").desc()).limit(last)
    c = c.withColumn("pos", F.row_number().over(W.orderBy(F.col("at").desc(), F.col("commit").desc())) - 1)
    return commits.join(F.broadcast(c.select("commit", "pos")), "commit").groupBy("file").agg(F.max(F.lit(1.0) - F.col("pos") / last).alias("score"))


def priority(git: Column, pagerank: Column, kind: Column, size: Column) -> Column:
    """0.4 git, 0.3 PageRank, 0.2 kind, 0.1 inverse size."""
    return git * 0.4 + pagerank * 0.3 + kind * 0.2 + size * 0.1


def coupling_predictions(edited: DataFrame, coupling: DataFrame, symbols: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, predicted): half the fused score of the strongest pair that links a symbol's file to an edited one."""
    c = coupling.filter(F.col("fused_score") >= least)
    both = c.select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), "fused_score").unionByName(c.select(F.col("file_b").alias("file"), F.col("file_a").alias("other"), "fused_score"))
    hit = both.join(edited.select("file").distinct(), "file", "left_semi").groupBy("other").agg(F.max(F.col("fused_score") * 0.5).alias("predicted"))
    return symbols.join(hit, symbols["file"] == hit["other"]).select("id", "predicted")


def causes(edges: DataFrame, changes: DataFrame, files: DataFrame, coupling: DataFrame, target, depth: int, now: int, window: int, limit: int) -> DataFrame:
    """Upstream symbols changed within the window, by recency times coupling times magnitude.

    Coupling is the fused score of the two files, or half divided by the depth.
    """
    spark = edges.sparkSession
    up = graph.k_hop(edges, spark.createDataFrame([(target,)], "id long"), depth).filter("depth > 0")
    latest = changes.filter((F.col("at") <= now) & (F.col("at") > now - window)).groupBy("id").agg(F.max_by("magnitude", F.struct("at", "magnitude")).alias("magnitude"), F.max("at").alias("at"))
    home = files.filter(F.col("id") == target).select(F.col("file").alias("target_file"))
    c = coupling.select(F.least("file_a", "file_b").alias("ca"), F.greatest("file_a", "file_b").alias("cb"), "fused_score")
    j = up.join(latest, "id").join(files, "id").join(F.broadcast(home), F.lit(True))
    j = j.join(c, (F.least("file", "target_file") == F.col("ca")) & (F.greatest("file", "target_file") == F.col("cb")), "left")
    recency = X.clamp(F.lit(1.0) - (F.lit(now) - F.col("at")) / window)
    score = recency * F.coalesce("fused_score", F.lit(0.5) / F.col("depth")) * F.col("magnitude")
    return j.select("id", "depth", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


def rings(edges: DataFrame, start: DataFrame, layers: DataFrame, depth: int, per_level: int | None = 500) -> DataFrame:
    """(depth, layer, n): dependents by distance and layer; a level shows at most `per_level`."""
    r = graph.k_hop(edges, start, depth, "in", per_level)
    return r.join(layers, "id", "left").groupBy("depth", "layer").agg(F.count(F.lit(1)).alias("n"))


def file_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, file, drift) and edges collapsed to files: greatest drift, distinct cross-file edges."""
    f = nodes.select("id", "file")
    e = edges.join(f.select(F.col("id").alias("source_id"), F.col("file").alias("source_file")), "source_id").join(f.select(F.col("id").alias("target_id"), F.col("file").alias("target_file")), "target_id")
    return nodes.groupBy("file").agg(F.max("drift").alias("drift"), F.count(F.lit(1)).alias("symbols")), e.filter("source_file <> target_file").select("source_file", "target_file").distinct()


def emerging_hubs(now: DataFrame, before: DataFrame, share: float = 0.95, growth: float = 0.2) -> DataFrame:
    """Nodes at or above the nearest-rank percentile whose score was positive before and grew by more than `growth`."""
    edge = ordered.at_index(now, ["rank", "id"], F.floor((F.col("_n") - 1) * share + 0.5)).select(F.col("rank").alias("_edge"))
    j = now.join(F.broadcast(edge), F.lit(True)).filter(F.col("rank") >= F.col("_edge")).join(before.select("id", F.col("rank").alias("previous")), "id")
    return j.filter((F.col("previous") > 0) & (F.col("rank") > F.col("previous") * (1 + growth))).select("id", "rank", "previous")


def remember(notes: DataFrame) -> DataFrame:
    """Notes merged by content: united tags, summed accesses, first and last time."""
    return notes.groupBy(X.content_key(F.col("content")).alias("content_hash")).agg(F.min("note_id").alias("note_id"), X.normalize_tags(F.flatten(F.collect_list("tags"))).alias("tags"), F.sum("accesses").alias("accesses"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def archetypes(df: DataFrame, rules: list[tuple[str, Column]], most: int = 2) -> DataFrame:
    """Adds the labels of the first rules that hold, at most `most`."""
    hits = F.array(*[F.when(c, F.lit(n)) for n, c in rules])
    return df.withColumn("archetypes", F.slice(F.filter(hits, lambda x: x.isNotNull()), 1, most))


def accumulate(git: DataFrame, drift: DataFrame) -> DataFrame:
    """Per-file signals of two sources, files of either kept."""
    return git.join(drift, "file", "full").select("file", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("drift", F.lit(0.0)).alias("drift"), F.greatest("git_at", "drift_at").alias("latest"))
