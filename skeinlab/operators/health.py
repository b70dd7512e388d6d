"""Health roll-ups: crates, files, scorecards, trends, difficulty, aftershocks and community confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlab.functions import exprs as X
from skeinlab.session import cut


def crate_git_signals(files: DataFrame, weights=(0.35, 0.25, 0.25, 0.15)) -> DataFrame:
    """Per crate: greatest churn and authors, mean age spread, and their weighted pressure in 0..1."""
    out = files.groupBy("crate").agg(F.max("churn_30d").alias("churn_30d"), F.max("churn_90d").alias("churn_90d"), F.max("author_count").alias("author_count"), F.avg("blame_age_spread").alias("blame_age_spread"))
    total = F.lit(0.0)
    for c, w in zip(("churn_30d", "churn_90d", "author_count", "blame_age_spread"), weights, strict=True):
        total = total + F.col(c) * w
    return out.withColumn("git_pressure", X.clamp(total))


def crate_metrics(files: DataFrame) -> DataFrame:
    """Per crate over (crate, path, loc, lines, todos, trait_methods): sums, the largest file, markers for 1,000 lines of code."""
    out = files.groupBy("crate").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("loc").alias("total_loc"), F.sum("lines").alias("total_lines"), F.max("loc").alias("max_file_loc"),
        F.min_by("path", F.struct(-F.col("loc"), F.col("path"))).alias("max_file_path"), F.max("trait_methods").alias("trait_method_max"), F.sum("todos").alias("_t"),
    )
    return out.withColumn("todo_density", F.when(F.col("total_loc") > 0, F.col("_t") * 1000.0 / F.col("total_loc")).otherwise(0.0)).drop("_t")


def top_violations(crates: DataFrame, limit: int = 5) -> DataFrame:
    """Violations of all crates (array of (metric, severity, value)) by severity, value and crate."""
    v = crates.select("crate", F.explode("violations").alias("v")).select("crate", "v.*")
    return v.orderBy(X.severity_rank(F.col("severity")).desc_nulls_last(), F.col("value").desc(), "crate", "metric").limit(limit)


def centrality_by_file(symbols: DataFrame, centrality: DataFrame) -> DataFrame:
    """(file_path, max_centrality, n_symbols), most central first."""
    j = symbols.join(centrality, "id", "left")
    return j.groupBy("file_path").agg(F.coalesce(F.max("centrality"), F.lit(0.0)).alias("max_centrality"), F.count(F.lit(1)).alias("n_symbols")).orderBy(F.col("max_centrality").desc(), "file_path")


def symbol_health(symbols: DataFrame) -> DataFrame:
    """Risk of each symbol of (id, pagerank, tests, drift, has_record, recency): three tenths centrality as a share of
    the greatest, a quarter want of tests (three are enough), a fifth drift, 0.15 no record, a tenth recency."""
    top = symbols.agg(F.max("pagerank").alias("_top"))
    share = F.when(F.col("_top") > 0, F.col("pagerank") / F.nullif("_top", F.lit(0.0))).otherwise(0.0)
    risk = share * 0.3 + (F.lit(1.0) - F.least(F.lit(1.0), F.col("tests") / 3.0)) * 0.25 + X.clamp(F.col("drift")) * 0.2 + F.when(F.col("has_record"), 0.0).otherwise(0.15) + X.clamp(F.col("recency")) * 0.1
    return symbols.join(F.broadcast(top)).select("id", X.clamp(risk).alias("risk"))


def orphans(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that are neither the source nor the target of an edge."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return symbols.join(ends, "id", "left_anti")


# Label, whether more is better, bounds of good and of warn.
SCORECARD = {
    "sir_coverage": (True, 90.0, 70.0), "stale_sir_pct": (False, 10.0, 30.0), "orphan_count": (False, 5.0, 20.0), "avg_drift_score": (False, 0.15, 0.30),
    "graph_connectivity": (True, 0.9, 0.7), "high_coupling_pairs": (False, 3.0, 8.0), "index_freshness_hours": (False, 1.0, 24.0),
}


def scorecard(metrics: DataFrame) -> DataFrame:
    """(name, value, status) for each known metric of one row, and `overall` with the worst status and no value."""
    def status(name: str) -> Column:
        more, good, warn = SCORECARD[name]
        v = F.col(name)
        return F.when(v > good if more else v < good, "good").when(v > warn if more else v < warn, "warn").otherwise("critical")

    names = [c for c in SCORECARD if c in metrics.columns]
    states = [status(c) for c in names]
    worst = F.when(F.array_contains(F.array(*states), "critical"), "critical").when(F.array_contains(F.array(*states), "warn"), "warn").otherwise("good")
    rows = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), s.alias("status")) for c, s in zip(names, states, strict=True)]
    rows.append(F.struct(F.lit("overall").alias("name"), F.lit(None).cast("double").alias("value"), worst.alias("status")))
    return metrics.select(F.inline(F.array(*rows)))


def index_metrics(symbols: DataFrame, records: DataFrame, drift: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: coverage and want of records in percent, orphans, mean drift in 0..1."""
    n = symbols.agg(F.count(F.lit(1)).alias("n"))
    r = symbols.join(records.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("r"))
    o = orphans(symbols, edges).agg(F.count(F.lit(1)).alias("orphan_count"))
    m = drift.agg(X.clamp(F.coalesce(F.avg(F.coalesce("drift", F.lit(0.0))), F.lit(0.0))).alias("avg_drift_score"))
    share = F.when(F.col("n") > 0, F.col("r") / F.nullif("n", F.lit(0)) * 100.0).otherwise(0.0)
    stale = F.when(F.col("n") > 0, (F.col("n") - F.col("r")) / F.nullif("n", F.lit(0)) * 100.0).otherwise(0.0)
    return n.join(r).join(o).join(m).select(share.alias("sir_coverage"), stale.alias("stale_sir_pct"), "orphan_count", "avg_drift_score")  # one row each


def hotspots(symbols: DataFrame, limit: int = 10) -> DataFrame:
    """Symbols of (id, pagerank, drift, tests, has_record) of most risk, with its grade and its causes."""
    top = symbols.agg(F.max("pagerank").alias("_top"))
    s = symbols.join(F.broadcast(top))
    score = X.risk_score(F.col("pagerank"), F.col("drift"), F.col("has_record"), F.col("tests"), F.col("_top"))
    why = F.array_compact(F.array(
        F.when((F.col("pagerank") > 0) & (F.col("pagerank") >= F.col("_top") * 0.7), "high_pagerank"), F.when(F.col("drift") >= 0.3, "semantic_drift"),
        F.when(~F.col("has_record"), "missing_sir"), F.when(F.col("tests") <= 0, "no_tests"),
    ))
    out = s.select("id", score.alias("risk"), F.coalesce(F.nullif(F.array_join(why, ","), F.lit("")), F.lit("stable")).alias("factors"))
    return out.withColumn("grade", X.risk_grade(F.col("risk"))).orderBy(F.col("risk").desc(), "id").limit(limit)


def difficulty_summary(labels: DataFrame, names=("easy", "moderate", "hard", "very_hard")) -> DataFrame:
    """(label, n, percentage) of each known label; percentages are rounded, half up."""
    n = F.count(F.lit(1))
    c = labels.agg(n.alias("total"), *[F.count_if(F.col("label") == k).alias(k) for k in names])
    each = [F.struct(F.lit(k).alias("label"), F.col(k).alias("n"), F.floor(F.col(k) * 100.0 / F.greatest("total", F.lit(1)) + 0.5).cast("long").alias("percentage")) for k in names]
    return c.select(F.inline(F.array(*each)))


def trend(runs: DataFrame, score: int, commit: str | None, keep: int = 10) -> DataFrame:
    """One row: scores of the last runs (run_at, score, commit), oldest first; the current one is added unless it is the latest run."""
    last = runs.orderBy(F.col("run_at").desc()).limit(keep)
    t = last.agg(F.sort_array(F.collect_list(F.struct("run_at", "score", "commit")), False).alias("r"))
    same = (F.size("r") > 0) & (F.get("r", F.lit(0))["score"] == score) & F.get("r", F.lit(0))["commit"].eqNullSafe(F.lit(commit))
    old = F.transform("r", lambda x: x["score"])
    mine = F.array(F.lit(score).cast(runs.schema["score"].dataType))
    return t.select(F.reverse(F.when(same, old).otherwise(F.concat(mine, F.slice(old, 1, keep - 1)))).alias("trend"))


def aftershocks(shifts: DataFrame, edges: DataFrame, pagerank: DataFrame, weights: list[float], noise: float, limit: int = 50) -> DataFrame:
    """Direct dependents of symbols (id, delta) that shifted by more than the noise, with the chance that they follow, above a half.

    The chance is logistic in (1, delta, 1, 1, pagerank of the dependent).
    """
    e = edges.select("source_id", F.col("target_id").alias("id")).distinct()
    j = shifts.filter(F.col("delta") > noise).join(e, "id").join(pagerank.select(F.col("id").alias("source_id"), "pagerank"), "source_id", "left")
    z = F.lit(float(weights[0]) + weights[2] + weights[3]) + F.col("delta") * weights[1] + F.coalesce("pagerank", F.lit(0.0)) * weights[4]
    out = j.select(F.col("source_id").alias("target_symbol_id"), (F.lit(1.0) / (F.exp(-z) + 1.0)).alias("probability"))
    return out.filter("probability > 0.5").orderBy(F.col("probability").desc(), "target_symbol_id").limit(limit)


def confidence(rescued: Column, loners: Column, symbols: Column, embedded: Column, stability: Column, penalty: Column) -> Column:
    """Confidence in detected communities: full, less 0.3 of the rescued share, 0.2 of the loners', 0.2 of the share
    without vectors, 0.3 of the instability and the penalty; none without symbols."""
    share = lambda x: x / F.nullif(symbols, F.lit(0))
    score = F.lit(1.0) - share(rescued) * 0.3 - share(loners) * 0.2 - (F.lit(1.0) - embedded) * 0.2 - (F.lit(1.0) - stability) * 0.3 - penalty
    return F.when(symbols > 0, X.clamp(score)).otherwise(0.0)


def filtered_dependencies(deps: DataFrame, most: float = 0.8) -> DataFrame:
    """(trait, method, dependency) without those that more than `most` of a trait's methods with dependencies share."""
    d = deps.filter("dependency <> ''").distinct()
    methods = d.groupBy("trait").agg(F.countDistinct("method").alias("_m"))
    common = d.groupBy("trait", "dependency").agg(F.count(F.lit(1)).alias("_n")).join(methods, "trait").filter(F.col("_n") / F.col("_m") > most)
    return d.join(common.select("trait", "dependency"), ["trait", "dependency"], "left_anti")


def fused_similarity(deps_a: Column, deps_b: Column, consumers_a: Column, consumers_b: Column) -> Column:
    """Three quarters Jaccard similarity of dependencies and a quarter of consumers; of consumers alone where neither has dependencies."""
    def jaccard(a: Column, b: Column) -> Column:
        n = F.size(F.array_union(a, b))
        return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.nullif(n, F.lit(0))).otherwise(0.0)

    users = jaccard(consumers_a, consumers_b)
    return F.when((F.size(deps_a) == 0) & (F.size(deps_b) == 0), users).otherwise(jaccard(deps_a, deps_b) * 0.75 + users * 0.25)


def group_affinity(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean cosine over all pairs of members of the groups (a, b), from sums of unit vectors: no member meets another."""
    unit = vectors.withColumn("_n", X.norm(F.col("embedding"))).filter("_n > 0")
    cell = unit.select("group", F.posexplode("embedding").alias("k", "x"), "_n").groupBy("group", "k").agg(F.sum(F.col("x").cast("double") / F.col("_n")).alias("s"))
    n = unit.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    left, right = cell.select(F.col("group").alias("a"), "k", F.col("s").alias("sa")), cell.select(F.col("group").alias("b"), "k", F.col("s").alias("sb"))
    dots = pairs.join(left, "a").join(right, ["b", "k"]).groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("_d"))
    out = dots.join(n.select(F.col("group").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("group").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("_d") / (F.col("na") * F.col("nb"))).alias("affinity"))


def absorb_single_clusters(clusters: DataFrame, usage: DataFrame, at: float = 0.8) -> DataFrame:
    """(trait, method, cluster) after clusters of one method joined the cluster whose consumers are most like its own.

    clusters: (trait, method, cluster), numbers of -1 staying apart; usage: (trait, method, consumer). In a round each
    trait makes its best merge: the highest Jaccard similarity of consumers from `at` on, then the first by the names
    of the moving and of the receiving methods. Clusters are compared by the consumers they share, never all with
    all. The result names a cluster by its first method.
    """
    used = cut(usage.select("trait", "method", "consumer").distinct())
    first = clusters.filter("cluster >= 0").groupBy("trait", "cluster").agg(F.min("method").alias("_c"))
    state = cut(clusters.join(first, ["trait", "cluster"], "left").select("trait", "method", F.when(F.col("cluster") >= 0, F.col("_c")).alias("cluster")))
    while True:
        live = state.filter("cluster IS NOT NULL")
        names = live.groupBy("trait", "cluster").agg(F.array_sort(F.collect_list("method")).alias("names"))
        c = live.join(used, ["trait", "method"]).select("trait", "cluster", "consumer").distinct()
        n = c.groupBy("trait", "cluster").agg(F.count(F.lit(1)).alias("n"))
        every = cut(names.join(n, ["trait", "cluster"]))
        one = every.filter(F.size("names") == 1).select("trait", F.col("cluster").alias("moving"), F.col("n").alias("m"))
        shared = c.join(one, (c["trait"] == one["trait"]) & (c["cluster"] == one["moving"])).select(c["trait"], "moving", "m", "consumer")
        shared = shared.join(c, ["trait", "consumer"]).filter("moving <> cluster").groupBy("trait", "moving", "m", "cluster").agg(F.count(F.lit(1)).alias("both"))
        j = shared.join(every.select("trait", "cluster", "n", "names"), ["trait", "cluster"]).withColumn("alike", F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).filter(F.col("alike") >= at)
        best = cut(j.groupBy("trait").agg(F.min(F.struct((-F.col("alike")).alias("far"), "moving", "names", F.col("cluster").alias("into"))).alias("b")).select("trait", F.col("b.moving").alias("cluster"), "b.into"))
        if best.isEmpty():
            return state
        moved = state.join(best, ["trait", "cluster"], "left").select("trait", "method", F.coalesce("into", "cluster").alias("cluster"))
        name = moved.filter("cluster IS NOT NULL").groupBy("trait", "cluster").agg(F.min("method").alias("_c"))
        state = cut(moved.join(name, ["trait", "cluster"], "left").select("trait", "method", F.col("_c").alias("cluster")))
