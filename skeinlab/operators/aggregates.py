"""Aggregations: change coupling, health and risk, seismograph measures, heat maps, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlab.functions import exprs as X
from skeinlab.operators import ordered
from skeinlab.session import cut


def mine_coupling(commits: DataFrame, static_pairs: DataFrame | None = None, similarity: DataFrame | None = None, min_support: int = 3, max_files: int = 30, previous: DataFrame | None = None, static_groups: DataFrame | None = None) -> DataFrame:
    """Pairs of files that change together: counts, temporal / static / semantic signals, fused score, type and risk.

    Static pairs are named (static_pairs), or are those of files that share a group (static_groups: file, group): the
    groups are looked up for the pairs that commits give, so the pairs of a group are never listed.

    Commits of more than `max_files` files are left out, which also bounds the pairs of one commit. Pairs
    are made by joining baskets on the commit and counted with partial aggregation. `previous` holds
    stored totals that are added before the support test. When a commit ties as the last, the larger id wins.
    """
    sized = commits.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("commit"))).filter(F.col("_n") <= max_files).drop("_n")
    b = sized.select("commit", F.col("file").alias("file_b"))
    pairs = sized.withColumnRenamed("file", "file_a").join(b, "commit").filter("file_a < file_b")
    pairs = pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("co_change_count"), F.max(F.struct("at", "commit")).alias("_last"))
    total = sized.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(total.select(F.col("file").alias("file_a"), F.col("n").alias("total_commits_a")), "file_a").join(total.select(F.col("file").alias("file_b"), F.col("n").alias("total_commits_b")), "file_b")
    if previous is not None:
        p = previous.select("file_a", "file_b", *[F.col(c).alias(f"_p_{c}") for c in ("co_change_count", "total_commits_a", "total_commits_b")])
        out = out.join(p, ["file_a", "file_b"], "left")
        for c in ("co_change_count", "total_commits_a", "total_commits_b"):
            out = out.withColumn(c, F.col(c) + F.coalesce(f"_p_{c}", F.lit(0)))
    out = out.filter(F.col("co_change_count") >= min_support)
    out = out.withColumn("temporal", X.clamp(F.col("co_change_count") / F.greatest("total_commits_a", "total_commits_b", F.lit(1))))
    if static_groups is not None:
        groups = static_groups.groupBy("file").agg(F.collect_set("group").alias("_g"))
        out = out.join(groups.select(F.col("file").alias("file_a"), F.col("_g").alias("_ga")), "file_a", "left").join(groups.select(F.col("file").alias("file_b"), F.col("_g").alias("_gb")), "file_b", "left")
        out = out.withColumn("static", F.when(F.arrays_overlap("_ga", "_gb"), 1.0).otherwise(0.0))
    elif static_pairs is not None:
        out = out.join(static_pairs.select("file_a", "file_b", F.lit(1.0).alias("static")).distinct(), ["file_a", "file_b"], "left")
    else:
        out = out.withColumn("static", F.lit(0.0))
    out = out.join(similarity.select("file_a", "file_b", F.col("similarity").alias("semantic")), ["file_a", "file_b"], "left") if similarity is not None else out.withColumn("semantic", F.lit(0.0))
    out = out.na.fill(0.0, ["static", "semantic"])
    out = out.withColumn("fused_score", X.fused_coupling(F.col("temporal"), F.col("static"), F.col("semantic")))
    return out.select("file_a", "file_b", "co_change_count", "total_commits_a", "total_commits_b", "temporal", "static", "semantic", "fused_score", X.coupling_type(F.col("temporal"), F.col("static"), F.col("semantic")).alias("coupling_type"), X.risk_band(F.col("fused_score")).alias("risk"), F.col("_last.commit").alias("last_commit"), F.col("_last.at").alias("last_at"))


def blast_radius(coupling: DataFrame, file, min_score: float) -> DataFrame:
    """The other file of every pair of one file, strongest first."""
    f = coupling.filter(((F.col("file_a") == file) | (F.col("file_b") == file)) & (F.col("fused_score") >= min_score))
    return f.select(F.when(F.col("file_a") == file, F.col("file_b")).otherwise(F.col("file_a")).alias("file"), "fused_score", "risk").orderBy(F.col("fused_score").desc(), "file")


def coupling_matrix(coupling: DataFrame, module: Column, module_b: Column, top: int = 500) -> DataFrame:
    """Mean fused score between modules over the strongest pairs, both orientations."""
    t = coupling.orderBy(F.col("fused_score").desc(), "file_a", "file_b").limit(top).select(module.alias("a"), module_b.alias("b"), "fused_score")
    both = t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), "fused_score"))
    return both.groupBy("a", "b").agg(F.avg("fused_score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def velocity(fp: DataFrame, weights: DataFrame, batch: str, noise: float = 0.15) -> DataFrame:
    """Weighted mean shift above the noise floor, for each batch. Rows changed by configuration alone are left out."""
    rows = fp.filter(~F.col("config_changed") | F.col("source_changed")).join(weights, "symbol_id", "left")
    over = F.greatest(F.coalesce("delta_sem", F.lit(0.0)) - noise, F.lit(0.0))
    pr = F.coalesce("weight", F.lit(0.0))
    return rows.groupBy(batch).agg(F.coalesce(F.sum(pr * over) / F.nullif(F.sum(pr), F.lit(0.0)), F.lit(0.0)).alias("shift"), F.count(F.lit(1)).alias("regenerated"), F.count_if(over > 0).alias("above_noise"))


def ema(series: DataFrame, order: str, value: str, alpha: float) -> DataFrame:
    """Exponential moving average, the first value starting it, over a series of any length in ranges of its order."""
    return ordered.smoothed(series, order, value, alpha, "ema")


def community_stability(fp: DataFrame, communities: DataFrame, weights: DataFrame, noise: float = 0.15) -> DataFrame:
    """One less the weighted share of each community's symbols that breached the noise floor."""
    worst = fp.groupBy("symbol_id").agg(F.max(F.greatest(F.coalesce("delta_sem", F.lit(0.0)), F.lit(0.0))).alias("worst"))
    c = communities.join(worst, "symbol_id", "left").join(weights, "symbol_id", "left")
    pr, hit = F.coalesce("weight", F.lit(0.0)), F.coalesce(F.col("worst") > noise, F.lit(False))
    out = c.groupBy("community").agg(F.sum(pr).alias("t"), F.sum(F.when(hit, pr).otherwise(0.0)).alias("b"), F.count(F.lit(1)).alias("symbol_count"), F.count_if(hit).alias("breach_count"))
    return out.select("community", F.when(F.col("t") > 0, F.greatest(F.lit(1.0) - F.col("b") / F.nullif(F.col("t"), F.lit(0.0)), F.lit(0.0))).otherwise(1.0).alias("stability"), "symbol_count", "breach_count")


def heatmap(cells: DataFrame, threshold: float | None = None, days: int = 90, top: int = 30) -> DataFrame:
    """Ratio changed / total for each module and day: the first `days` days, modules with a cell at the threshold, the most active."""
    kept = cells.select("day").distinct().orderBy("day").limit(days)
    ratio = F.when(F.col("total") > 0, F.col("changed") / F.nullif(F.col("total"), F.lit(0))).otherwise(0.0)
    c = cells.withColumn("ratio", ratio)
    m = c.groupBy("module").agg(F.max("ratio").alias("_m"), F.sum("changed").alias("_a"))
    m = m if threshold is None else m.filter(F.col("_m") >= threshold)
    m = m.orderBy(F.col("_a").desc(), "module").limit(top).select("module")
    return c.join(F.broadcast(m), "module").join(F.broadcast(kept), "day").select("module", "day", "ratio", "total")


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """Counts of equal bins of [0, 1]; one belongs to the last; empty bins count zero."""
    got = df.select(F.floor(F.least(value * bins, F.lit(bins - 1))).cast("int").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bucket")).join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """Value at place round((n - 1) * share) of each sorted group, by ranking rather than collecting."""
    w = W.partitionBy(*group)
    out = df.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return out.filter(F.col("_i") == F.floor((F.col("_n") - 1) * share + 0.5)).select(*group, value)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Concordance with ties counted half, from rank sums over distinct scores."""
    by = df.groupBy(score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    by = ordered.with_sums(by, [score], n=F.col("n")).withColumnRenamed("before_n", "_below")
    out = by.agg(F.sum(F.col("p") * (F.col("_below") + F.col("n") * 0.5)).alias("c"), F.sum("p").alias("P"), F.sum("n").alias("N"))
    return out.select((F.col("c") / F.nullif(F.col("P") * F.col("N"), F.lit(0))).alias("auc"))


def train_logistic(df: DataFrame, features: list[str], label: str, rate: float = 0.01, steps: int = 1000) -> list[float]:
    """Batch gradient descent from zero weights, intercept first.

    Rows are first counted by distinct feature vector, once, and the descent runs on those counts; vectors
    beyond a million distinct ones run as one aggregate for each step instead.
    """
    import numpy as np

    groups = cut(df.groupBy(*features, label).agg(F.count(F.lit(1)).alias("_n")))
    if groups.count() <= 1_000_000:
        rows = groups.orderBy(*features, label).toPandas()
        n = rows["_n"].to_numpy(float)
        x = np.c_[np.ones(len(rows)), rows[features].to_numpy(float)]
        y, w = rows[label].to_numpy(float), np.zeros(len(features) + 1)
        for _ in range(steps):
            w -= rate * (x.T @ (n * (1 / (1 + np.exp(-(x @ w))) - y))) / n.sum()
        return w.tolist()
    w = [0.0] * (len(features) + 1)
    for _ in range(steps):
        z = F.lit(w[0])
        for k, c in enumerate(features):
            z = z + F.col(c) * w[k + 1]
        err = (F.lit(1.0) / (F.exp(-z) + 1.0) - F.col(label).cast("double")) * F.col("_n")
        g = groups.agg(F.sum("_n"), F.sum(err), *[F.sum(err * F.col(c)) for c in features]).first()
        w = [a - rate * b / g[0] for a, b in zip(w, g[1:], strict=True)]
    return w


def predict_logistic(weights: list[float], features: list[Column]) -> Column:
    z = F.lit(weights[0])
    for k, c in enumerate(features):
        z = z + c * weights[k + 1]
    return F.lit(1.0) / (F.exp(-z) + 1.0)


def calibrate(vectors: DataFrame, cap: int = 500, least: int = 20) -> DataFrame:
    """Midpoint of mean cosine within and between files, held to 0.3..0.95, over the first `cap` pairs of each sort.

    Pairs come in order of file and id. Within files, the files that hold the first `cap` pairs are found by
    counts, and of a file only the first cap + 1 members can be in them. Between files, the first member
    comes from the first file and its partners from the others, so the first `cap` members of the first
    file and the first `cap` of all others hold the first pairs. Zero vectors
    are in no pair. The threshold is null with fewer than `least` vectors, or where there is no pair of one sort.
    """
    whole = vectors.agg((F.count(F.lit(1)) >= least).alias("enough"))
    v = vectors.select("file", "id", "embedding").filter("file IS NOT NULL").filter(X.norm(F.col("embedding")) > 0)
    by = W.orderBy("file", "id")
    sim = X.cosine(F.col("embedding"), F.col("e_b")).alias("s")

    def paired(rows: DataFrame, on: Column) -> DataFrame:
        b = rows.select(F.col("file").alias("file_b"), F.col("embedding").alias("e_b"), F.col("_i").alias("_j"))
        return rows.join(b, on & (F.col("_i") < F.col("_j"))).orderBy("_i", "_j").limit(cap).select(sim)

    several = v.groupBy("file").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").orderBy("file").limit(cap)
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    several = several.withColumn("_before", F.sum(pairs).over(W.orderBy("file")) - pairs).filter(F.col("_before") < cap)  # `cap` rows at most
    members = v.join(F.broadcast(several.select("file")), "file", "left_semi").withColumn("_r", F.row_number().over(W.partitionBy("file").orderBy("id"))).filter(F.col("_r") <= cap + 1)
    intra = paired(members.withColumn("_i", F.row_number().over(by)), F.col("file") == F.col("file_b"))
    tagged = v.join(F.broadcast(v.agg(F.min("file").alias("_first"))), F.lit(True))
    head = tagged.filter("file = _first").orderBy("id").limit(cap).unionByName(tagged.filter("file > _first").orderBy("file", "id").limit(cap))
    inter = paired(head.withColumn("_i", F.row_number().over(by)), F.col("file") != F.col("file_b"))
    a = intra.agg(F.avg("s").alias("a"), F.count("s").alias("na"))
    both = a.join(inter.agg(F.avg("s").alias("b"), F.count("s").alias("nb")), F.lit(True)).join(whole, F.lit(True))  # one row each
    middle = (F.col("a") + F.col("b")) / 2
    return both.select(F.when(F.col("enough") & middle.isNotNull(), X.clamp(middle, 0.3, 0.95)).alias("threshold"), (F.col("na") + F.col("nb")).alias("sample_size"))


def calibrate_languages(vectors: DataFrame, languages: list[str], cap: int = 500, least: int = 20) -> DataFrame:
    """(language, threshold, sample_size) of each language that has a threshold; `default` stands for all vectors."""
    out = None
    for name in languages:
        mine = vectors if name == "default" else vectors.filter(F.lower(F.btrim("language")) == name.lower())
        row = calibrate(mine, cap, least).select(F.lit(name).alias("language"), "threshold", "sample_size")
        out = row if out is None else out.unionByName(row)
    return out.filter("threshold IS NOT NULL")


def symbol_risk(symbols: DataFrame) -> DataFrame:
    """Risk of (id, pagerank, tests, drift, has_record, recency): weighted sum over the greatest PageRank."""
    most = symbols.agg(F.max("pagerank").alias("_most"))
    out = symbols.join(F.broadcast(most), F.lit(True))
    pr = F.when(F.col("_most") > 0, F.col("pagerank") / F.nullif(F.col("_most"), F.lit(0.0))).otherwise(0.0)
    risk = pr * 0.3 + (F.lit(1.0) - F.least(F.lit(1.0), F.col("tests") / 3.0)) * 0.25 + F.col("drift") * 0.2 + F.when(F.col("has_record"), 0.0).otherwise(0.15) + F.col("recency") * 0.1
    return out.select("id", X.clamp(risk).alias("risk"))


def semantic_signals(files: DataFrame, highs: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """Workspace ratios from per-file rows (file, max_pagerank, symbols, drifted, stale, communities, tested), and their pressure.

    The top fifth of files with symbols, by centrality then name, is looked at for missing tests.
    """
    f = files.join(F.broadcast(files.agg(F.max("max_pagerank").alias("_most"))), F.lit(True))
    f = f.withColumn("centrality", F.when(F.col("_most") > 0, X.clamp(F.col("max_pagerank") / F.nullif(F.col("_most"), F.lit(0.0)))).otherwise(0.0))
    some = F.col("symbols") > 0
    f = f.withColumn("_r", F.when(some, F.row_number().over(W.partitionBy(some).orderBy(F.col("centrality").desc(), "file"))))
    f = f.join(F.broadcast(files.agg(F.count_if(some).alias("_k"))), F.lit(True)).withColumn("_top", F.greatest(F.ceil(F.col("_k") * 0.2), F.lit(1)))
    a = f.agg(
        F.max("centrality").alias("max_centrality"), F.sum("drifted").alias("d"), F.sum("stale").alias("s"), F.sum("symbols").alias("n"), F.first("_k").alias("k"), F.first("_top").alias("top"),
        F.count_if(some & (F.col("_r") <= F.col("_top")) & ~F.col("tested")).alias("gap"), F.count_if(some & (F.col("communities") > 1)).alias("leak"),
    )
    share = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    ratios = {"drift_density": share(F.col("d"), F.col("n")), "stale_ratio": share(F.col("s"), F.col("n")), "test_gap": share(F.col("gap"), F.least("top", "k")), "boundary_leakage": share(F.col("leak"), F.col("k"))}
    out = a.select("max_centrality", *[X.clamp(v / highs[k]).alias(k) for k, v in ratios.items()])
    total = F.col("max_centrality") * weights["max_centrality"]
    for k in ratios:
        total = total + F.col(k) * weights[k]
    return out.withColumn("semantic_pressure", X.clamp(total))


def combined_score(structural: Column, git: Column, semantic: Column, weights=(0.4, 0.3, 0.3)) -> Column:
    """Mean of the buckets that are there, by weight, rounded."""
    parts = [(structural, weights[0]), (git, weights[1]), (semantic, weights[2])]
    top, low = F.lit(0.0), F.lit(0.0)
    for c, w in parts:
        top, low = top + F.coalesce(c * w, F.lit(0.0)), low + F.when(c.isNotNull(), w).otherwise(0.0)
    return X.clamp(F.floor(top / F.nullif(low, F.lit(0.0)) + 0.5), 0, 100)


def compare_runs(before: DataFrame, after: DataFrame, key: str, score: str) -> DataFrame:
    """Full outer difference of two runs: added, removed, improved, regressed or unchanged."""
    j = before.select(key, F.col(score).alias("before")).join(after.select(key, F.col(score).alias("after")), key, "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "regressed").otherwise("unchanged")
    return j.select(key, "before", "after", change.alias("change"))


def git_stats(changes: DataFrame, now: int, day: int) -> DataFrame:
    """Per file: commits of the last 30 and 90 days, authors, population deviation of change times in days."""
    age = (F.lit(now) - F.col("at")) / day
    return changes.groupBy("file").agg(F.countDistinct(F.when(age <= 30, F.col("commit"))).alias("commits_30d"), F.countDistinct(F.when(age <= 90, F.col("commit"))).alias("commits_90d"), F.countDistinct("author").alias("authors"), F.stddev_pop(F.col("at") / day).alias("age_deviation"))


def file_rollup(leaves: DataFrame, arrays: list[str]) -> DataFrame:
    """Per file: sorted distinct union of array columns, least confidence, count, ordered join of intents."""
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in arrays]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "intent"))), lambda x: x["intent"]), "; ")
    return leaves.groupBy("file").agg(*aggs, F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), text.alias("intent"))


def dominant(df: DataFrame, group: str, label: str) -> DataFrame:
    """Most frequent label of each group (ties: smallest) and its share."""
    c = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), (F.max("n") / F.sum("n")).alias("share"))
