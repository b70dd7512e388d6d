"""Rule-based quality statistics and robust multivariate outliers (minimum covariance determinant)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skeinlab.llm.common import Scratch, bounded_broadcast, word_array

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Transformed statistics, with the least standard deviation each is given credit for.
FEATURES = {"f_chars": 0.10, "f_symbols": 0.03, "f_lines": 0.08, "f_repeat": 0.12}
#: Share of each group that the determinant is minimised over, concentration steps, least rows of a group of its own.
SUPPORT, STEPS, MIN_GROUP = 0.75, 3, 50
#: Share of rows that any distribution may have beyond the cutoff, by Chebyshev's inequality.
BEYOND = 0.05


def chi_square_below(x: float, df: int) -> float:
    """Chance that a chi-square variable of an even number of degrees of freedom is below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(df // 2))


def consistency(support: float, dims: int) -> float:
    """Factor that makes the scatter of the innermost `support` of normal rows the scatter of all of them."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_below(mid, dims) < support else (lo, mid)
    return support / chi_square_below(lo, dims + 2)


#: Squared Mahalanobis distance beyond which a document is rejected: its mean is the number of statistics, and
#: at most BEYOND of any distribution lies beyond that mean over BEYOND.
CUTOFF = len(FEATURES) / BEYOND


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to every row.

    Null and empty texts have zeros and fail for want of words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_text", text).withColumn("_words", word_array(F.col("_text")))
    out = out.withColumn("_h", F.expr("transform(_words, x -> xxhash64(x))"))
    out = out.withColumn("_n", F.size("_words"))
    # Hash and place of every 3-word window, sorted, bring equal windows side by side.
    out = out.withColumn(
        "_win",
        F.expr("CASE WHEN _n < 3 THEN CAST(array() AS array<struct<h: bigint, i: int>>) ELSE sort_array(transform(slice(_h, 1, _n - 2), (x, i) -> struct(xxhash64(x, _h[i + 1], _h[i + 2]) AS h, i AS i))) END"),
    ).withColumn("_m", F.size("_win"))
    out = out.withColumn(
        "_at",
        F.expr("sort_array(transform(filter(_win, (x, j) -> (j > 0 AND x.h = _win[greatest(j - 1, 0)].h) OR (j < _m - 1 AND x.h = _win[least(j + 1, _m - 1)].h)), x -> x.i))"),
    )
    repeat = F.expr("aggregate(_at, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)")
    out = out.withColumn("_lines", F.expr(r"filter(split(_text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    out = out.select(
        *docs.columns,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def transformed(df: DataFrame) -> DataFrame:
    """Statistic vectors on scales where clean text is roughly normal."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        df.withColumn("f_chars", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
        .withColumn("f_symbols", F.sqrt(F.col("n_symbols") / n))
        .withColumn("f_lines", F.sqrt(F.col("n_dup_lines") / n))
        .withColumn("f_repeat", F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))) / F.log(n + 10) * 5)
    )


def _moments(names: list[str]) -> list[Column]:
    """Rows, means and covariances; plain aggregates, combined before shuffling."""
    out = [F.count(F.lit(1)).alias("_rows"), *[F.avg(x).alias(f"m_{x}") for x in names]]
    return out + [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])]


def _factored(t: DataFrame, names: list[str], scale: float = 1.0) -> DataFrame:
    """Covariances, times `scale`, replaced by their lower Cholesky factor, and the determinant."""
    det = F.lit(1.0)
    for i, x in enumerate(names):
        for j in range(i + 1):
            s = F.col(f"c_{i}_{j}") * scale
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:  # the floor keeps degenerate statistics (all zero, say) from dividing by nothing
                s = F.sqrt(F.greatest(s, F.lit(0.0)) + FEATURES[x] ** 2)
            else:
                s = s / F.col(f"l_{j}_{j}")
            t = t.withColumn(f"l_{i}_{j}", s)
        det = det * F.col(f"l_{i}_{i}") * F.col(f"l_{i}_{i}")
    return t.withColumn("_det", det).drop(*[f"c_{i}_{j}" for i in range(len(names)) for j in range(i + 1)])


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    y: list[Column] = []
    for i, x in enumerate(names):
        s = F.col(x) - F.col(f"m_{x}")
        for k in range(i):
            s = s - F.col(f"l_{i}_{k}") * y[k]
        y.append(s / F.col(f"l_{i}_{i}"))
    out = y[0] * y[0]
    for v in y[1:]:
        out = out + v * v
    return out


def mcd(rows: DataFrame, group: list[str], scratch: Scratch, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Location and scatter of each group's most concentrated `support` of rows, by group: _rows, m_*, l_*_*, _det.

    Three starts: medians with the floors as scales, medians with quartile distances as scales, and mean and
    covariance of all rows. From each, concentration steps: keep the rows nearest under the estimate, then
    estimate on them. Of the three ends of a group the one of least determinant stays (ties: the first),
    its scatter made consistent for normal rows. Each step is one grouped aggregate and one grouped quantile
    over all rows, for all starts at once; only three rows for each group are carried between steps.
    """
    names = list(FEATURES)
    keys = [F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group]
    cells = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    third = [*[f"m_{x}" for x in names], *[f"l_{i}_{j}" for i, j in cells]]
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{x}") for x in names]
    first = scratch.cut(_factored(rows.groupBy(*group).agg(*_moments(names), *quartiles), names), "mcd-start")
    flat = [F.lit(FEATURES[names[i]] if i == j else 0.0).alias(f"l_{i}_{j}") for i, j in cells]
    spread = [(F.sqrt(((F.col(f"q_{names[i]}")[2] - F.col(f"q_{names[i]}")[0]) / 1.349) ** 2 + FEATURES[names[i]] ** 2) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in cells]
    medians = [F.col(f"q_{x}")[1].alias(f"m_{x}") for x in names]
    starts = [F.struct(F.lit(k).alias("_start"), *start).alias("_s") for k, start in enumerate(([*medians, *flat], [*medians, *spread], [F.col(c).alias(c) for c in third]))]
    est = scratch.cut(first.select(*group, F.explode(F.array(*starts)).alias("_s")).select(*group, "_s.*"), "mcd-starts")
    n = est.count()  # three for each group, in every step
    keys_start = [*keys, F.col("r._start") == F.col("t._start")]
    for step in range(steps):
        near = rows.alias("r").join(bounded_broadcast(est, n).alias("t"), keys).select("r.*", "t._start", _distance(names).alias("_d"))
        edge = near.groupBy(*group, "_start").agg(F.percentile_approx("_d", support, 1000).alias("_edge"))
        edge = bounded_broadcast(scratch.cut(edge, f"mcd-edge{step}"), n)
        kept = near.alias("r").join(edge.alias("t"), keys_start).filter("_d <= _edge").select("r.*")
        scale = consistency(support, len(names)) if step == steps - 1 else 1.0
        est = scratch.cut(_factored(kept.groupBy(*group, "_start").agg(*_moments(names)), names, scale), f"mcd-step{step}")
    best = F.min_by(F.struct("_rows", *third, "_det"), F.struct("_det", "_start"))
    return scratch.cut(est.groupBy(*group).agg(best.alias("_best")).select(*group, "_best.*"), "mcd")


def quality_outliers(docs: DataFrame, carry: tuple[str, ...] | None = None, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """All rows (columns `carry`, all by default) plus the base statistics, base_failed, distance and kept.

    Estimates are made for each language and source over the rows that pass the base rules; a group with
    fewer than `min_group` such rows uses its language's estimate, or else that of all rows. Rows beyond
    `cutoff` are rejected (kept false), as are base failures. Null languages and sources are groups of
    their own; with no passing rows there is nothing to estimate and the base rules alone decide.
    Input columns of the names added here are replaced; others, of whatever name, go through.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = list(FEATURES)
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    added = [*stats, "distance", "kept", *names]
    columns = [c for c in (docs.columns if carry is None else carry) if c not in added]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    rows = transformed(base_statistics(packed, "_t"))
    rows = scratch.cut(rows.select("_row", "_lang", "_source", *stats, *names), "statistics")
    # Every row is in three groups: its language and source, its language, and all; one run estimates them together.
    none = F.lit(None).cast("string")
    groups = F.array(*[F.struct(F.lit(k).alias("_level"), x.alias("_lang"), y.alias("_source")) for k, (x, y) in enumerate(((F.col("_lang"), F.col("_source")), (F.col("_lang"), none), (none, none)))])
    good = rows.filter("NOT base_failed").select(F.explode(groups).alias("_g"), *names).select("_g.*", *names)
    est = mcd(good, ["_level", "_lang", "_source"], scratch)
    n = est.count()
    fields = F.struct(*[f"m_{x}" for x in names], *[f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)])
    out = rows
    for k, keys in enumerate((["_lang", "_source"], ["_lang"], [])):
        level = est.filter(F.col("_level") == k).select(*[F.col(g).alias(f"g{k}{g}") for g in keys], F.col("_rows").alias(f"_rows{k}"), fields.alias(f"_est{k}"))
        on = F.lit(True)
        for g in keys:
            on = on & F.col(g).eqNullSafe(F.col(f"g{k}{g}"))
        out = out.join(bounded_broadcast(level, n) if keys else F.broadcast(level), on, "left")  # the last level has one row
    enough = support_rows(min_group)
    est = F.when(F.col("_rows0") >= enough, F.col("_est0")).when(F.col("_rows1") >= enough, F.col("_est1")).otherwise(F.col("_est2"))
    out = out.withColumn("_est", est).select("*", "_est.*")
    out = out.withColumn("distance", _distance(names))
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return out.select(*[F.col("_row")[c].alias(c) for c in columns], *stats, "distance", verdict.alias("kept"), *names)


def support_rows(min_group: int) -> int:
    return max(1, int(min_group * SUPPORT))
