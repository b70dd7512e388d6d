"""Queries over composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.functions import exprs as X
from skeinlab.operators import graph, reports
from skeinlab.plans import roles as R
from skeinlab.plans.queries_measures import _COUPLING, _coupling
from skeinlab.plans.registry import query


@query("task_relevance", "WITH x AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INTEGER) + CAST((length(t) - length(replace(t, 'ring', ''))) / 4 AS INTEGER) AS score FROM x) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 50")
def _(spark, d):
    out = R.read(spark, d, "documents").select("doc_id", reports.relevance(F.col("text"), ["The", "of", "ring", "the"]).alias("score"))
    return out.orderBy(F.col("score").desc(), "doc_id").limit(50)


_SETS = "g AS (SELECT l_orderkey AS k, l_linestatus AS s, list_sort(list_distinct(array_agg(l_returnflag || l_linenumber))) AS xs FROM lineitem GROUP BY 1, 2), p AS (SELECT a.k, a.xs AS b, b.xs AS a FROM g a JOIN g b ON a.k = b.k AND a.s = 'F' AND b.s = 'O')"


@query("record_diff", f"""WITH {_SETS} SELECT k, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS added, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS removed,
round(least(1.0, 0.4 * CAST(k % 2 = 0 AS INTEGER) + 0.25 * least(4, len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x)))) / 4.0), 6) AS magnitude FROM p""")
def _(spark, d):
    g = R.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linestatus").agg(F.collect_set(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("xs"))
    p = g.filter("l_linestatus = 'F'").select("k", F.col("xs").alias("b")).join(g.filter("l_linestatus = 'O'").select("k", F.col("xs").alias("a")), "k")
    p = p.withColumn("d", reports.record_diff(F.col("b"), F.col("a")))
    m = X.structural_magnitude(F.col("k") % 2 == 0, F.size("d.added") + F.size("d.removed"), F.lit(0), F.lit(0))
    return p.select("k", F.array_join("d.added", ",").alias("added"), F.array_join("d.removed", ",").alias("removed"), F.round(m, 6).alias("magnitude"))


@query("canonical_hash", """WITH g AS (SELECT p_brand, list_sort(list_distinct(array_agg(p_type))) AS kinds, max(p_size) AS top FROM part GROUP BY 1) SELECT p_brand, sha256('{"brand":"' || p_brand || '","kinds":["' || array_to_string(kinds, '","') || '"],"top":' || top || '}') AS record_hash FROM g""")
def _(spark, d):
    g = R.read(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_type").alias("kinds"), F.max("p_size").alias("top"))
    return g.select(F.col("brand").alias("p_brand"), F.sha2(reports.canonical_json(g, ["kinds"], ["brand", "top"]), 256).alias("record_hash"))


@query("partition_similarity", "WITH p AS (SELECT p_partkey AS id, p_partkey % 25 AS x, CASE WHEN p_partkey % 7 = 0 THEN 99 ELSE p_partkey % 25 END AS y FROM part), q AS (SELECT count(*) FILTER (WHERE a.x = b.x AND a.y = b.y) AS i, count(*) FILTER (WHERE a.x = b.x OR a.y = b.y) AS u FROM p a JOIN p b ON a.id < b.id) SELECT round(i / u, 8) AS jaccard FROM q")
def _(spark, d):
    p = R.read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    a = p.withColumn("community", F.col("id") % 25)
    b = p.withColumn("community", F.when(F.col("id") % 7 == 0, 99).otherwise(F.col("id") % 25))
    return reports.partition_similarity(a, b).select(F.round("jaccard", 8).alias("jaccard"))


@query("audit_findings", "WITH f AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS rank, user_id, value FROM events) SELECT id, rank FROM f WHERE rank >= 3 AND value > 20 ORDER BY rank DESC, value DESC, id DESC LIMIT 100")
def _(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("error", "critical", "purchase", "High ", "signup", "medium", "click", "low", "view", "info")])
    f = R.read(spark, d, "events").select(F.col("event_id").alias("id"), F.element_at(names, F.col("event_type")).alias("severity"), F.when(F.col("value") > 20, "large").otherwise("small").alias("category"), F.lit("open").alias("status"), F.lit("src/x").alias("file_path"), F.col("value").alias("created_at"))
    return reports.audit_findings(f, "high", "large", "open", "src/", 100).select("id", "rank")


@query("git_recency", f"WITH {R.COMMITS}, c AS (SELECT DISTINCT commit, commits.at AS t FROM commits), r AS (SELECT commit, row_number() OVER (ORDER BY t DESC, commit DESC) - 1 AS pos FROM c) SELECT file, round(max(1.0 - pos / 10.0), 6) AS score FROM commits JOIN r USING (commit) WHERE pos < 10 GROUP BY 1")
def _(spark, d):
    return reports.git_recency(R.commits(spark, d)).withColumn("score", F.round("score", 6))


@query("coupling_predict", f"""WITH {_COUPLING}, o AS (SELECT file_a AS f, file_b AS g, fused_score FROM risked UNION ALL SELECT file_b, file_a, fused_score FROM risked) SELECT p_partkey AS id, round(max(0.5 * fused_score), 6) AS predicted FROM o JOIN part ON p_partkey % 100 = g WHERE f IN (3, 7) AND fused_score >= 0.05 GROUP BY 1""")
def _(spark, d):
    s = R.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("file"))
    edited = spark.range(1).select(F.explode(F.array(F.lit(3).cast("long"), F.lit(7).cast("long"))).alias("file"))
    return reports.coupling_predictions(edited, _coupling(spark, d), s, 0.05).withColumn("predicted", F.round("predicted", 6))


@query("trace_cause")
def _(spark, d):
    e = R.edges(spark, d)
    changes = R.fingerprints(spark, d).select(F.col("symbol_id").alias("id"), F.col("ts_us").alias("at"), F.col("delta_sem").alias("magnitude"))
    files = R.symbols(spark, d).select("id", (F.col("id") % 100).alias("file"))
    start = e.agg(F.min("source_id")).first()[0]
    out = reports.causes(e, changes, files, _coupling(spark, d), start, 6, 1706659200000000, 30 * 86400000000, 25)
    return out.withColumn("score", F.round("score", 8))


@query("blast_rings", f"""WITH RECURSIVE {R.SYMBOLS}, {R.edges_sql()}, s AS (SELECT max(target_id) AS id FROM edges), r AS (SELECT id, 0 AS depth FROM s UNION SELECT e.source_id, r.depth + 1 FROM r JOIN (SELECT DISTINCT source_id, target_id FROM edges) e ON e.target_id = r.id WHERE r.depth < 5),
m AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1) SELECT depth, kind AS layer, count(*) AS n FROM m LEFT JOIN symbols USING (id) GROUP BY 1, 2""")
def _(spark, d):
    e = R.edges(spark, d)
    return reports.rings(e, e.agg(F.max("target_id").alias("id")), R.symbols(spark, d).select("id", F.col("kind").alias("layer")), 5, None)


@query("file_view", f"WITH {R.SYMBOLS}, {R.edges_sql()} SELECT DISTINCT a.file_path AS source_file, b.file_path AS target_file FROM edges JOIN symbols a ON a.id = source_id JOIN symbols b ON b.id = target_id WHERE a.file_path <> b.file_path")
def _(spark, d):
    s = R.symbols(spark, d).select("id", F.col("file_path").alias("file"), (F.col("size") / 50.0).alias("drift"))
    return reports.file_view(s, R.edges(spark, d))[1]


@query("emerging_hubs", f"""WITH {R.edges_sql()}, {R.OLD_EDGES}, now AS (SELECT target_id AS id, count(*) * 1.0 AS rank FROM edges GROUP BY 1), bef AS (SELECT target_id AS id, count(*) * 1.0 AS rank FROM old GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY rank, id) - 1 AS i, count(*) OVER () AS n FROM now), e AS (SELECT rank FROM o WHERE i = floor((n - 1) * 0.95 + 0.5)) SELECT now.id, CAST(now.rank AS DOUBLE) AS rank, CAST(bef.rank AS DOUBLE) AS previous FROM now JOIN bef USING (id), e WHERE now.rank >= e.rank AND now.rank > bef.rank * 1.2""")
def _(spark, d):
    count = lambda e: e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("rank"))
    return reports.emerging_hubs(count(R.edges(spark, d)), count(R.old_edges(spark, d)))


@query("remember_notes", "SELECT sha256(translate(trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS content_hash, min(doc_id) AS note_id, string_agg(DISTINCT lower(source), ',' ORDER BY lower(source)) AS tags, CAST(sum(n_chars) AS BIGINT) AS accesses, min(doc_id) AS first_at, max(doc_id) AS last_at FROM documents GROUP BY 1")
def _(spark, d):
    n = R.read(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("content"), F.array("source").alias("tags"), F.col("n_chars").alias("accesses"), F.col("doc_id").alias("at"))
    return reports.remember(n).withColumn("tags", F.array_join("tags", ","))


@query("archetypes", "WITH f AS (SELECT p_brand, sum(p_size) AS loc, max(p_size) AS top, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, array_to_string(list_slice(list_filter([CASE WHEN loc > 2000 THEN 'god_file' END, CASE WHEN n > 80 THEN 'crowded' END, CASE WHEN top >= 50 THEN 'peaky' END], lambda x: x IS NOT NULL), 1, 2), ',') AS archetypes FROM f")
def _(spark, d):
    f = R.read(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("loc"), F.max("p_size").alias("top"), F.count(F.lit(1)).alias("n"))
    rules = [("god_file", F.col("loc") > 2000), ("crowded", F.col("n") > 80), ("peaky", F.col("top") >= 50)]
    return reports.archetypes(f, rules).select("p_brand", F.array_join("archetypes", ",").alias("archetypes"))


@query("file_signals", f"WITH {R.COMMITS}, g AS (SELECT file, count(*) AS commits, max(commits.at) AS git_at FROM commits GROUP BY 1), f AS (SELECT user_id % 120 AS file, round(max(value) / 100, 6) AS drift, epoch_us(max(ts)) AS drift_at FROM events GROUP BY 1) SELECT file, coalesce(commits, 0) AS commits, coalesce(drift, 0) AS drift, greatest(git_at, drift_at) AS latest FROM g FULL JOIN f USING (file)")
def _(spark, d):
    g = R.commits(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.max("at").alias("git_at"))
    f = R.read(spark, d, "events").groupBy((F.col("user_id") % 120).alias("file")).agg(F.round(F.max("value") / 100, 6).alias("drift"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', max(ts))").alias("drift_at"))
    return reports.accumulate(g, f)


@query("seeded_subgraph", f"""WITH RECURSIVE {R.edges_sql()}, b AS (SELECT source_id AS x, target_id AS y FROM edges UNION SELECT target_id, source_id FROM edges), r AS (SELECT min(source_id) AS id, 0 AS depth FROM edges UNION SELECT y, r.depth + 1 FROM r JOIN b ON b.x = r.id WHERE r.depth < 4), m AS (SELECT DISTINCT id FROM r)
SELECT source_id, target_id, count(*) AS n FROM edges WHERE source_id IN (SELECT id FROM m) AND target_id IN (SELECT id FROM m) GROUP BY 1, 2""")
def _(spark, d):
    e = R.edges(spark, d)
    m = graph.k_hop(e, e.agg(F.min("source_id").alias("id")), 4, "both").select("id")
    e = e.join(m.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(m.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return e.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
