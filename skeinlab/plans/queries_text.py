"""Queries over text, hashing, staleness, table and document operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from skeinlab.functions import exprs as X, udfs
from skeinlab.operators import temporal
from skeinlab.plans import roles as R
from skeinlab.plans.registry import query
from skeinlab.sources import tables

_LOW = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query("doc_dedupe", "SELECT sha256(translate(trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS content_key, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY 1")
def _(spark, d):
    return R.read(spark, d, "documents").groupBy(X.content_key(F.col("text")).alias("content_key")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


@query("tag_union", "SELECT p_brand, string_agg(DISTINCT lower(trim(p_type)), ',' ORDER BY lower(trim(p_type))) AS tags, count(DISTINCT p_type) AS n FROM part GROUP BY 1")
def _(spark, d):
    g = R.read(spark, d, "part").groupBy("p_brand").agg(F.collect_list("p_type").alias("t"), F.countDistinct("p_type").alias("n"))
    return g.select("p_brand", F.array_join(X.normalize_tags(F.col("t")), ",").alias("tags"), "n")


@query("dice_similarity", """WITH p AS (SELECT DISTINCT p_name AS n FROM part), x AS (SELECT n, list_transform(range(1, length(replace(n, ' ', ''))), lambda i: substr(replace(n, ' ', ''), i, 2)) AS g FROM p),
u AS (SELECT a.n AS a, b.n AS b, unnest(list_distinct(a.g)) AS v, a.g AS ga, b.g AS gb FROM x a JOIN x b ON a.n < b.n)
SELECT a, b, round(2.0 * sum(least(len(list_filter(ga, lambda z: z = v)), len(list_filter(gb, lambda z: z = v)))) / max(len(ga) + len(gb)), 6) AS dice FROM u GROUP BY 1, 2""")
def _(spark, d):
    p = R.read(spark, d, "part").select("p_name").distinct()  # 64 names whatever the scale
    pairs = p.select(F.col("p_name").alias("a")).join(p.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(X.dice(F.col("a"), F.col("b")), 6).alias("dice"))


_MARK = lambda words: " + ".join(f"CAST(regexp_matches(t, '(^|[^a-z0-9]){w}($|[^a-z0-9])') AS INTEGER)" for w in words)


@query("quality_signals", f"""WITH x AS (SELECT doc_id, trim(text) AS s, lower(trim(text)) AS t FROM documents), v AS (SELECT doc_id, least(({_MARK(X.BEHAVIOR_WORDS)}) / 4.0, 1) AS behavioral_depth,
least(({_MARK(X.ERROR_WORDS)}) / 2.0, 1) AS error_coverage, least(length(s) / 300.0, 1) AS length_score FROM x) SELECT doc_id, round(behavioral_depth, 6) AS behavioral_depth, round(error_coverage, 6) AS error_coverage, round(length_score, 6) AS length_score FROM v""")
def _(spark, d):
    q = X.quality_signals(F.col("text"))
    return R.read(spark, d, "documents").select("doc_id", *[F.round(q[k], 6).alias(k) for k in ("behavioral_depth", "error_coverage", "length_score")])


_DIFF = "CASE WHEN e > 2 THEN 30 WHEN e > 0 THEN 10 ELSE 0 END + CASE WHEN s > 1 THEN 25 WHEN s > 0 THEN 10 ELSE 0 END + CASE WHEN d > 5 THEN 20 WHEN d > 2 THEN 10 ELSE 0 END + CASE WHEN c THEN 25 ELSE 0 END"


@query("difficulty_score", f"WITH x AS (SELECT p_partkey, p_size % 5 AS e, p_size % 3 AS s, p_size % 9 AS d, p_size % 2 = 0 AS c FROM part), y AS (SELECT p_partkey, CAST({_DIFF} AS DOUBLE) AS score FROM x) SELECT p_partkey, score, CASE WHEN score <= 15 THEN 'easy' WHEN score <= 40 THEN 'moderate' WHEN score <= 65 THEN 'hard' ELSE 'very_hard' END AS label FROM y")
def _(spark, d):
    s = F.col("p_size")
    score = X.difficulty(s % 5, s % 3, s % 9, s % 2 == 0)
    return R.read(spark, d, "part").select("p_partkey", score.alias("score")).withColumn("label", X.difficulty_label(F.col("score")))


@query("layer_classify", """SELECT page_id, CASE WHEN regexp_matches(p, '/tests/|^tests/|_test\\.rs$') THEN 'Tests' WHEN regexp_matches(p, '/bin/|(^|/)main\\.rs$|cli') THEN 'Interface' WHEN regexp_matches(p, 'server|handler|route|api') THEN 'Interface'
WHEN regexp_matches(p, 'client|connector|provider') THEN 'Connectors' WHEN regexp_matches(p, 'db|store|repo|cache|state') THEN 'Data' WHEN regexp_matches(p, 'frame|parse|codec|wire|proto') THEN 'Wire Format' ELSE 'Core Logic' END AS layer FROM (SELECT page_id, lower(url) AS p FROM pages)""")
def _(spark, d):
    return R.read(spark, d, "pages").select("page_id", X.layer(F.col("url"), F.lit(""), F.lit(None).cast("string")).alias("layer"))


_STALE = f"""{R.FINGERPRINTS}, a AS (SELECT symbol_id, max(day) AS last_day, count(*) FILTER (WHERE neighbor_changed) AS churn, bool_or(source_changed AND delta_sem > 0.95) AS changed, max(delta_sem) AS nb FROM fp GROUP BY 1),
s AS (SELECT *, 1 / (1 + exp(-0.2 * ((DATE '2024-03-01' - last_day) * (1 + log2(1 + churn % 3)) - 40))) AS t FROM a), f AS (SELECT symbol_id, churn, greatest(CASE WHEN changed OR symbol_id % 11 = 0 THEN 1.0 ELSE 0.0 END, 1 - (1 - t) * (1 - nb / 2)) AS staleness FROM s)"""


def _staleness(spark, d):
    a = R.fingerprints(spark, d).groupBy("symbol_id").agg(F.max("day").alias("last_day"), F.count_if("neighbor_changed").alias("churn"), F.max(F.col("source_changed") & (F.col("delta_sem") > 0.95)).alias("changed"), F.max("delta_sem").alias("nb"))
    t = X.time_staleness(X.effective_age(F.datediff(F.lit("2024-03-01").cast("date"), "last_day"), F.col("churn") % 3), 40.0, 0.2)
    return a.select("symbol_id", "churn", X.staleness(F.col("changed"), F.col("symbol_id") % 11 == 0, t, F.col("nb") / 2).alias("staleness"))


@query("staleness_score", f"WITH {_STALE} SELECT symbol_id, round(staleness, 6) AS staleness FROM f")
def _(spark, d):
    return _staleness(spark, d).select("symbol_id", F.round("staleness", 6).alias("staleness"))


@query("priority_score", f"WITH {_STALE} SELECT symbol_id, round(staleness + 0.3 * log10(1 + churn) / log10(1 + (SELECT max(churn) FROM f)), 6) AS priority FROM f ORDER BY f.staleness + 0.3 * log10(1 + churn) / log10(1 + (SELECT max(churn) FROM f)) DESC, symbol_id LIMIT 50")
def _(spark, d):
    s = _staleness(spark, d)
    s = s.join(F.broadcast(s.agg(F.max("churn").alias("most"))), F.lit(True))
    p = F.col("staleness") + F.log10(F.col("churn") + 1) / F.log10(F.col("most") + 1) * 0.3
    return s.withColumn("priority", p).orderBy(F.col("priority").desc(), "symbol_id").limit(50).select("symbol_id", F.round("priority", 6).alias("priority"))


@query("score_bands", f"WITH {_STALE} SELECT CASE WHEN staleness >= 0.8 THEN 'critical' WHEN staleness >= 0.5 THEN 'high' WHEN staleness >= 0.2 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM f GROUP BY 1")
def _(spark, d):
    return _staleness(spark, d).groupBy(X.staleness_band(F.col("staleness")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("prompt_hashes", """WITH x AS (SELECT symbol_id, array_agg(sir_hash ORDER BY version) AS hs, min(sir_hash) AS a, max(sir_hash) AS b FROM (SELECT user_id AS symbol_id, event_type AS sir_hash, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events) GROUP BY 1)
SELECT symbol_id, left(sha256(a), 16) || '|' || left(sha256(array_to_string(list_sort(hs), chr(10))), 16) || '|' || left(sha256(b), 16) AS prompt_hash FROM x""")
def _(spark, d):
    h = R.history(spark, d).groupBy("symbol_id").agg(F.collect_list("sir_hash").alias("hs"), F.min("sir_hash").alias("a"), F.max("sir_hash").alias("b"))
    return h.select("symbol_id", X.prompt_hash(F.col("a"), F.col("hs"), F.col("b")).alias("prompt_hash"))


@query("first_sentences", "SELECT doc_id, CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) || '.' WHEN contains(t, '!') THEN split_part(t, '!', 1) || '!' WHEN contains(t, '?') THEN split_part(t, '?', 1) || '?' ELSE t END AS sentence FROM (SELECT doc_id, trim(text, ' ') AS t FROM documents)")
def _(spark, d):
    return R.read(spark, d, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query("page_links", "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1, 2")
def _(spark, d):
    p = R.read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return p.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("json_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, d):
    e = R.read(spark, d, "events").select(F.try_element_at(X.json_map(F.col("props")), F.lit("k")).cast("long").alias("k"), "value")
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("token_estimates", "SELECT lang, CAST(sum(CAST(ceil(strlen(text) / 3.5) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return R.read(spark, d, "documents").groupBy("lang").agg(F.sum(X.estimate_tokens(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("n"))


@query("snippets", "SELECT doc_id, CASE WHEN length(text) > 180 THEN left(text, 180) || '...' ELSE text END AS snippet FROM documents")
def _(spark, d):
    return R.read(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("merge_upsert", "WITH u AS (SELECT p_partkey AS id, p_size AS v, 1 AS ver, p_size AS hits FROM part WHERE p_size <= 30 UNION ALL SELECT p_partkey, p_size + 1, 2, 0 FROM part WHERE p_retailprice >= 1000) SELECT id, arg_max(v, ver) AS v, CAST(max(ver) AS INTEGER) AS ver, max(hits) AS hits FROM u GROUP BY 1")
def _(spark, d):
    p = R.read(spark, d, "part")
    a = p.filter("p_size <= 30").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"), F.lit(1).alias("ver"), F.col("p_size").alias("hits"))
    b = p.filter("p_retailprice >= 1000").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1).alias("v"), F.lit(2).alias("ver"), F.lit(0).alias("hits"))
    return tables.merge(a, b, ["id"], "ver", keep=["hits"])


@query("fsck", f"""WITH {R.SYMBOLS}, {R.edges_sql()}, rec AS (SELECT doc_id AS id FROM documents), vec AS (SELECT vec_id AS id FROM embeddings)
SELECT 'record_without_symbol' AS "check", (SELECT count(*) FROM rec WHERE id NOT IN (SELECT id FROM symbols)) AS n UNION ALL SELECT 'symbol_without_record', (SELECT count(*) FROM symbols WHERE id NOT IN (SELECT id FROM rec)) UNION ALL
SELECT 'vector_without_record', (SELECT count(*) FROM vec WHERE id NOT IN (SELECT id FROM rec)) UNION ALL SELECT 'record_without_vector', (SELECT count(*) FROM rec WHERE id NOT IN (SELECT id FROM vec)) UNION ALL
SELECT 'edge_without_source', (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM symbols)) UNION ALL SELECT 'edge_without_target', (SELECT count(*) FROM edges WHERE target_id NOT IN (SELECT id FROM symbols))""")
def _(spark, d):
    return tables.fsck(R.symbols(spark, d), R.read(spark, d, "documents").select(F.col("doc_id").alias("id")), R.vectors(spark, d).select("id"), R.edges(spark, d))


@query("domain_stats", "SELECT lang AS domain, count(*) AS units, count(DISTINCT source) AS records, max(n_chars) AS latest FROM documents GROUP BY 1")
def _(spark, d):
    return R.read(spark, d, "documents").groupBy(F.col("lang").alias("domain")).agg(F.count(F.lit(1)).alias("units"), F.countDistinct("source").alias("records"), F.max("n_chars").alias("latest"))


@query("severity_counts", "SELECT CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS rank, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    name = F.when(F.col("event_type") == "error", " Critical").when(F.col("event_type") == "purchase", "HIGH").when(F.col("event_type") == "signup", "medium").when(F.col("event_type") == "click", "low").otherwise("info")
    return R.read(spark, d, "events").groupBy(X.severity_rank(name).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query("clause_status", f"WITH {R.VECTORS}, s AS (SELECT a.file, CASE WHEN c > 0.88 THEN 'pass' WHEN c < 0.5 THEN 'fail' ELSE 'ambiguous' END AS status FROM (SELECT a.file, list_cosine_similarity(a.embedding, b.embedding) AS c FROM vectors a JOIN vectors b ON b.id = a.id + 1) a) SELECT file, status, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, d):
    v = R.vectors(spark, d)
    b = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return v.join(b, "id").groupBy("file", X.clause_status(X.cosine_signed(F.col("embedding"), F.col("other"))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("field_changes", """WITH h AS (SELECT user_id, props AS b, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_id FROM events) SELECT event_id, CASE WHEN json_extract_string(a, '$.k') <> json_extract_string(b, '$.k') THEN 'k' ELSE '' END AS changed FROM h WHERE a IS NOT NULL""")
def _(spark, d):
    e = R.read(spark, d, "events").withColumn("a", F.lag("props").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).filter("a IS NOT NULL")
    e = e.withColumns({"x": X.json_map(F.col("a")), "y": X.json_map(F.col("props"))})
    return temporal.field_diff(e, "x", "y").select("event_id", F.array_join("fields_changed", ",").alias("changed"))


@query("stable_ids", f"WITH {R.SYMBOLS} SELECT id, sha256(file_path || chr(10) || kind || chr(10) || qualified_name) AS stable_id FROM symbols")
def _(spark, d):
    return R.symbols(spark, d).select("id", X.stable_id(F.col("file_path"), F.col("kind"), F.col("qualified_name")).alias("stable_id"))


@query("event_sessions_text", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def _(spark, d):
    c = R.read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"), F.sum(F.length("text")).alias("chars"))
    return c.select("conv_id", "turns", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"), "chars")


@query("document_units")
def _(spark, d):
    p = R.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    return udfs.parse_documents(p).select("path", "unit_kind", "display_name", "start", "end")


@query("embed_documents")
def _(spark, d):
    e = udfs.embed(R.read(spark, d, "documents"), "text")
    return e.select("doc_id", F.round(X.cosine(F.col("embedding"), F.array(*[F.lit(1.0)] * 32)), 6).alias("cosine_to_ones"))
