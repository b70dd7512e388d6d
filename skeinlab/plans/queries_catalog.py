"""Queries over lookups, notes, intents, recall, health roll-ups and small scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W, functions as F

from skeinlab.functions import exprs as X
from skeinlab.functions import udfs
from skeinlab.operators import catalog, health, recall, reports, search, temporal
from skeinlab.plans import roles as R
from skeinlab.plans.queries_measures import _COUPLING, _coupling
from skeinlab.plans.queries_search import _COS, _query_vector
from skeinlab.plans.registry import query
from skeinlab.sources import tables

# Lookups -----------------------------------------------------------------------------------------------------------

#: Ids asked for: the users of the dearest events. A fixed number of them is the feature, as for any lookup.
_IDS = "ids AS (SELECT DISTINCT user_id AS id FROM events WHERE value > 40)"


def _ids(spark, d):
    return R.read(spark, d, "events").filter("value > 40").select(F.col("user_id").alias("id")).distinct()


@query("symbols_for_ids", f"WITH {R.SYMBOLS}, {_IDS} SELECT id, qualified_name, kind FROM symbols WHERE id IN (SELECT id FROM ids)")
def _(spark, d):
    return catalog.for_ids(R.symbols(spark, d), _ids(spark, d)).select("id", "qualified_name", "kind")


@query("records_for_ids", f"WITH {_IDS} SELECT doc_id AS id, sha256(text) AS blob_hash FROM documents WHERE doc_id IN (SELECT id FROM ids)")
def _(spark, d):
    return catalog.for_ids(R.read(spark, d, "documents").withColumnRenamed("doc_id", "id"), _ids(spark, d)).select("id", F.sha2("text", 256).alias("blob_hash"))


@query("vectors_for_ids", f"WITH {R.VECTORS}, {_IDS} SELECT id, file, round(list_sum(embedding), 4) AS total FROM vectors WHERE id IN (SELECT id FROM ids)")
def _(spark, d):
    return catalog.for_ids(R.vectors(spark, d), _ids(spark, d)).select("id", "file", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("vectors_of_model", f"WITH {R.SYMBOLS}, {R.VECTORS} SELECT v.id, s.file_path, len(v.embedding) AS dims FROM vectors v JOIN symbols s ON s.id = v.id WHERE v.file = 3")
def _(spark, d):
    v = R.vectors(spark, d).filter("file = 3")
    return v.join(R.symbols(spark, d), "id").select("id", "file_path", F.size("embedding").cast("long").alias("dims"))


@query("symbol_by_name", f"WITH {R.SYMBOLS} SELECT id, kind FROM symbols WHERE qualified_name = 'Brand#2::small_ring' ORDER BY file_path, id LIMIT 1")
def _(spark, d):
    return catalog.by_name(R.symbols(spark, d), "Brand#2::small_ring", first=True).select("id", "kind")


@query("symbols_by_name", f"WITH {R.SYMBOLS} SELECT id, kind FROM symbols WHERE qualified_name = 'Brand#2::small_ring'")
def _(spark, d):
    return catalog.by_name(R.symbols(spark, d), "Brand#2::small_ring").select("id", "kind")


_PATHS = "paths AS (SELECT regexp_replace(url, '^https?://|\\?.*$', '', 'g') AS file_path, CASE WHEN regexp_matches(url, '/fr/') THEN 'fr' ELSE 'other' END AS language FROM pages)"


@query("module_files", f"WITH {_PATHS} SELECT DISTINCT file_path FROM paths WHERE language = 'fr' AND (file_path = 'ththre.example.com/fr' OR starts_with(file_path, 'ththre.example.com/fr/'))")
def _(spark, d):
    p = R.read(spark, d, "pages").select(F.regexp_replace("url", r"^https?://|\?.*$", "").alias("file_path"), F.when(F.col("url").contains("/fr/"), "fr").otherwise("other").alias("language"))
    return catalog.module_files(p, "ththre.example.com/fr", "fr")


def _notes(spark, d):
    e = R.read(spark, d, "events")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select("event_id", F.col("event_id").alias("id"), at.alias("created_at"), (F.col("event_type") == "view").alias("is_archived"), F.array(F.concat(F.lit("f"), F.col("user_id") % 7), F.concat(F.lit("f"), F.col("event_id") % 5)).alias("file_refs"), F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 3)).alias("tags"))


_NOTES = "notes AS (SELECT event_id, epoch_us(ts) AS created_at, event_type = 'view' AS is_archived, ['f' || (user_id % 7), 'f' || (event_id % 5)] AS file_refs, [event_type, 'u' || (user_id % 3)] AS tags FROM events)"


@query("notes_list", f"WITH {_NOTES} SELECT event_id, created_at FROM notes WHERE NOT is_archived AND created_at >= 1704500000000000 ORDER BY created_at DESC, event_id DESC LIMIT 200")
def _(spark, d):
    return catalog.notes(_notes(spark, d), 200, since_ms=1704500000000000).select("event_id", "created_at")


@query("notes_for_file", f"WITH {_NOTES} SELECT event_id, created_at FROM notes WHERE NOT is_archived AND list_contains(file_refs, 'f3') ORDER BY created_at DESC, event_id DESC LIMIT 200")
def _(spark, d):
    return catalog.notes(_notes(spark, d), 200, file_ref="f3").select("event_id", "created_at")


@query("notes_with_all_tags", f"WITH {_NOTES} SELECT event_id FROM notes WHERE list_has_all(tags, ['error', 'u1'])")
def _(spark, d):
    return _notes(spark, d).filter(catalog.has_all(F.col("tags"), ["error", "u1"])).select("event_id")


@query("records_with_quality", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS has_record FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    return catalog.with_record(R.read(spark, d, "documents").select("doc_id"), R.read(spark, d, "labels"), "doc_id", ["quality"])


@query("symbols_with_records", f"WITH {R.SYMBOLS} SELECT s.id, s.file_path, d.lang, d.doc_id IS NOT NULL AS has_record FROM symbols s LEFT JOIN documents d ON d.doc_id = s.id")
def _(spark, d):
    docs = R.read(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return catalog.with_record(R.symbols(spark, d).select("id", "file_path"), docs, "id", ["lang"])


@query("history_at_version", f"WITH {R.HISTORY} SELECT symbol_id, sir_hash FROM history WHERE version = 4")
def _(spark, d):
    return catalog.at_version(R.history(spark, d), 4).select("symbol_id", "sir_hash")


@query("history_at_time", f"WITH {R.HISTORY}, h AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY created_us DESC, version DESC) AS r FROM history WHERE created_us <= 1704800000000000) SELECT symbol_id, version, sir_hash FROM h WHERE r = 1")
def _(spark, d):
    return catalog.at_time(R.history(spark, d), 1704800000000000, "created_us").select("symbol_id", "version", "sir_hash")


@query("latest_change_in_window", f"WITH {R.HISTORY} SELECT symbol_id, max(version) AS version FROM history WHERE created_us BETWEEN 1704500000000000 AND 1705500000000000 AND version > 1 GROUP BY 1")
def _(spark, d):
    return catalog.latest_change(R.history(spark, d), F.col("created_us").between(1704500000000000, 1705500000000000))


@query("file_log", f"WITH {R.COMMITS} SELECT commit, commits.at AS at FROM commits WHERE file = 7 ORDER BY 2 DESC, 1 DESC LIMIT 50")
def _(spark, d):
    return catalog.file_log(R.commits(spark, d), 7, 50)


@query("commit_files", f"WITH {R.COMMITS} SELECT DISTINCT file FROM commits WHERE commit = 11 AND file % 5 <> 0")
def _(spark, d):
    return catalog.commit_files(R.commits(spark, d), 11, F.col("file") % 5 == 0)


_SNAP = "a AS (SELECT l_suppkey AS path, max(l_extendedprice) AS content FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_suppkey AS path, max(l_extendedprice) AS content FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)"


@query("changed_paths", f"WITH {_SNAP} SELECT path FROM a FULL JOIN b USING (path) WHERE a.content IS DISTINCT FROM b.content")
def _(spark, d):
    snap = lambda keep: R.read(spark, d, "lineitem").filter(keep).groupBy(F.col("l_suppkey").alias("path")).agg(F.max("l_extendedprice").alias("content"))
    return catalog.changed_between(snap("l_linestatus = 'F'"), snap("l_returnflag <> 'N'"))


@query("restored_keys", "SELECT e.event_id, coalesce(c.c_name, CAST(e.user_id AS VARCHAR)) AS key FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_nationkey < 12")
def _(spark, d):
    results = R.read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"))
    keymap = R.read(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("short"), F.col("c_name").alias("full_key"))
    return catalog.restore_keys(results, keymap)


@query("fingerprints_of_batch", f"WITH {R.FINGERPRINTS} SELECT id, symbol_id, delta_sem FROM fp WHERE ts_us // 3600000000 = 473418")
def _(spark, d):
    return R.fingerprints(spark, d).filter(F.floor(F.col("ts_us") / 3600000000) == 473418).select("id", "symbol_id", "delta_sem")


@query("newest_metrics", f"WITH {R.FINGERPRINTS} SELECT id, ts_us FROM fp ORDER BY ts_us DESC, id DESC LIMIT 100")
def _(spark, d):
    return catalog.newest(R.fingerprints(spark, d), "ts_us", 100).select("id", "ts_us")


# Intents and queues --------------------------------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'view' THEN 'complete' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'sqlite_done' WHEN 'purchase' THEN 'graph_done' ELSE 'pending' END"
_INTENTS = f"intents AS (SELECT event_id AS intent_id, epoch_us(ts) AS created_at, {_STATUS} AS status FROM events)"


def _intents(spark, d):
    status = F.when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "sqlite_done").when(F.col("event_type") == "purchase", "graph_done").otherwise("pending")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return R.read(spark, d, "events").select(F.col("event_id").alias("intent_id"), at.alias("created_at"), status.alias("status"), F.lit(None).cast("long").alias("completed_at"), "user_id")


@query("intents_by_status", f"WITH {_INTENTS} SELECT status, count(*) AS n FROM intents GROUP BY 1")
def _(spark, d):
    return catalog.count_by(_intents(spark, d), "status")


@query("incomplete_intents", f"WITH {_INTENTS} SELECT intent_id, status FROM intents WHERE status NOT IN ('complete', 'failed')")
def _(spark, d):
    return catalog.incomplete_intents(_intents(spark, d)).select("intent_id", "status")


@query("replayed_intents", f"""WITH {_INTENTS} SELECT intent_id, CASE status WHEN 'pending' THEN 'sqlite_done' WHEN 'sqlite_done' THEN 'vector_done' WHEN 'vector_done' THEN 'graph_done' WHEN 'graph_done' THEN 'complete' ELSE 'pending' END AS next_status
FROM intents WHERE status <> 'complete' ORDER BY created_at, intent_id LIMIT 100""")
def _(spark, d):
    return catalog.replay_intents(_intents(spark, d), failed_too=True).select("intent_id", "next_status")


@query("updated_intents", f"WITH {_INTENTS}, u AS (SELECT intent_id, CASE WHEN intent_id % 2 = 0 THEN 'complete' ELSE 'vector_done' END AS to_status FROM intents WHERE status = 'sqlite_done') SELECT i.intent_id, coalesce(to_status, status) AS status, CASE WHEN to_status = 'complete' THEN 99 END AS completed_at FROM intents i LEFT JOIN u USING (intent_id)")
def _(spark, d):
    i = _intents(spark, d)
    u = i.filter("status = 'sqlite_done'").select("intent_id", F.when(F.col("intent_id") % 2 == 0, "complete").otherwise("vector_done").alias("status"))
    return catalog.update_status(i, u, 99).select("intent_id", "status", "completed_at")


@query("queue_pop", "SELECT event_id AS id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 25")
def _(spark, d):
    head, _ = catalog.pop(R.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), F.col("event_id").alias("seq")), 25)
    return head.select("id", "score")


@query("dismissed_recurrences", "SELECT count(*) AS n FROM events WHERE user_id = 5 AND event_type = 'error' AND value < 30")
def _(spark, d):
    return R.read(spark, d, "events").filter("user_id = 5 AND event_type = 'error' AND value < 30").agg(F.count(F.lit(1)).alias("n"))


@query("tests_by_symbol", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return catalog.count_by(R.read(spark, d, "lineitem"), "l_partkey")


@query("structural_events", f"WITH {R.SYMBOLS} SELECT file_path, count(*) AS n, max(price) AS latest FROM symbols WHERE price >= 950 GROUP BY 1 ORDER BY latest DESC, file_path LIMIT 50")
def _(spark, d):
    return catalog.structural_events(R.symbols(spark, d), "price", 950)


# Recall and ranking --------------------------------------------------------------------------------------------------

_NOW = 1706745600000
_FACTS = "facts AS (SELECT doc_id AS id, n_chars AS accesses, CASE WHEN doc_id % 3 = 0 THEN 1706745600000 - doc_id * 10000000 END AS last_ms FROM documents)"
_LISTS = f"""{R.VECTORS}, {_FACTS}, lex AS (SELECT * FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY source, doc_id) AS rank FROM documents WHERE contains(lower(text), 'the')) WHERE rank <= 100),
sem AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY {_COS} DESC, id) AS rank, {_COS} AS similarity FROM vectors v) WHERE rank <= 100)"""
_BOOST = "greatest(base, 0) * (1 + 0.1 * coalesce(greatest(0, least(1, 1 - greatest(1706745600000 - last_ms, 0) / 2592000000.0)), 0) + 0.05 * ln(greatest(accesses, 0) + 1) / ln(100))"


def _lists(spark, d):
    docs = R.read(spark, d, "documents").withColumnRenamed("doc_id", "id")
    facts = docs.select("id", F.col("n_chars").alias("accesses"), F.when(F.col("id") % 3 == 0, F.lit(_NOW) - F.col("id") * 10000000).alias("last_ms"))
    lex = search.lexical(docs, "the", ["text"], ["source", "id"], 100).select("id", "rank")
    sem = search.ranked(search.vector_topk(R.vectors(spark, d), _query_vector(spark, d), 100), F.col("score").desc(), F.col("id")).select("id", "rank", F.col("score").alias("similarity"))
    return lex, sem, facts


def _recalled(mode):
    def run(spark, d):
        lex, sem, facts = _lists(spark, d)
        out, _ = recall.recall(lex, sem, facts, mode, _NOW, 30)
        return out.select("id", F.round("score", 6).alias("score"))

    return run


for _mode, _base in (("lexical", "SELECT id, 1.0 / (60 + rank) AS base FROM lex"), ("semantic", "SELECT id, similarity AS base FROM sem"), ("hybrid", "SELECT id, sum(1.0 / (60 + rank)) AS base FROM (SELECT id, rank FROM lex UNION ALL SELECT id, rank FROM sem) GROUP BY 1")):
    query(f"recall_{_mode}", f"WITH {_LISTS}, b AS ({_base}) SELECT id, round({_BOOST}, 6) AS score FROM b JOIN facts USING (id) ORDER BY {_BOOST} DESC, CAST(id AS VARCHAR) LIMIT 30")(_recalled(_mode))


@query("rank_candidates", f"WITH {_LISTS}, b AS (SELECT id, sum(1.0 / (60 + rank)) AS base FROM (SELECT id, rank FROM lex UNION ALL SELECT id, rank FROM sem) GROUP BY 1) SELECT 'note:' || id AS key, id, round({_BOOST}, 6) AS score FROM b JOIN facts USING (id) ORDER BY {_BOOST} DESC, 'note:' || id LIMIT 50")
def _(spark, d):
    lex, sem, facts = _lists(spark, d)
    return recall.rank_candidates(lex, sem, facts, _NOW, "note", 50).withColumn("score", F.round("score", 6))


@query("rank_tests", "SELECT 'test:' || conv_id || '/' || turn AS key, conv_id || '/' || turn AS id, round(1.0 / (60 + row_number() OVER (ORDER BY conv_id, turn)), 8) AS score FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 100")
def _(spark, d):
    c = R.read(spark, d, "conversations").withColumn("id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return recall.rank_tests(search.lexical(c, "the", ["text"], ["conv_id", "turn"], 100)).withColumn("score", F.round("score", 8))


@query("rank_coupled", f"""WITH {_COUPLING}, seeds AS (SELECT DISTINCT file FROM (SELECT s_suppkey AS file FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10)),
o AS (SELECT file_a AS anchor, file_b AS file, fused_score FROM risked UNION ALL SELECT file_b, file_a, fused_score FROM risked)
SELECT file, round(max(least(1, greatest(0, fused_score))), 6) AS score FROM o WHERE anchor IN (SELECT file FROM seeds) GROUP BY 1""")
def _(spark, d):
    seeds = R.read(spark, d, "supplier").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(10).select(F.col("s_suppkey").alias("file"), F.row_number().over(W.orderBy(F.col("s_acctbal").desc(), "s_suppkey")).alias("rank"))
    return recall.rank_coupled(_coupling(spark, d), seeds).select("file", F.round("score", 6).alias("score"))


@query("task_symbols")
def _(spark, d):
    lex, sem, _ = _lists(spark, d)
    return recall.task_symbols(sem, lex, R.edges(spark, d)).select("id", F.round("score", 10).alias("score"))


@query("prepared_order", "WITH x AS (SELECT doc_id, text, lower(text) AS t FROM documents), s AS (SELECT doc_id, text, CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INTEGER) AS relevance FROM x) SELECT doc_id, relevance FROM s ORDER BY relevance DESC, text, doc_id LIMIT 100")
def _(spark, d):
    return recall.prepared_order(R.read(spark, d, "documents"), reports.relevance(F.col("text"), ["the", "of"]), "text", "doc_id").limit(100).select("doc_id", "relevance")


@query("rerank_texts", "SELECT p_partkey, sha256(CASE WHEN trim(p_type) = '' THEN '' ELSE trim(p_type) || chr(10) END || 'qualified_name: ' || p_name || chr(10) || 'kind: ' || p_brand || chr(10) || 'file_path: ' || p_size) AS text_hash FROM part")
def _(spark, d):
    return R.read(spark, d, "part").select("p_partkey", F.sha2(X.rerank_text(F.col("p_type"), F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")), 256).alias("text_hash"))


@query("symbol_catalog", f"""WITH {R.SYMBOLS}, {R.edges_sql()}, n AS (SELECT target_id AS id, count(DISTINCT source_id) AS dependents FROM edges GROUP BY 1)
SELECT id, dependents, row_number() OVER (ORDER BY price DESC, dependents DESC, qualified_name, id) AS place FROM (SELECT s.id, s.qualified_name, s.price, coalesce(n.dependents, 0) AS dependents FROM symbols s LEFT JOIN n ON n.id = s.id) ORDER BY place LIMIT 100""")
def _(spark, d):
    s = R.symbols(spark, d)
    return catalog.ranked_catalog(s, s.select("id", F.col("price").alias("centrality")), R.edges(spark, d), 100).select("id", "dependents", "place")


@query("semantic_drift", f"WITH {R.VECTORS}, p AS (SELECT a.id, list_cosine_similarity(a.embedding, b.embedding) AS similarity FROM vectors a JOIN vectors b ON b.id = a.id + 1) SELECT id, round(similarity, 6) AS similarity FROM p WHERE 1 - similarity >= 0.9")
def _(spark, d):
    v = R.vectors(spark, d)
    now, then = v.select("id", F.col("embedding").alias("now")), v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("then"))
    return catalog.semantic_drift(now, then, X.cosine(F.col("now"), F.col("then")), 0.9).select("id", F.round("similarity", 6).alias("similarity"))


# Health --------------------------------------------------------------------------------------------------------------

_CRATE_FILES = "f AS (SELECT s_nationkey AS crate, (s_suppkey % 10) / 10.0 AS churn_30d, (s_suppkey % 7) / 7.0 AS churn_90d, (s_suppkey % 3) / 3.0 AS author_count, (s_suppkey % 11) / 11.0 AS blame_age_spread FROM supplier)"


@query("crate_git_signals", f"WITH {_CRATE_FILES}, g AS (SELECT crate, max(churn_30d) AS a, max(churn_90d) AS b, max(author_count) AS c, avg(blame_age_spread) AS e FROM f GROUP BY 1) SELECT crate, round(e, 6) AS blame_age_spread, round(greatest(0, least(1, a * 0.35 + b * 0.25 + c * 0.25 + e * 0.15)), 6) AS git_pressure FROM g")
def _(spark, d):
    k = F.col("s_suppkey")
    f = R.read(spark, d, "supplier").select(F.col("s_nationkey").alias("crate"), (k % 10 / 10).alias("churn_30d"), (k % 7 / 7).alias("churn_90d"), (k % 3 / 3).alias("author_count"), (k % 11 / 11).alias("blame_age_spread"))
    return health.crate_git_signals(f).select("crate", F.round("blame_age_spread", 6).alias("blame_age_spread"), F.round("git_pressure", 6).alias("git_pressure"))


@query("crate_metrics", """WITH f AS (SELECT lang AS crate, doc_id AS path, n_chars AS loc, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, doc_id % 4 AS todos, doc_id % 9 AS trait_methods FROM documents)
SELECT crate, count(*) AS file_count, sum(loc) AS total_loc, sum(lines) AS total_lines, max(loc) AS max_file_loc, arg_min(path, (-loc, path)) AS max_file_path, max(trait_methods) AS trait_method_max, round(CASE WHEN sum(loc) > 0 THEN sum(todos) * 1000.0 / sum(loc) ELSE 0 END, 6) AS todo_density FROM f GROUP BY 1""")
def _(spark, d):
    t = F.col("text")
    f = R.read(spark, d, "documents").select(F.col("lang").alias("crate"), F.col("doc_id").alias("path"), F.col("n_chars").alias("loc"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), (F.col("doc_id") % 4).alias("todos"), (F.col("doc_id") % 9).alias("trait_methods"))
    return health.crate_metrics(f).withColumn("todo_density", F.round("todo_density", 6))


@query("top_violations", "SELECT s_name AS crate, CASE WHEN s_suppkey % 2 = 0 THEN 'loc' ELSE 'churn' END AS metric, s_acctbal AS value FROM supplier ORDER BY CASE WHEN s_nationkey > 20 THEN 4 WHEN s_nationkey > 10 THEN 3 ELSE 2 END DESC, value DESC, crate, metric LIMIT 5")
def _(spark, d):
    level = F.when(F.col("s_nationkey") > 20, "critical").when(F.col("s_nationkey") > 10, "high").otherwise("medium")
    c = R.read(spark, d, "supplier").select(F.col("s_name").alias("crate"), F.array(F.struct(F.when(F.col("s_suppkey") % 2 == 0, "loc").otherwise("churn").alias("metric"), level.alias("severity"), F.col("s_acctbal").alias("value"))).alias("violations"))
    return health.top_violations(c).select("crate", "metric", "value")


@query("centrality_by_file", f"WITH {R.SYMBOLS} SELECT file_path, max(price) AS max_centrality, count(*) AS n_symbols FROM symbols GROUP BY 1")
def _(spark, d):
    s = R.symbols(spark, d)
    return health.centrality_by_file(s, s.select("id", F.col("price").alias("centrality")))


_RISKED = "x AS (SELECT p_partkey AS id, p_retailprice AS pagerank, p_size % 5 AS tests, (p_size % 13) / 10.0 AS drift, p_size % 2 = 0 AS has_record, (p_size % 7) / 7.0 AS recency FROM part), m AS (SELECT max(pagerank) AS top FROM x)"


def _risked(spark, d):
    s = F.col("p_size")
    return R.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pagerank"), (s % 5).alias("tests"), (s % 13 / 10).alias("drift"), (s % 2 == 0).alias("has_record"), (s % 7 / 7).alias("recency"))


@query("symbol_health", f"WITH {_RISKED} SELECT id, round(0.3 * pagerank / top + 0.25 * (1 - least(1, tests / 3.0)) + 0.2 * least(1, drift) + CASE WHEN has_record THEN 0 ELSE 0.15 END + 0.1 * recency, 6) AS risk FROM x, m")
def _(spark, d):
    return health.symbol_health(_risked(spark, d)).select("id", F.round("risk", 6).alias("risk"))


_RISK = "greatest(0, least(1, pagerank / top * 0.45 + least(1, drift) * 0.35 + CASE WHEN tests > 0 THEN 0 ELSE 0.2 END + CASE WHEN has_record THEN 0 ELSE 0.2 END))"


@query("hotspots", f"""WITH {_RISKED}, r AS (SELECT id, {_RISK} AS risk, array_to_string(list_filter([CASE WHEN pagerank >= 0.7 * top THEN 'high_pagerank' END, CASE WHEN drift >= 0.3 THEN 'semantic_drift' END, CASE WHEN NOT has_record THEN 'missing_sir' END, CASE WHEN tests <= 0 THEN 'no_tests' END], lambda z: z IS NOT NULL), ',') AS f FROM x, m)
SELECT id, round(risk, 6) AS risk, CASE WHEN f = '' THEN 'stable' ELSE f END AS factors FROM r ORDER BY r.risk DESC, id LIMIT 10""")
def _(spark, d):
    return health.hotspots(_risked(spark, d)).select("id", F.round("risk", 6).alias("risk"), "factors")


_METRICS = f"""{R.SYMBOLS}, {R.edges_sql()}, t AS (SELECT count(*) AS n FROM symbols), r AS (SELECT count(*) AS r FROM symbols WHERE id IN (SELECT doc_id FROM documents)),
o AS (SELECT count(*) AS orphan_count FROM symbols WHERE id NOT IN (SELECT source_id FROM edges) AND id NOT IN (SELECT target_id FROM edges)), dr AS (SELECT greatest(0, least(1, avg(value / 100))) AS avg_drift_score FROM events)"""


def _metrics(spark, d):
    records = R.read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return health.index_metrics(R.symbols(spark, d), records, R.read(spark, d, "events").select((F.col("value") / 100).alias("drift")), R.edges(spark, d))


@query("index_metrics", f"WITH {_METRICS} SELECT round(100.0 * r / n, 6) AS sir_coverage, round(100.0 * (n - r) / n, 6) AS stale_sir_pct, orphan_count, round(avg_drift_score, 6) AS avg_drift_score FROM t, r, o, dr")
def _(spark, d):
    return _metrics(spark, d).select(*[F.round(c, 6).alias(c) for c in ("sir_coverage", "stale_sir_pct")], "orphan_count", F.round("avg_drift_score", 6).alias("avg_drift_score"))


@query("health_scorecard", f"""WITH {_METRICS}, v AS (SELECT 100.0 * r / n AS a, 100.0 * (n - r) / n AS b, CAST(orphan_count AS DOUBLE) AS c, avg_drift_score AS e FROM t, r, o, dr),
s AS (SELECT 'sir_coverage' AS name, a AS value, CASE WHEN a > 90 THEN 'good' WHEN a > 70 THEN 'warn' ELSE 'critical' END AS status FROM v UNION ALL SELECT 'stale_sir_pct', b, CASE WHEN b < 10 THEN 'good' WHEN b < 30 THEN 'warn' ELSE 'critical' END FROM v
UNION ALL SELECT 'orphan_count', c, CASE WHEN c < 5 THEN 'good' WHEN c < 20 THEN 'warn' ELSE 'critical' END FROM v UNION ALL SELECT 'avg_drift_score', e, CASE WHEN e < 0.15 THEN 'good' WHEN e < 0.3 THEN 'warn' ELSE 'critical' END FROM v)
SELECT name, round(value, 6) AS value, status FROM s UNION ALL SELECT 'overall', NULL, CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'good' END FROM s""")
def _(spark, d):
    return health.scorecard(_metrics(spark, d)).withColumn("value", F.round("value", 6))


@query("difficulty_summary", "WITH x AS (SELECT CASE p_size % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'moderate' WHEN 2 THEN 'hard' ELSE 'very_hard' END AS label FROM part) SELECT label, count(*) AS n, CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM x) + 0.5) AS BIGINT) AS percentage FROM x GROUP BY 1")
def _(spark, d):
    s = F.col("p_size") % 4
    return health.difficulty_summary(R.read(spark, d, "part").select(F.when(s == 0, "easy").when(s == 1, "moderate").when(s == 2, "hard").otherwise("very_hard").alias("label")))


@query("score_trend", "WITH r AS (SELECT o_orderdate AS run_at, o_orderkey, CAST(o_totalprice AS BIGINT) AS score FROM orders), u AS (SELECT run_at, max(score) AS score FROM r GROUP BY 1), l AS (SELECT * FROM u ORDER BY run_at DESC LIMIT 9) SELECT array_to_string(list_append(list(score ORDER BY run_at), 77), ',') AS trend FROM l")
def _(spark, d):
    runs = R.read(spark, d, "orders").groupBy(F.col("o_orderdate").alias("run_at")).agg(F.max(F.bround("o_totalprice").cast("long")).alias("score")).withColumn("commit", F.col("run_at").cast("string"))
    return health.trend(runs, 77, "now").select(F.array_join(F.transform("trend", lambda x: x.cast("string")), ",").alias("trend"))


@query("aftershock_predictions", f"""WITH {R.edges_sql()}, {R.SYMBOLS}, s AS (SELECT user_id AS id, least(1.0, value / 100) AS delta FROM events WHERE least(1.0, value / 100) > 0.4), e AS (SELECT DISTINCT source_id, target_id FROM edges)
SELECT e.source_id AS target_symbol_id, round(1 / (1 + exp(-(-1.5 + 2.0 * s.delta + 0.2 + 0.3 + 0.0005 * y.price))), 6) AS probability FROM s JOIN e ON e.target_id = s.id JOIN symbols y ON y.id = e.source_id WHERE -1.5 + 2.0 * s.delta + 0.5 + 0.0005 * y.price > 0 ORDER BY 1 / (1 + exp(-(-1.5 + 2.0 * s.delta + 0.2 + 0.3 + 0.0005 * y.price))) DESC, 1 LIMIT 50""")
def _(spark, d):
    shifts = R.read(spark, d, "events").select(F.col("user_id").alias("id"), F.least(F.lit(1.0), F.col("value") / 100).alias("delta"))
    out = health.aftershocks(shifts, R.edges(spark, d), R.symbols(spark, d).select("id", F.col("price").alias("pagerank")), [-1.5, 2.0, 0.2, 0.3, 0.0005], 0.4)
    return out.withColumn("probability", F.round("probability", 6))


@query("community_confidence", "WITH x AS (SELECT p_partkey, p_size % 5 AS r, p_size % 7 AS l, p_size % 11 AS n, (p_size % 3) / 3.0 AS e, (p_size % 4) / 4.0 AS s FROM part) SELECT p_partkey, CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0, least(1, 1 - 0.3 * r / n - 0.2 * l / n - 0.2 * (1 - e) - 0.3 * (1 - s) - 0.05)), 6) END AS confidence FROM x")
def _(spark, d):
    s = F.col("p_size")
    return R.read(spark, d, "part").select("p_partkey", F.round(health.confidence(s % 5, s % 7, s % 11, s % 3 / 3, s % 4 / 4, F.lit(0.05)), 6).alias("confidence"))


@query("filtered_dependencies", """WITH d AS (SELECT DISTINCT l_suppkey AS trait, l_orderkey AS method, l_shipmode AS dependency FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)), m AS (SELECT trait, count(DISTINCT method) AS n FROM d GROUP BY 1),
c AS (SELECT trait, dependency FROM d JOIN m USING (trait) GROUP BY trait, dependency, n HAVING count(*) / n > 0.3) SELECT * FROM d WHERE (trait, dependency) NOT IN (SELECT trait, dependency FROM c)""")
def _(spark, d):
    li = R.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("trait"), F.col("l_orderkey").alias("method"), F.concat("l_returnflag", "l_linestatus").alias("dependency"))
    return health.filtered_dependencies(li, 0.3)


_FUSED = "x AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN [] ELSE list_distinct([p_size % 3, p_size % 5]) END AS a, CASE WHEN p_size % 4 = 0 THEN [] ELSE list_distinct([p_size % 2, p_size % 7]) END AS b, list_distinct([p_size % 2, p_size % 5]) AS u, list_distinct([p_size % 3, p_size % 4]) AS v FROM part)"


@query("fused_similarity", f"WITH {_FUSED}, j AS (SELECT p_partkey, len(a) AS n, len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) AS dj, len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) AS cj FROM x) SELECT p_partkey, round(CASE WHEN n = 0 THEN cj ELSE 0.75 * dj + 0.25 * cj END, 6) AS similarity FROM j")
def _(spark, d):
    s = F.col("p_size")
    none = F.array().cast("array<int>")
    pair = lambda x, y: F.array_distinct(F.array(s % x, s % y))
    a, b = F.when(s % 4 == 0, none).otherwise(pair(3, 5)), F.when(s % 4 == 0, none).otherwise(pair(2, 7))
    return R.read(spark, d, "part").select("p_partkey", F.round(health.fused_similarity(a, b, pair(2, 5), pair(3, 4)), 6).alias("similarity"))


@query("group_affinity", f"""WITH {R.VECTORS}, u AS (SELECT file, unnest(range(len(embedding))) AS k, unnest(embedding) / sqrt(list_dot_product(embedding, embedding)) AS x FROM vectors), s AS (SELECT file, k, sum(x) AS s FROM u GROUP BY 1, 2), n AS (SELECT file, count(*) AS n FROM vectors GROUP BY 1)
SELECT a.file AS a, b.file AS b, round(sum(a.s * b.s) / max(x.n * y.n), 6) AS affinity FROM s a JOIN s b ON a.k = b.k AND b.file = a.file + 1 JOIN n x ON x.file = a.file JOIN n y ON y.file = b.file GROUP BY 1, 2""")
def _(spark, d):
    v = R.vectors(spark, d).withColumnRenamed("file", "group")
    g = v.select(F.col("group").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return health.group_affinity(v, g).select("a", "b", F.round("affinity", 6).alias("affinity"))


# Scalars -------------------------------------------------------------------------------------------------------------


@query("scalar_paths", "SELECT page_id, sha256(trim(lower(page_id % 3 || 'X')) || '') AS lang_hash, 'file::' || url AS source_id, sha256('module:fr:' || replace(url, '/', '/')) AS synthetic FROM pages")
def _(spark, d):
    odd = F.replace("url", F.lit("/"), F.lit("\\"))
    return R.read(spark, d, "pages").select("page_id", F.sha2(F.lower(F.concat((F.col("page_id") % 3).cast("string"), F.lit("X"))), 256).alias("lang_hash"), X.file_source_id(X.normalize_path(odd)).alias("source_id"), X.synthetic_id(F.lit(" module "), F.lit("FR"), odd).alias("synthetic"))


@query("record_faults", """WITH x AS (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN '  ' ELSE p_name END AS intent, p_size / 40.0 AS confidence, CASE p_size % 4 WHEN 0 THEN ' hIGH' WHEN 1 THEN 'huge' WHEN 2 THEN NULL ELSE 'low' END AS c FROM part)
SELECT p_partkey, CASE WHEN trim(intent) = '' THEN 'empty_intent' WHEN confidence > 1 THEN 'invalid_confidence' WHEN c = 'huge' THEN 'invalid_complexity' END AS fault, CASE c WHEN ' hIGH' THEN 'High' WHEN 'low' THEN 'Low' END AS label FROM x""")
def _(spark, d):
    s = F.col("p_size")
    c = F.when(s % 4 == 0, " hIGH").when(s % 4 == 1, "huge").when(s % 4 == 3, "low")
    return R.read(spark, d, "part").select("p_partkey", X.record_fault(F.when(s % 6 == 0, "  ").otherwise(F.col("p_name")), s / 40, c).alias("fault"), X.complexity_label(c).alias("label"))


@query("deprecated_models", "SELECT o_orderkey, o_orderpriority IN ('5-LOW', '1-URGENT') AS deprecated FROM orders")
def _(spark, d):
    return R.read(spark, d, "orders").select("o_orderkey", X.is_deprecated(F.concat(F.lit(" "), F.lower("o_orderpriority")), ("5-LOW", "1-urgent")).alias("deprecated"))


@query("valid_edge_types", f"WITH {R.edges_sql()} SELECT edge_kind, count(*) AS n FROM edges WHERE edge_kind IN ('calls', 'depends_on') GROUP BY 1")
def _(spark, d):
    return catalog.count_by(R.edges(spark, d).filter(X.is_edge_type(F.upper("edge_kind"), ["Calls", "DEPENDS_ON"])), "edge_kind")


@query("days_of_millis", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, d):
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000)
    return R.read(spark, d, "events").select("event_id", X.millis_to_day(ms).alias("day"))


@query("iso_to_millis", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN epoch_ms(o_orderdate) - CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 7200000 END END AS ms FROM orders")
def _(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("+02:00")))
    return R.read(spark, d, "orders").select("o_orderkey", X.iso_to_millis(raw).alias("ms"))


@query("dependency_entries", "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 4 < 3 THEN p_type END AS reason FROM part")
def _(spark, d):
    n, t, k = F.col("p_name"), F.col("p_type"), F.col("p_size") % 4
    raw = F.when(k == 0, F.concat(n, F.lit(": ("), t, F.lit(")"))).when(k == 1, F.concat(F.lit(" "), n, F.lit(" - "), t)).when(k == 2, F.concat(n, F.lit(" ("), t, F.lit(" )"))).otherwise(n)
    e = R.read(spark, d, "part").select("p_partkey", X.dependency_entry(raw).alias("e"))
    return e.select("p_partkey", "e.name", "e.reason")


@query("diff_summaries", "WITH x AS (SELECT p_partkey, p_name, p_type, CASE WHEN p_size % 2 = 0 THEN [p_brand] ELSE [] END AS a FROM part) SELECT p_partkey, sha256(array_to_string(list_filter([CASE WHEN p_name <> p_type THEN 'purpose changed: ''' || p_name || ''' -> ''' || p_type || '''' END, CASE WHEN len(a) > 0 THEN 'edge_cases added: ' || a[1] END], lambda z: z IS NOT NULL), '; ')) AS summary_hash FROM x")
def _(spark, d):
    a = F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    return R.read(spark, d, "part").select("p_partkey", F.sha2(X.diff_summary(F.col("p_name"), F.col("p_type"), {"edge_cases": a}, {"edge_cases": F.array().cast("array<string>")}), 256).alias("summary_hash"))


@query("events_of_period", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def _(spark, d):
    since = catalog.cutoff(dt.datetime(2024, 1, 31), " 7D ")
    return R.read(spark, d, "events").filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).select("event_id")


@query("places_in_file", f"WITH {R.SYMBOLS} SELECT id, row_number() OVER (PARTITION BY file_path ORDER BY price DESC, id) AS place FROM symbols")
def _(spark, d):
    return recall.within_groups(R.symbols(spark, d), "file_path", [F.col("price").desc(), "id"]).select("id", "place")


# Change events -------------------------------------------------------------------------------------------------------


@query("quiet_points", f"WITH {R.FINGERPRINTS}, x AS (SELECT id, symbol_id, ts_us, lead(ts_us) OVER (PARTITION BY symbol_id ORDER BY ts_us) AS later FROM fp) SELECT id, symbol_id FROM x WHERE later IS NULL OR later - ts_us >= 14400000000")
def _(spark, d):
    return temporal.quiet_points(R.fingerprints(spark, d), "ts_us", 14400000000, "symbol_id").select("id", "symbol_id")


@query("held_file_events", f"""WITH {R.FINGERPRINTS}, x AS (SELECT id, symbol_id, ts_us, trigger, max(CASE WHEN trigger = 'error' THEN ts_us END) OVER (PARTITION BY symbol_id ORDER BY ts_us, trigger <> 'error' ROWS UNBOUNDED PRECEDING) AS git FROM fp)
SELECT CAST(id AS VARCHAR) AS path, coalesce(ts_us - git < 14400000000, false) AS held FROM x WHERE trigger <> 'error'""")
def _(spark, d):
    fp = R.fingerprints(spark, d)
    files = fp.filter("trigger <> 'error'").select("symbol_id", "ts_us", F.col("id").cast("string").alias("path"))
    return temporal.held_back(files, fp.filter("trigger = 'error'"), "ts_us", 14400000000, "symbol_id").select("path", "held")


_CHANGED = "c AS (SELECT id, qualified_name, file_path, 'changed' AS kind, size, price FROM symbols WHERE id % 10 = 1), g AS (SELECT id FROM symbols WHERE id % 10 = 2)"


def _applied(spark, d):
    s, e = R.symbols(spark, d), R.edges(spark, d)
    changed = s.filter("id % 10 = 1").withColumn("kind", F.lit("changed"))
    new = changed.select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("calls").alias("edge_kind"))
    return tables.apply_changes(s, e, changed, new, s.filter("id % 10 = 2").select("id"))


@query("changed_symbols", f"WITH {R.SYMBOLS}, {_CHANGED} SELECT id, kind FROM symbols WHERE id % 10 NOT IN (1, 2) UNION ALL SELECT id, kind FROM c")
def _(spark, d):
    return _applied(spark, d)[0].select("id", "kind")


@query("changed_edges", f"WITH {R.SYMBOLS}, {R.edges_sql()}, {_CHANGED} SELECT source_id, count(*) AS n FROM (SELECT source_id FROM edges WHERE source_id % 10 NOT IN (1, 2) UNION ALL SELECT id FROM c) GROUP BY 1")
def _(spark, d):
    return catalog.count_by(_applied(spark, d)[1], "source_id")


_SIDES = "s AS (SELECT c_custkey AS id, c_mktsegment AS source_hash, CAST(c_nationkey AS VARCHAR) AS neighbor_hash FROM customer), a AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'x' ELSE source_hash END AS source_hash, CASE WHEN id % 6 = 0 THEN 'y' ELSE neighbor_hash END AS neighbor_hash FROM s), b AS (SELECT * FROM s WHERE id % 5 <> 0)"


@query("change_records", f"WITH {_SIDES} SELECT a.id, a.source_hash IS DISTINCT FROM b.source_hash AS source_changed, a.neighbor_hash IS DISTINCT FROM b.neighbor_hash AS neighbor_changed, b.id IS NULL AS config_changed FROM a LEFT JOIN b USING (id) WHERE b.id IS NULL OR a.source_hash <> b.source_hash OR a.neighbor_hash <> b.neighbor_hash")
def _(spark, d):
    s = R.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("source_hash"), F.col("c_nationkey").cast("string").alias("neighbor_hash"), F.lit("c").alias("config_hash"), F.array(F.lit(1.0), F.col("c_acctbal")).alias("embedding"))
    hashed = lambda df: df.withColumn("prompt_hash", F.sha2(F.concat_ws("/", "source_hash", "neighbor_hash", "config_hash"), 256))
    after = s.withColumn("source_hash", F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("source_hash"))).withColumn("neighbor_hash", F.when(F.col("id") % 6 == 0, "y").otherwise(F.col("neighbor_hash")))
    out = tables.change_records(hashed(s.filter("id % 5 <> 0")), hashed(after), "batch", 7, X.cosine(F.col("old_embedding"), F.col("embedding")))
    return out.select("id", "source_changed", "neighbor_changed", "config_changed")


@query("copied_rows", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    o = R.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return tables.copy_missing(o, o.filter("o_orderstatus = 'F'"), ["o_orderkey"])


@query("annotated_units", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')[:12], ' ') AS intent, round(least(1.0, length(text) / 200.0), 6) AS confidence FROM documents")
def _(spark, d):
    u = R.read(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return udfs.annotate(u).select("doc_id", "intent", F.round("confidence", 6).alias("confidence"))


@query("summaries", "WITH x AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name DESC) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_name AS summary, n FROM x WHERE r = 1")
def _(spark, d):
    return udfs.summarize(R.read(spark, d, "part"), "p_brand", "p_name")
