"""Queries over search and join operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from skeinlab.functions import exprs as X
from skeinlab.operators import joins, search, vector_index
from skeinlab.plans import roles as R
from skeinlab.plans.registry import query
from skeinlab.session import shared_folder

_DOC_ORDER = "ORDER BY source, doc_id"


@query("lexical_search", f"""SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER ({_DOC_ORDER}) AS rank FROM documents
WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')) WHERE rank <= 50""")
def _(spark, d):
    docs = R.read(spark, d, "documents")
    return search.lexical(docs, "License", ["text", "source"], ["source", "doc_id"], 50).select("doc_id", "source", "rank")


@query("lexical_terms", """SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'secret') ORDER BY doc_id DESC LIMIT 40""")
def _(spark, d):
    return search.lexical_terms(R.read(spark, d, "documents"), "token, secret!", ["text"], [F.col("doc_id").desc()], 40).select("doc_id", "lang")


@query("symbol_search", f"""WITH {R.SYMBOLS} SELECT id, qualified_name, file_path FROM symbols WHERE contains(lower(qualified_name), 'ring') OR contains(lower(file_path), 'ring') OR contains(kind, 'ring') ORDER BY qualified_name, id LIMIT 60""")
def _(spark, d):
    return search.lexical(R.symbols(spark, d), "ring", ["qualified_name", "file_path", "kind"], ["qualified_name", "id"], 60).select("id", "qualified_name", "file_path")


def _query_vector(spark, d, k=0):
    return [float(x) for x in R.vectors(spark, d).filter(F.col("id") == k).first().embedding]


_COS = "list_cosine_similarity(v.embedding, (SELECT embedding FROM vectors WHERE id = 0))"


@query("vector_topk", f"WITH {R.VECTORS} SELECT id, round({_COS}, 6) AS score FROM vectors v ORDER BY {_COS} DESC, id LIMIT 20")
def _(spark, d):
    return search.vector_topk(R.vectors(spark, d), _query_vector(spark, d), 20).select("id", F.round("score", 6).alias("score"))


@query("vector_topk_threshold", f"WITH {R.VECTORS}, s AS (SELECT id, file, {_COS} AS score FROM vectors v) SELECT id, file, round(score, 6) AS score FROM s WHERE score >= CASE WHEN file % 2 = 0 THEN 0.3 ELSE 0.1 END ORDER BY s.score DESC, id LIMIT 30")
def _(spark, d):
    v = R.vectors(spark, d)
    t = F.when(F.col("file") % 2 == 0, 0.3).otherwise(0.1)
    return search.vector_topk(v, _query_vector(spark, d), 30, t).select("id", "file", F.round("score", 6).alias("score"))


@query("rrf_hybrid", f"""WITH {R.VECTORS}, lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY source, doc_id) AS rank FROM documents WHERE contains(lower(text), 'the')),
sem AS (SELECT id, row_number() OVER (ORDER BY {_COS} DESC, id) AS rank FROM vectors v)
SELECT id, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM (SELECT * FROM lex WHERE rank <= 100 UNION ALL SELECT * FROM sem WHERE rank <= 100) GROUP BY id""")
def _(spark, d):
    lex = search.lexical(R.read(spark, d, "documents").withColumnRenamed("doc_id", "id"), "the", ["text"], ["source", "id"], 100)
    sem = search.ranked(search.vector_topk(R.vectors(spark, d), _query_vector(spark, d), 100), F.col("score").desc(), F.col("id"))
    return search.fuse([lex, sem]).select("id", F.round("rrf", 8).alias("rrf"))


@query("sparse_rank", f"""WITH {R.SYMBOLS}, words AS (SELECT unnest(['ring', 'blue', 'economy']) AS token),
m AS (SELECT s.*, token, CASE WHEN split_part(lower(qualified_name), '::', -1) = token THEN 0
 WHEN len(list_filter(string_split(replace(lower(qualified_name), '::', '.'), '.'), lambda x: starts_with(x, token))) > 0 THEN 1 WHEN contains(lower(qualified_name), token) THEN 2
 WHEN contains(lower(file_path), token) THEN 3 WHEN lower(kind) = token THEN 4 ELSE 5 END AS cls FROM symbols s JOIN words ON contains(lower(qualified_name || chr(10) || file_path || chr(10) || kind), token)),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY qualified_name, id) AS r FROM m)
SELECT id, qualified_name, file_path, count(DISTINCT token) AS n_tokens, min(cls) AS cls, CAST(min(r) AS INTEGER) AS best FROM r GROUP BY 1, 2, 3 ORDER BY n_tokens DESC, cls, best, qualified_name, file_path, id LIMIT 50""")
def _(spark, d):
    words = spark.range(1).select(F.explode(X.keywords(F.lit("The ring must use blue, for economy"))).alias("token"))
    return search.sparse(R.symbols(spark, d), words, 50)


@query("recency_boost", f"""WITH {R.FINGERPRINTS}, a AS (SELECT symbol_id, count(*) AS n, max(ts_us) // 1000 AS last_ms FROM fp GROUP BY 1)
SELECT symbol_id, round(0.5 * (1 + 0.1 * greatest(0, least(1, 1 - greatest(1706745600000 - last_ms, 0) / 2592000000.0)) + 0.05 * ln(n + 1) / ln(100)), 6) AS score FROM a""")
def _(spark, d):
    a = R.fingerprints(spark, d).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n"), F.floor(F.max("ts_us") / 1000).alias("last_ms"))
    return a.select("symbol_id", F.round(X.recency_access_boost(F.lit(0.5), F.col("n"), F.col("last_ms"), F.lit(1706745600000)), 6).alias("score"))


@query("ask_federated", f"""WITH {R.SYMBOLS}, {R.FINGERPRINTS},
s AS (SELECT 'symbol' AS source, CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY qualified_name, id) AS rank, size AS accesses, CAST(NULL AS BIGINT) AS last_ms FROM symbols WHERE contains(lower(qualified_name), 'ring')),
n AS (SELECT 'note' AS source, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY source, doc_id) AS rank, n_chars AS accesses, CAST(NULL AS BIGINT) AS last_ms FROM documents WHERE contains(lower(text), 'license')),
h AS (SELECT 'history' AS source, CAST(symbol_id AS VARCHAR) AS id, rank, accesses, last_ms FROM (SELECT symbol_id, count(*) AS accesses, max(ts_us) // 1000 AS last_ms, row_number() OVER (ORDER BY count(*) DESC, symbol_id) AS rank FROM fp GROUP BY 1)),
u AS (SELECT * FROM s WHERE rank <= 20 UNION ALL SELECT * FROM n WHERE rank <= 20 UNION ALL SELECT * FROM h WHERE rank <= 20),
b AS (SELECT source, id, 1.0 / (60 + rank) * (1 + 0.1 * coalesce(greatest(0, least(1, 1 - greatest(1706745600000 - last_ms, 0) / 2592000000.0)), 0) + 0.05 * ln(accesses + 1) / ln(100)) AS boosted FROM u),
t AS (SELECT greatest(max(boosted), 1.0) AS top FROM b)
SELECT source, id, round(boosted / top, 8) AS score FROM b, t ORDER BY boosted / top DESC, source, id LIMIT 40""")
def _(spark, d):
    sym = search.lexical(R.symbols(spark, d), "ring", ["qualified_name"], ["qualified_name", "id"], 20).select("id", "rank", F.col("size").alias("accesses"), F.lit(None).cast("long").alias("last_ms"))
    note = search.lexical(R.read(spark, d, "documents").withColumnRenamed("doc_id", "id"), "license", ["text"], ["source", "id"], 20).select("id", "rank", F.col("n_chars").alias("accesses"), F.lit(None).cast("long").alias("last_ms"))
    h = R.fingerprints(spark, d).groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("accesses"), F.floor(F.max("ts_us") / 1000).alias("last_ms")).orderBy(F.col("accesses").desc(), "id").limit(20)
    h = search.ranked(h, F.col("accesses").desc(), F.col("id"))
    return search.federated({"symbol": sym, "note": note, "history": h}, 1706745600000, 40).withColumn("score", F.round("score", 8))


@query("edge_resolve", f"WITH {R.named_edges_sql()} SELECT source_id, s.id AS target_id, edge_kind, count(*) AS n FROM edges JOIN symbols s ON s.qualified_name = target_qualified_name GROUP BY 1, 2, 3")
def _(spark, d):
    return joins.edge_counts(R.named_edges(spark, d), R.symbols(spark, d))


@query("unresolved_edges", f"WITH {R.named_edges_sql()} SELECT target_qualified_name, count(*) AS n FROM edges WHERE NOT EXISTS (SELECT 1 FROM symbols WHERE qualified_name = target_qualified_name) GROUP BY 1")
def _(spark, d):
    return joins.unresolved_edges(R.named_edges(spark, d), R.symbols(spark, d)).groupBy("target_qualified_name").agg(F.count(F.lit(1)).alias("n"))


_RESOLVED = "res AS (SELECT DISTINCT source_id, s.id AS target_id, edge_kind FROM edges JOIN symbols s ON s.qualified_name = target_qualified_name)"


@query("neighbors_bidir", f"""WITH {R.named_edges_sql()}, {_RESOLVED}, b AS (SELECT source_id AS symbol_id, target_id AS neighbor_id, edge_kind AS edge_type FROM res
UNION SELECT target_id, source_id, CASE edge_kind WHEN 'calls' THEN 'called_by' WHEN 'depends_on' THEN 'depended_on_by' ELSE 'referenced_by' END FROM res)
SELECT symbol_id, neighbor_id, edge_type, qualified_name AS neighbor_name, file_path AS neighbor_file FROM b JOIN symbols ON id = neighbor_id""")
def _(spark, d):
    return joins.neighbors(R.named_edges(spark, d), R.symbols(spark, d)).select("symbol_id", "neighbor_id", "edge_type", "neighbor_name", "neighbor_file")


_NAME = "(SELECT min(qualified_name) FROM symbols WHERE id % 16 <> 0)"


@query("callers", f"WITH {R.named_edges_sql()} SELECT id, qualified_name, file_path FROM symbols WHERE id IN (SELECT source_id FROM edges WHERE edge_kind = 'calls' AND target_qualified_name = {_NAME})")
def _(spark, d):
    s = R.symbols(spark, d)
    name = s.filter("id % 16 <> 0").agg(F.min("qualified_name")).first()[0]
    return joins.callers(R.named_edges(spark, d), s, name).select("id", "qualified_name", "file_path")


@query("dependencies_of", f"WITH {R.named_edges_sql()} SELECT DISTINCT s.id, s.qualified_name FROM edges JOIN symbols s ON s.qualified_name = target_qualified_name WHERE source_id = 7")
def _(spark, d):
    return joins.dependencies(R.named_edges(spark, d), R.symbols(spark, d), 7).select("id", "qualified_name")


@query("file_dependencies", f"""WITH {R.named_edges_sql()}, e AS (SELECT x.file_path AS a, s.file_path AS b FROM edges JOIN symbols s ON s.qualified_name = target_qualified_name JOIN symbols x ON x.id = source_id)
SELECT least(a, b) AS file_a, greatest(a, b) AS file_b, count(*) AS n_edges FROM e WHERE a <> b GROUP BY 1, 2""")
def _(spark, d):
    return joins.file_dependencies(R.named_edges(spark, d), R.symbols(spark, d))


@query("orphan_symbols", f"WITH {R.SYMBOLS}, {R.edges_sql()} SELECT id, qualified_name FROM symbols WHERE id NOT IN (SELECT source_id FROM edges) AND id NOT IN (SELECT target_id FROM edges)")
def _(spark, d):
    return joins.orphans(R.symbols(spark, d), R.edges(spark, d)).select("id", "qualified_name")


@query("methods_of_type", f"WITH {R.named_edges_sql()} SELECT s.id, target_qualified_name, edge_kind, count(*) AS n FROM edges JOIN symbols s ON s.id = source_id WHERE starts_with(s.qualified_name, 'Brand#2::') AND edge_kind IN ('calls', 'type_ref') GROUP BY 1, 2, 3")
def _(spark, d):
    s = R.symbols(spark, d).filter(F.col("qualified_name").startswith("Brand#2::"))
    return R.named_edges(spark, d).filter(F.col("edge_kind").isin("calls", "type_ref")).join(s, F.col("source_id") == s["id"]).groupBy("id", "target_qualified_name", "edge_kind").agg(F.count(F.lit(1)).alias("n"))


@query("asof_latest", f"""WITH {R.HISTORY}, r AS (SELECT symbol_id, created_us, sir_hash, version FROM history WHERE sir_hash IN ('error', 'click')), l AS (SELECT symbol_id, id, created_us AS at_us FROM history)
SELECT l.symbol_id, l.id, l.at_us, r.created_us AS matched_created_us, r.sir_hash AS matched_sir_hash, r.version AS matched_version FROM l ASOF LEFT JOIN r ON l.symbol_id = r.symbol_id AND l.at_us >= r.created_us""")
def _(spark, d):
    h = R.history(spark, d)
    right = h.filter("sir_hash IN ('error', 'click')").select("symbol_id", "created_us", "sir_hash", "version")
    left = h.select("symbol_id", "id", F.col("created_us").alias("at_us"))
    return joins.asof(left, right, "symbol_id", "at_us", "created_us", ["version"], ["sir_hash"]).join(right.select("symbol_id", F.col("created_us").alias("matched_created_us"), F.col("version").alias("matched_version")), ["symbol_id", "matched_created_us"], "left")


@query("boundary_edges", f"""WITH {R.SYMBOLS}, {R.edges_sql()} SELECT a.file_path AS source_community, b.file_path AS target_community, count(*) AS n FROM edges JOIN symbols a ON a.id = source_id JOIN symbols b ON b.id = target_id WHERE a.file_path <> b.file_path GROUP BY 1, 2""")
def _(spark, d):
    c = R.symbols(spark, d).select(F.col("id").alias("node"), F.col("file_path").alias("community"))
    return joins.boundary_edges(R.edges(spark, d), c).groupBy("source_community", "target_community").agg(F.count(F.lit(1)).alias("n"))


@query("new_boundary_edges", f"""WITH {R.SYMBOLS}, {R.edges_sql()}, {R.OLD_EDGES} SELECT DISTINCT source_id, target_id FROM edges e JOIN symbols a ON a.id = source_id JOIN symbols b ON b.id = target_id WHERE a.file_path <> b.file_path
AND NOT EXISTS (SELECT 1 FROM old o WHERE o.source_id = e.source_id AND o.target_id = e.target_id)""")
def _(spark, d):
    c = R.symbols(spark, d).select(F.col("id").alias("node"), F.col("file_path").alias("community"))
    return joins.boundary_edges(R.edges(spark, d), c, R.old_edges(spark, d)).select("source_id", "target_id").distinct()


@query("reconcile_plan", f"""WITH {R.SYMBOLS}, stale AS (SELECT id, file_path, qualified_name, kind, size AS last_seen FROM symbols WHERE size <= 10), cur AS (SELECT * FROM symbols WHERE size > 10),
c AS (SELECT file_path, qualified_name, kind, count(*) AS n, max(id) AS new_id FROM cur GROUP BY 1, 2, 3),
j AS (SELECT s.id, coalesce(n, 0) AS n, new_id, row_number() OVER (PARTITION BY new_id ORDER BY last_seen DESC, s.id DESC) AS r FROM stale s LEFT JOIN c USING (file_path, qualified_name, kind))
SELECT id, CASE WHEN n = 1 AND r = 1 THEN 'migrate' ELSE 'prune' END AS action, CASE WHEN n = 1 AND r = 1 THEN new_id END AS new_id FROM j""")
def _(spark, d):
    s = R.symbols(spark, d)
    return joins.reconcile(s.filter("size <= 10").withColumn("last_seen", F.col("size")), s.filter("size > 10"))


@query("usage_matrix", f"""WITH {R.SYMBOLS}, {R.edges_sql()}, u AS (SELECT DISTINCT t.qualified_name AS method, s.file_path AS f FROM edges JOIN symbols s ON s.id = source_id JOIN symbols t ON t.id = target_id WHERE edge_kind = 'calls')
SELECT m.qualified_name AS method, coalesce(string_agg(f, ',' ORDER BY f), '') AS consumers, count(f) AS n_consumers FROM (SELECT DISTINCT qualified_name FROM symbols) m LEFT JOIN u ON u.method = m.qualified_name GROUP BY 1""")
def _(spark, d):
    s = R.symbols(spark, d)
    calls = R.edges(spark, d).filter("edge_kind = 'calls'").join(s.select(F.col("id").alias("source_id"), F.col("file_path").alias("consumer_file")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("method")), "target_id")
    m = joins.usage_matrix(s.select(F.col("qualified_name").alias("method")).distinct(), calls)
    return m.select("method", F.array_join("consumers", ",").alias("consumers"), F.size("consumers").cast("long").alias("n_consumers"))


@query("pair_similarity", f"""WITH {R.VECTORS} SELECT a.file AS file_a, b.file AS file_b, round(greatest(0, least(1, max(list_cosine_similarity(a.embedding, b.embedding)))), 6) AS similarity FROM vectors a JOIN vectors b ON a.file < b.file GROUP BY 1, 2""")
def _(spark, d):
    v = R.vectors(spark, d)
    f = v.select("file").distinct()
    pairs = f.withColumnRenamed("file", "file_a").join(f.withColumnRenamed("file", "file_b"), F.col("file_a") < F.col("file_b"))
    return joins.max_pair_similarity(pairs, v).withColumn("similarity", F.round("similarity", 6))


@query("symbols_without_record", f"WITH {R.SYMBOLS} SELECT id FROM symbols LEFT JOIN documents ON doc_id = id WHERE coalesce(trim(text), '') = ''")
def _(spark, d):
    docs = R.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.symbols(spark, d).join(docs, "id", "left").filter(F.coalesce(F.btrim("text"), F.lit("")) == "").select("id")


@query("stale_symbols", f"WITH {R.SYMBOLS}, {R.edges_sql()} SELECT id FROM symbols WHERE id NOT IN (SELECT source_id FROM edges)")
def _(spark, d):
    return R.symbols(spark, d).join(R.edges(spark, d).select(F.col("source_id").alias("id")), "id", "left_anti").select("id")


def _asked(spark, d):
    """The stated query set: every vector whose id is divisible by 50."""
    return R.vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query"), "embedding")


@query("vector_search_exact", f"""WITH {R.VECTORS}, q AS (SELECT id AS query, embedding AS qv FROM vectors WHERE id % 50 = 0),
s AS (SELECT query, id, list_dot_product(embedding, qv) / sqrt(list_dot_product(embedding, embedding) * list_dot_product(qv, qv)) AS score FROM q, vectors),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s)
SELECT query, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def _(spark, d):
    return vector_index.exact(R.vectors(spark, d), _asked(spark, d), 10).withColumn("score", F.round("score", 6))


def _index(spark, d):
    path = f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}"
    vector_index.build(R.vectors(spark, d).select("id", "embedding"), path)
    return vector_index.load(spark, path)


@query("vector_index_search")
def _(spark, d):
    return vector_index.search(_index(spark, d), _asked(spark, d), 10).withColumn("score", F.round("score", 6))


@query("vector_index_recall")
def _(spark, d):
    return vector_index.recall(vector_index.search(_index(spark, d), _asked(spark, d), 10), vector_index.exact(R.vectors(spark, d), _asked(spark, d), 10))
