"""Queries over graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.operators import graph, graph_local, health
from skeinlab.plans import roles as R
from skeinlab.plans.registry import query
from skeinlab.session import store

_E = R.edges_sql()
_N = "v AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges)"


def _held(sql: str) -> str:
    """Every common table is worked out once, however often it is read."""
    return sql.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def _ranks(steps: int, damping: float = 0.85) -> str:
    out = f"{_E}, {_N}, n AS (SELECT count(*) AS n FROM v), deg AS (SELECT source_id AS id, count(*) AS d FROM edges GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"
    for k in range(1, steps + 1):
        out += (
            f", l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT id FROM deg)), g{k} AS (SELECT target_id AS id, sum(rank / d) AS got FROM edges JOIN r{k - 1} r ON r.id = source_id JOIN deg ON deg.id = source_id GROUP BY 1)"
            f", r{k} AS (SELECT v.id, {1 - damping} / n + {damping} * (coalesce(got, 0) + lost / n) AS rank FROM v LEFT JOIN g{k} USING (id), n, l{k})"
        )
    return out


@query("pagerank", _held(f"WITH {_ranks(25)} SELECT id, round(rank, 8) AS rank FROM r25"))
def _(spark, d):
    return graph.pagerank(R.edges(spark, d)).withColumn("rank", F.round("rank", 8))


def _ppr(steps: int, alpha: float = 0.15) -> str:
    out = f"{_E}, {_N}, s AS (SELECT id, CASE WHEN id % 50 = 0 THEN 1.0 / (SELECT count(*) FROM v WHERE id % 50 = 0) ELSE 0 END::DOUBLE AS s FROM v), deg AS (SELECT source_id AS id, count(*) AS d FROM edges GROUP BY 1), r0 AS (SELECT id, s AS rank FROM s)"
    for k in range(1, steps + 1):
        out += (
            f", l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT id FROM deg)), g{k} AS (SELECT target_id AS id, sum(rank / d) AS got FROM edges JOIN r{k - 1} r ON r.id = source_id JOIN deg ON deg.id = source_id GROUP BY 1)"
            f", r{k} AS (SELECT s.id, {1 - alpha} * (coalesce(got, 0) + lost * s) + {alpha} * s AS rank FROM s LEFT JOIN g{k} USING (id), l{k})"
        )
    return out


@query("personalized_pagerank", _held(f"WITH {_ppr(20)} SELECT id, round(rank, 8) AS rank FROM r20 WHERE rank > 0"))
def _(spark, d):
    seeds = R.read(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).filter("id % 50 = 0")  # those that no edge touches are left out
    return graph.personalized_pagerank(R.edges(spark, d), seeds).withColumn("rank", F.round("rank", 8))


def _reach(on: str, to: str, depth: int, start: str) -> str:
    return f"r AS (SELECT DISTINCT id, 0 AS depth FROM v WHERE {start} UNION SELECT e.{to}, r.depth + 1 FROM r JOIN (SELECT DISTINCT source_id, target_id FROM edges) e ON e.{on} = r.id WHERE r.depth < {depth})"


@query("khop_min_depth", f"WITH RECURSIVE {_E}, {_N}, {_reach('source_id', 'target_id', 3, 'id % 100 = 1')} SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1")
def _(spark, d):
    e = R.edges(spark, d)
    return graph.k_hop(e, graph.nodes(e).filter("id % 100 = 1"), 3)


@query("call_chain", f"WITH RECURSIVE {_E}, {_N}, {_reach('target_id', 'source_id', 4, 'id = (SELECT min(target_id) FROM edges)')} SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1")
def _(spark, d):
    e = R.edges(spark, d)
    return graph.k_hop(e, e.agg(F.min("target_id").alias("id")), 4, "in")


@query("reachability", f"WITH RECURSIVE {_E}, {_N}, r AS (SELECT id FROM v WHERE id % 200 = 3 UNION SELECT target_id FROM r JOIN edges ON source_id = id) SELECT id FROM r")
def _(spark, d):
    e = R.edges(spark, d)
    return graph.k_hop(e, graph.nodes(e).filter("id % 200 = 3"), -1).select("id")


@query("shortest_path")
def _(spark, d):
    e = R.edges(spark, d)
    a = e.agg(F.min("source_id"), F.max("target_id")).first()
    return graph.shortest_path(e, a[0], a[1])


@query("connected_components")
def _(spark, d):
    return graph.connected_components(R.edges(spark, d))


@query("strong_components")
def _(spark, d):
    return graph.strongly_connected(R.edges(spark, d))


@query("cross_community_edges", f"WITH {R.SYMBOLS}, {_E} SELECT source_id, target_id, edge_kind FROM edges JOIN symbols a ON a.id = source_id JOIN symbols b ON b.id = target_id WHERE a.kind <> b.kind")
def _(spark, d):
    return graph.cross_community(R.edges(spark, d), R.symbols(spark, d).select("id", F.col("kind").alias("community")))


@query("stale_propagation", f"""WITH RECURSIVE {_E}, {_N}, s AS (SELECT id, 0.5 + (id % 5) / 10.0 AS staleness, 0.6::DOUBLE AS delta FROM v WHERE id % 40 = 0), e AS (SELECT DISTINCT target_id AS x, source_id AS y FROM edges),
r AS (SELECT id AS seed, id, 0 AS hop FROM s WHERE staleness * 0.5 * delta >= 0.05 UNION SELECT r.seed, y, r.hop + 1 FROM r JOIN e ON e.x = r.id JOIN s ON s.id = r.seed WHERE staleness * 0.5 * delta * pow(0.5, r.hop) >= 0.05),
m AS (SELECT seed, id, min(hop) AS hop FROM r GROUP BY 1, 2) SELECT m.id, round(max(staleness * 0.5 * delta * pow(0.5, hop - 1)), 6) AS induced FROM m JOIN s ON s.id = m.seed WHERE hop > 0 GROUP BY 1""")
def _(spark, d):
    e = R.edges(spark, d)
    seeds = graph.nodes(e).filter("id % 40 = 0").select("id", (F.col("id") % 5 / 10.0 + 0.5).alias("staleness"), F.lit(0.6).alias("delta"))
    return graph.propagate_staleness(e, seeds, 0.5, 0.05).withColumn("induced", F.round("induced", 6))


@query("epicenter_trace")
def _(spark, d):
    fp = R.fingerprints(spark, d)
    e = R.edges(spark, d)
    return graph.trace_epicenters(e, fp, fp.select(F.col("symbol_id").alias("id")).distinct(), 0.15, 10)


@query("betweenness")
def _(spark, d):
    return graph.betweenness(R.edges(spark, d)).withColumn("score", F.round("score", 10))


@query("toposort")
def _(spark, d):
    s = R.symbols(spark, d).select("id", "file_path")
    e = R.edges(spark, d).join(s.select(F.col("id").alias("source_id"), "file_path"), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("file_path").alias("f2")), "target_id").filter("file_path = f2")
    return graph_local.toposort(e.select("file_path", "source_id", "target_id"), "file_path")


@query("trait_clusters")
def _(spark, d):
    s = R.symbols(spark, d)
    calls = R.edges(spark, d).join(s.select(F.col("id").alias("source_id"), F.col("file_path").alias("consumer")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("file_path").alias("trait"), F.col("qualified_name").alias("method")), "target_id")
    return graph_local.trait_clusters(calls.groupBy("trait", "method").agg(F.collect_set("consumer").alias("consumers")))


@query("interesting_paths")
def _(spark, d):
    e = store(R.edges(spark, d).select("source_id", "target_id").distinct())  # lines are sorted by order once
    n = R.symbols(spark, d).select("id", F.col("kind").alias("layer"), F.col("file_path").alias("file"), (F.col("size") / 1000.0).alias("centrality"))
    return graph.interesting_path(e, n, graph.nodes(e).filter("id % 100 = 1"))


_AUDIT = f"""WITH {R.SYMBOLS}, {R.edges_sql('all_edges')}, e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM all_edges WHERE edge_kind = 'calls'),
step AS MATERIALIZED (SELECT s AS x, id, {{'turn': 0, 'name': qualified_name, 'id': CAST(id AS VARCHAR)}} AS st FROM e JOIN symbols ON id = t UNION ALL SELECT t, id, {{'turn': 1, 'name': CAST(id AS VARCHAR), 'id': CAST(id AS VARCHAR)}} FROM e JOIN symbols ON id = s),
l0 AS (SELECT min(s) AS id FROM e), l1 AS MATERIALIZED (SELECT id, min([st]) AS path FROM step WHERE x IN (SELECT id FROM l0) AND id NOT IN (SELECT id FROM l0) GROUP BY 1),
l2 AS (SELECT step.id, min(list_append(path, st)) AS path FROM l1 JOIN step ON x = l1.id WHERE step.id NOT IN (SELECT id FROM l1 UNION SELECT id FROM l0) GROUP BY 1),
every AS (SELECT id, 0 AS depth, [] AS path FROM l0 UNION ALL SELECT id, 1, path FROM l1 UNION ALL SELECT id, 2, path FROM l2)"""


def _audit(spark, d):
    e = R.edges(spark, d).filter("edge_kind = 'calls'")
    return graph.audit_chain(e, R.symbols(spark, d).select("id", F.col("qualified_name").alias("name")), e.agg(F.min("source_id")).first()[0])


@query("audit_chain", _AUDIT + """ SELECT CAST(row_number() OVER (ORDER BY depth, path) AS INTEGER) AS place, id, CASE WHEN depth = 0 THEN 'root' WHEN path[-1].turn = 0 THEN 'callee' ELSE 'caller' END AS role,
depth, CASE WHEN depth > 0 THEN 'calls' END AS edge_kind FROM every ORDER BY depth, path LIMIT 20""")
def _(spark, d):
    return _audit(spark, d)[0]


@query("audit_totals", _AUDIT + " SELECT count(*) FILTER (depth > 0 AND path[-1].turn = 1) AS callers, count(*) FILTER (depth > 0 AND path[-1].turn = 0) AS callees, max(depth) AS levels, count(*) AS found FROM every")
def _(spark, d):
    return _audit(spark, d)[1]


@query("trait_clusters_merged")
def _(spark, d):
    s = R.symbols(spark, d)
    calls = R.edges(spark, d).join(s.select(F.col("id").alias("source_id"), F.col("file_path").alias("consumer")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("file_path").alias("trait"), F.col("qualified_name").alias("method")), "target_id")
    clusters = graph_local.trait_clusters(calls.groupBy("trait", "method").agg(F.collect_set("consumer").alias("consumers")))
    return health.absorb_single_clusters(clusters, calls)
