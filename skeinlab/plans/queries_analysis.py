"""Queries over whole health and drift reports, on the graph of edges inside files."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.functions import exprs as X
from skeinlab.operators import analysis, communities, graph
from skeinlab.plans import roles as R
from skeinlab.plans.queries_graph import _E, _held, _ranks
from skeinlab.plans.queries_measures import _risk_input
from skeinlab.plans.registry import query

_FILES = f"{R.SYMBOLS}, {R.edges_sql('all_edges')}, {R.file_edges_sql('edges', 'all_edges')}"
_OLD_FILES = f"{R.OLD_EDGES}, {R.file_edges_sql('old_edges', 'old')}"


def _parts(edges: str, tag: str = "") -> str:
    """Components by closure: strong{tag} and weak{tag} of (id, component)."""
    return (
        f"v{tag} AS (SELECT source_id AS id FROM {edges} UNION SELECT target_id FROM {edges}), fw{tag} AS (SELECT source_id AS a, target_id AS b FROM {edges} UNION SELECT r.a, e.target_id FROM fw{tag} r JOIN {edges} e ON e.source_id = r.b), "
        f"either{tag} AS (SELECT source_id AS x, target_id AS y FROM {edges} UNION SELECT target_id, source_id FROM {edges}), al{tag} AS (SELECT x AS a, y AS b FROM either{tag} UNION SELECT r.a, e.y FROM al{tag} r JOIN either{tag} e ON e.x = r.b), "
        f"strong{tag} AS (SELECT id, least(id, min(f.b)) AS component FROM v{tag} LEFT JOIN (SELECT p.a, p.b FROM fw{tag} p JOIN fw{tag} q ON q.a = p.b AND q.b = p.a) f ON f.a = id GROUP BY id), "
        f"weak{tag} AS (SELECT id, least(id, min(b)) AS component FROM v{tag} LEFT JOIN al{tag} ON a = id GROUP BY id)"
    )


_RINGS = "rings AS (SELECT s.component AS id, s.symbols, count(*) AS edges FROM (SELECT component, count(*) AS symbols FROM strong GROUP BY 1 HAVING count(*) > 1) s JOIN strong a ON a.component = s.component JOIN edges e ON e.source_id = a.id JOIN strong b ON b.id = e.target_id AND b.component = s.component GROUP BY 1, 2)"
_APART = "sizes AS (SELECT component AS id, count(*) AS symbols FROM weak GROUP BY 1), apart AS (SELECT * FROM sizes WHERE id <> (SELECT id FROM sizes ORDER BY symbols DESC, id LIMIT 1))"


def _symbols(spark, d):
    return _risk_input(spark, d).drop("pagerank").withColumnsRenamed({"qualified_name": "name", "file_path": "file"})


def _report(spark, d, *include: str, **options):
    return analysis.health_report(_symbols(spark, d), R.file_edges(spark, d), include=include, summary=not include, **options)


@query("health_summary", f"WITH RECURSIVE {_FILES}, {_parts('edges')}, {_RINGS}, {_APART} SELECT (SELECT count(*) FROM (SELECT id FROM symbols UNION SELECT id FROM v)) AS total_symbols, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM rings) AS cycles_detected, (SELECT count(*) FROM apart) AS orphaned_subgraphs")
def _(spark, d):
    return _report(spark, d)["summary"]


@query("health_cycles", f"WITH RECURSIVE {_FILES}, {_parts('edges')}, {_RINGS} SELECT id, symbols, edges, CAST(row_number() OVER (ORDER BY symbols DESC, id) AS INTEGER) AS place FROM rings ORDER BY place LIMIT 200")
def _(spark, d):
    return _report(spark, d, "cycles", limit=200)["cycles"]


@query("health_orphans", f"WITH RECURSIVE {_FILES}, {_parts('edges')}, {_APART} SELECT id, symbols, CAST(row_number() OVER (ORDER BY symbols DESC, id) AS INTEGER) AS place FROM apart ORDER BY place LIMIT 200")
def _(spark, d):
    return _report(spark, d, "orphans", limit=200)["orphans"]


@query("health_members", f"WITH RECURSIVE {_FILES}, {_parts('edges')}, {_RINGS}, {_APART} SELECT 'cycles' AS section, component, id FROM strong WHERE component IN (SELECT id FROM rings) UNION ALL SELECT 'orphans', component, id FROM weak WHERE component IN (SELECT id FROM apart)")
def _(spark, d):
    return _report(spark, d, "cycles", "orphans")["members"]


@query("health_risk_hotspots", _held(f"""WITH {_FILES}, {_ranks(25).removeprefix(_E + ', ')}, {R.FINGERPRINTS}, dr AS (SELECT symbol_id AS id, max(delta_sem) AS drift, count(*) % 4 AS tests FROM fp GROUP BY 1),
x AS (SELECT s.id, qualified_name AS name, file_path AS file, coalesce(tests, 0) AS tests, coalesce(drift, 0) AS drift, coalesce(rank, 0) AS pr, CASE WHEN s.id % 3 <> 0 THEN 0 ELSE 0.15 END AS bare, s.id % 30 / 30.0 AS recency FROM symbols s LEFT JOIN dr USING (id) LEFT JOIN r25 USING (id)),
p AS (SELECT *, 0.3 * pr / (SELECT max(pr) FROM x) AS a, 0.25 * (1 - least(1, tests / 3.0)) AS b, 0.2 * drift AS c, 0.1 * recency AS e FROM x), k AS (SELECT *, greatest(0, least(1, a + b + c + bare + e)) AS risk FROM p)
SELECT id, name, file, round(risk, 6) AS risk, concat_ws('; ', CASE WHEN a > 0.1 THEN 'pagerank' END, CASE WHEN b > 0.1 THEN 'low test coverage (' || tests || ' test guards)' END, CASE WHEN c > 0.1 THEN 'drift' END, CASE WHEN bare > 0.1 THEN 'no SIR metadata' END) AS factors
FROM k WHERE risk >= 0.4 ORDER BY k.risk DESC, id LIMIT 200"""))
def _(spark, d):
    r = _report(spark, d, "risk_hotspots", limit=200, min_risk=0.4)["risk_hotspots"]
    short = F.transform("factors", lambda f: F.when(f.startswith("high pagerank"), "pagerank").when(f.startswith("semantic drift"), "drift").otherwise(f))  # decimals are rounded differently
    return r.select("id", "name", "file", F.round("risk", 6).alias("risk"), F.array_join(short, "; ").alias("factors"))


@query("health_bottlenecks")
def _(spark, d):
    b = _report(spark, d, "bottlenecks", limit=50)["bottlenecks"]
    return b.withColumns({"betweenness": F.round("betweenness", 10), "pagerank": F.round("pagerank", 10)})


_NEW_RINGS = """was AS (SELECT o.id, o.component, n FROM strong_old o JOIN (SELECT component, count(*) AS n FROM strong_old GROUP BY 1) USING (component)),
fresh AS (SELECT s.component AS id, count(*) AS symbols FROM strong s LEFT JOIN was w ON w.id = s.id GROUP BY 1 HAVING count(*) > 1 AND NOT coalesce(count(w.n) = count(*) AND min(w.component) = max(w.component) AND max(w.n) = count(*), false))"""


@query("drift_new_cycles", f"WITH RECURSIVE {_FILES}, {_OLD_FILES}, {_parts('edges')}, {_parts('old_edges', '_old')}, {_NEW_RINGS} SELECT id, symbols FROM fresh")
def _(spark, d):
    now, was = (graph.cut(R.file_edges(spark, d, old)) for old in (False, True))
    return analysis.new_cycles(*[graph.strongly_connected(e, graph.cut(graph.connected_components(e))) for e in (now, was)])


_KINDS = "now AS (SELECT id, id % 7 AS community FROM symbols), bef AS (SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 7 END AS community FROM symbols WHERE id % 11 > 0)"


def _snapshots(spark, d):
    s = R.symbols(spark, d).select("id")
    return s.withColumn("community", F.col("id") % 7), s.filter("id % 11 > 0").withColumn("community", F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("id") % 7))


_CROSSED = "crossed AS (SELECT DISTINCT source_id AS id, target_id AS other, edge_kind FROM edges JOIN now a ON a.id = source_id JOIN now b ON b.id = target_id LEFT JOIN bef p ON p.id = source_id LEFT JOIN bef q ON q.id = target_id WHERE a.community <> b.community AND NOT coalesce(p.community <> q.community, false))"


@query("boundary_violations", f"WITH {_FILES}, {_KINDS}, {_CROSSED} SELECT id, other, edge_kind, false AS informational FROM crossed")
def _(spark, d):
    return analysis.boundary_violations(R.file_edges(spark, d), *_snapshots(spark, d))


def _drift(spark, d, include=analysis.DRIFTS):
    now, before = _snapshots(spark, d)
    v = R.vectors(spark, d).select("id", "embedding")
    then = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("then"))
    semantic = v.join(then, "id").select("id", (F.lit(1.0) - X.cosine(F.col("embedding"), F.col("then"))).alias("magnitude")).filter("magnitude >= 0.9")
    e = R.file_edges(spark, d)
    return analysis.drift_report(semantic, analysis.boundary_violations(e, now, before), analysis.structural_drift(e.drop("edge_kind"), R.file_edges(spark, d, old=True), include=include))


@query("drift_report", f"""WITH RECURSIVE {_FILES}, {_OLD_FILES}, {_parts('edges')}, {_parts('old_edges', '_old')}, {_NEW_RINGS}, {_APART}, {_KINDS}, {_CROSSED}, {R.VECTORS},
sem AS (SELECT a.id, 1 - list_cosine_similarity(a.embedding, b.embedding) AS magnitude FROM vectors a JOIN vectors b ON b.id = a.id + 1)
SELECT 'semantic' AS drift_type, id, NULL::BIGINT AS other, NULL AS edge_kind, round(magnitude, 6) AS magnitude, NULL::BIGINT AS symbols FROM sem WHERE magnitude >= 0.9 UNION ALL SELECT 'boundary_violation', id, other, edge_kind, NULL, NULL FROM crossed
UNION ALL SELECT 'new_cycle', id, NULL, NULL, NULL, symbols FROM fresh UNION ALL SELECT 'orphaned', id, NULL, NULL, NULL, symbols FROM apart""")
def _(spark, d):
    out = _drift(spark, d, ("new_cycle", "orphaned"))[0]  # hubs: drift_hubs
    return out.select("drift_type", "id", "other", "edge_kind", F.round("magnitude", 6).alias("magnitude"), "symbols")


@query("drift_hubs")
def _(spark, d):
    out = analysis.structural_drift(R.file_edges(spark, d), R.file_edges(spark, d, old=True), include=("emerging_hub",))
    return out.select("id", F.round("magnitude", 10).alias("magnitude"))


@query("drift_summary")
def _(spark, d):
    return _drift(spark, d)[1]


@query("health_totals")
def _(spark, d):
    e = R.file_edges(spark, d)
    return analysis.health_report(_symbols(spark, d), e, communities.louvain(e), include=())["summary"]
