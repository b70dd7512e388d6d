"""Whole reports over a dependency graph: how healthy it is, and what has drifted since an earlier snapshot.

Components come as (id, component), named by their smallest member. A report lists components as one row each, with
counts; who belongs to them is a table of its own, so that no row grows with a component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from skeinlab.functions import exprs as X
from skeinlab.operators import graph, reports
from skeinlab.session import cut

# Weights of the parts of a symbol's risk, sections of the report, and how many entries a section lists.
WEIGHTS = {"pagerank": 0.3, "test_gap": 0.25, "drift": 0.2, "no_record": 0.15, "recency": 0.1}
SECTIONS = ("critical_symbols", "bottlenecks", "cycles", "orphans", "risk_hotspots")
DRIFTS = ("new_cycle", "orphaned", "emerging_hub")
LIMIT, MOST = 10, 200


def risks(symbols: DataFrame, edges: DataFrame, pagerank: DataFrame, betweenness: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, name, file, pagerank, betweenness, dependents, tests, drift, has_record, risk, factors) of all symbols and ends of edges.

    symbols: (id, name, file, tests, drift, has_record, recency); a null, or a symbol that only edges know, counts as
    no tests, no drift, no record and not accessed; its name is its id. factors names the parts above 0.1.
    """
    dependents = edges.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("dependents"))
    x = symbols.select("id", "name", "file", "tests", "drift", "has_record", "recency").join(graph.nodes(edges), "id", "full")
    x = x.join(pagerank.select("id", F.col("rank").alias("pagerank")), "id", "left").join(dependents, "id", "left")
    x = x.join(betweenness.select("id", F.col("score").alias("betweenness")), "id", "left") if betweenness is not None else x.withColumn("betweenness", F.lit(0.0))
    x = x.withColumns({
        "name": F.coalesce("name", F.col("id").cast("string")), "file": F.coalesce("file", F.lit("")), "tests": F.coalesce("tests", F.lit(0)), "dependents": F.coalesce("dependents", F.lit(0)),
        "drift": F.coalesce("drift", F.lit(0.0)), "has_record": F.coalesce("has_record", F.lit(False)), "recency": X.clamp(F.coalesce("recency", F.lit(1.0))),
        "pagerank": F.coalesce("pagerank", F.lit(0.0)), "betweenness": F.coalesce("betweenness", F.lit(0.0)),
    })
    x = x.join(F.broadcast(x.agg(F.max("pagerank").alias("_top"))), F.lit(True))  # one row
    part = {
        "pagerank": F.when(F.col("_top") > 0, F.col("pagerank") / F.nullif("_top", F.lit(0.0))).otherwise(0.0), "test_gap": F.lit(1.0) - F.least(F.lit(1.0), F.col("tests") / 3.0),
        "drift": F.col("drift"), "no_record": F.when(F.col("has_record"), 0.0).otherwise(1.0), "recency": F.col("recency"),
    }
    part = {k: v * weights[k] for k, v in part.items()}
    said = {
        "pagerank": F.format_string("high pagerank %.2f", "pagerank"), "test_gap": F.format_string("low test coverage (%s test guards)", F.col("tests").cast("string")),
        "drift": F.format_string("semantic drift %.2f", "drift"), "no_record": F.lit("no SIR metadata"), "recency": F.lit("not accessed recently"),
    }
    factors = F.array_compact(F.array(*[F.when(part[k] > 0.1, said[k]) for k in part]))
    total = F.lit(0.0)
    for v in part.values():
        total = total + v
    return x.select("id", "name", "file", "pagerank", "betweenness", "dependents", "tests", "drift", "has_record", X.clamp(total).alias("risk"), factors.alias("factors"))


def cycles(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """(id, symbols, edges): strong components of several members, with the number of edges inside, repeats and loops included."""
    size = strong.groupBy("component").agg(F.count(F.lit(1)).alias("symbols")).filter("symbols > 1")
    m = strong.join(size.select("component"), "component", "left_semi")
    a, b = m.select(F.col("id").alias("source_id"), "component"), m.select(F.col("id").alias("target_id"), F.col("component").alias("_to"))
    inside = edges.join(a, "source_id").join(b, "target_id").filter("component = _to").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    return size.join(inside, "component").select(F.col("component").alias("id"), "symbols", "edges")


def detached(components: DataFrame) -> DataFrame:
    """(id, symbols): all components but the largest; of equally large ones that with the smallest name is the main one."""
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("symbols"))
    main = size.orderBy(F.col("symbols").desc(), "component").limit(1)
    return size.join(F.broadcast(main.select("component")), "component", "left_anti").select(F.col("component").alias("id"), "symbols")


def _listed(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first rows of an order, with their place from 1."""
    return df.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(W.orderBy(*order)))


def health_report(symbols: DataFrame, edges: DataFrame, communities: DataFrame | None = None, limit: int = LIMIT, min_risk: float = 0.0, include: tuple[str, ...] = SECTIONS, summary: bool = True) -> dict[str, DataFrame]:
    """Sections by name, each with `place`, and, if wanted, `summary`: one row of totals; with cycles or orphans also `members`.

    critical_symbols and risk_hotspots: symbols of at least `min_risk`, riskiest first. bottlenecks: by betweenness,
    then PageRank. cycles and orphans: (id, symbols, ...), largest first. members: (section, component, id) of all
    cycles and orphans, listed or not. limit 0 stands for the default; beyond MOST it is MOST. What no section
    asks for is not computed.
    """
    limit, min_risk = min(limit or LIMIT, MOST), min(max(min_risk, 0.0), 1.0)
    e = cut(edges)
    weak = cut(graph.connected_components(e)) if summary or {"cycles", "orphans"} & set(include) else None
    strong = cut(graph.strongly_connected(e, weak)) if summary or "cycles" in include else None
    rings, apart = strong and cut(cycles(e, strong)), weak and cut(detached(weak)) if summary or "orphans" in include else None
    out = {}
    if summary:
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        every = symbols.select("id").unionByName(graph.nodes(e)).distinct()
        total = count(every, "total_symbols").join(count(e, "total_edges")).join(count(rings, "cycles_detected")).join(count(apart, "orphaned_subgraphs"))  # one row each
        if communities is not None:
            total = total.join(communities.agg(F.countDistinct("community").alias("communities_detected")))
        out["summary"] = total
    if {"critical_symbols", "bottlenecks", "risk_hotspots"} & set(include):
        between = graph.betweenness(e) if {"critical_symbols", "bottlenecks"} & set(include) else None
        r = cut(risks(symbols, e, graph.pagerank(e), between))
        worst = _listed(r.filter(F.col("risk") >= min_risk), limit, F.col("risk").desc(), F.col("id"))
        if "critical_symbols" in include:
            out["critical_symbols"] = worst
        if "risk_hotspots" in include:
            out["risk_hotspots"] = worst.select("place", "id", "name", "file", "risk", "factors")
        if "bottlenecks" in include:
            note = F.format_string("%.0f%% of shortest dependency paths pass through this symbol", F.col("betweenness") * 100)
            b = _listed(r.filter("betweenness > 0"), limit, F.col("betweenness").desc(), F.col("pagerank").desc(), F.col("id"))
            out["bottlenecks"] = b.select("place", "id", "name", "file", "betweenness", "pagerank", note.alias("note"))
    who = []
    for name, found, of in (("cycles", rings, strong), ("orphans", apart, weak)):
        if name in include:
            out[name] = _listed(found, limit, F.col("symbols").desc(), F.col("id"))
            who.append(of.join(found.select(F.col("id").alias("component")), "component", "left_semi").select(F.lit(name).alias("section"), "component", "id"))
    if who:
        out["members"] = who[0] if len(who) == 1 else who[0].unionByName(who[1])
    return out


def new_cycles(now: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, symbols): strong components of several members whose exact set of members was not one before.

    Sets are compared by counts: all members lie in one earlier component, and that is no larger.
    """
    n = now.select("id", "component")
    if before is None:
        return n.groupBy("component").agg(F.count(F.lit(1)).alias("symbols")).filter("symbols > 1").select(F.col("component").alias("id"), "symbols")
    old = before.select("id", F.col("component").alias("_was"))
    old = old.join(old.groupBy("_was").agg(F.count(F.lit(1)).alias("_size")), "_was")
    j = n.join(old, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("symbols"), F.count("_was").alias("_known"), F.min("_was").alias("_a"), F.max("_was").alias("_b"), F.max("_size").alias("_size"))
    same = (F.col("_known") == F.col("symbols")) & (F.col("_a") == F.col("_b")) & (F.col("_size") == F.col("symbols"))
    return j.filter(F.col("symbols") > 1).filter(~F.coalesce(same, F.lit(False))).select(F.col("component").alias("id"), "symbols")


def boundary_violations(edges: DataFrame, communities: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, other, edge_kind, informational): distinct edges (source, target, kind) between communities that did not cross before.

    An end that the earlier communities (id, community) do not know makes an edge new. Without an earlier
    snapshot all are listed, as information only.
    """
    cross = graph.cross_community(edges, communities).distinct()
    first = before is None or before.isEmpty()
    if not first:
        at = lambda end, c: before.select(F.col("id").alias(end), F.col("community").alias(c))
        cross = cross.join(at("source_id", "_a"), "source_id", "left").join(at("target_id", "_b"), "target_id", "left").filter(~F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)))
    return cross.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "edge_kind", F.lit(first).alias("informational"))


def structural_drift(edges: DataFrame, before: DataFrame | None = None, share: float = 0.95, growth: float = 0.2, include: tuple[str, ...] = DRIFTS) -> DataFrame:
    """(drift_type, id, magnitude, symbols): emerging hubs by PageRank, with its growth, new cycles, and components off the main one.

    Without an earlier graph there are no hubs, and all cycles are new. Types that are not in `include` are not computed.
    """
    e = cut(edges)
    was = cut(before) if before is not None else None
    none = F.lit(None)
    out = e.sparkSession.createDataFrame([], T.StructType([T.StructField("drift_type", T.StringType()), e.select(F.col("source_id").alias("id")).schema["id"], T.StructField("magnitude", T.DoubleType()), T.StructField("symbols", T.LongType())]))
    weak = cut(graph.connected_components(e)) if {"new_cycle", "orphaned"} & set(include) else None
    if "new_cycle" in include:
        rings = new_cycles(graph.strongly_connected(e, weak), graph.strongly_connected(was, cut(graph.connected_components(was))) if was is not None else None)
        out = out.unionByName(rings.select(F.lit("new_cycle").alias("drift_type"), "id", none.cast("double").alias("magnitude"), "symbols"))
    if "orphaned" in include:
        out = out.unionByName(detached(weak).select(F.lit("orphaned").alias("drift_type"), "id", none.cast("double").alias("magnitude"), "symbols"))
    if was is None or "emerging_hub" not in include:
        return out
    hubs = reports.emerging_hubs(graph.pagerank(e), graph.pagerank(was), share, growth)
    return out.unionByName(hubs.select(F.lit("emerging_hub").alias("drift_type"), "id", F.abs(F.col("rank") - F.col("previous")).alias("magnitude"), none.cast("long").alias("symbols")))


def drift_report(semantic: DataFrame, boundary: DataFrame, structural: DataFrame, acknowledged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries (drift_type, id, other, edge_kind, magnitude, symbols, informational) of one analysis, and one row of their counts.

    semantic: (id, magnitude); boundary and structural as above. Acknowledged (drift_type, id, other, edge_kind)
    entries are left out, nulls being equal. Informational crossings are listed and not counted.
    """
    out = structural.unionByName(semantic.select(F.lit("semantic").alias("drift_type"), "id", "magnitude"), allowMissingColumns=True)
    out = out.unionByName(boundary.select(F.lit("boundary_violation").alias("drift_type"), "id", "other", "edge_kind", "informational"), allowMissingColumns=True)
    out = out.withColumn("informational", F.coalesce("informational", F.lit(False)))
    if acknowledged is not None:
        a = acknowledged.select(*[F.col(c).alias(f"_{c}") for c in ("drift_type", "id", "other", "edge_kind")])
        on = (F.col("drift_type") == F.col("_drift_type")) & (F.col("id") == F.col("_id")) & F.col("other").eqNullSafe(F.col("_other")) & F.col("edge_kind").eqNullSafe(F.col("_edge_kind"))
        out = out.join(a, on, "left_anti")
    out = cut(out.select("drift_type", "id", "other", "edge_kind", "magnitude", "symbols", "informational"))
    n = lambda t: F.count_if((F.col("drift_type") == t) & ~F.col("informational"))
    names = {"semantic": "semantic_drifts", "boundary_violation": "boundary_violations", "emerging_hub": "emerging_hubs", "new_cycle": "new_cycles", "orphaned": "orphaned_subgraphs"}
    return out, out.agg(*[n(k).alias(v) for k, v in names.items()])
