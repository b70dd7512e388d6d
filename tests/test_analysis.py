"""Health and drift reports against plain versions that hold the graph in memory."""

import random

import pytest
from pyspark.sql import functions as F

from skeinlab.operators import analysis as A, graph
from test_operators import as_dict, edges, plain_betweenness

SYMBOLS = "id long, name string, file string, tests int, drift double, has_record boolean, recency double, component string, rank string"


def graph_of(seed, n=26, m=30):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(40, 41), (41, 40), (41, 40), (50, 50)]


def closure(pairs, both=False):
    pairs = pairs + [(b, a) for a, b in pairs] if both else pairs
    out = {}
    for s in {x for p in pairs for x in p}:
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            new = {b for a, b in pairs if a == x} - seen
            seen |= new
            todo += new
        out[s] = seen
    return out


def plain_parts(pairs):
    """Sets of members: (strong, weak)."""
    down, near = closure(pairs), closure(pairs, both=True)
    strong = {frozenset({x} | {y for y in down[x] if x in down[y]}) for x in down}
    return strong, {frozenset({x} | near[x]) for x in near}


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_health_report_sections(spark):
    pairs = graph_of(3)
    strong, weak = plain_parts(pairs)
    loops = [c for c in strong if len(c) > 1]
    main = min(weak, key=lambda c: (-len(c), min(c)))
    known = spark.createDataFrame([(k, f"n{k}", "f", k % 4, k / 50.0, k % 2 == 0, 0.5, "clash", "clash") for k in range(10)] + [(90, None, None, None, None, None, None, "x", "y")], SYMBOLS)
    got = A.health_report(known, edges(spark, pairs), spark.createDataFrame([(1, 1), (2, 1), (3, 7)], "id long, community long"), limit=500)
    every = {x for p in pairs for x in p} | set(range(10)) | {90}
    assert tuple(got["summary"].first()) == (len(every), len(pairs), len(loops), len(weak) - 1, 2)
    assert rows(got["cycles"], "id", "symbols", "edges") == {(min(c), len(c), sum(a in c and b in c for a, b in pairs)) for c in loops}
    assert rows(got["orphans"], "id", "symbols") == {(min(c), len(c)) for c in weak if c != main}
    places = [tuple(r) for r in got["orphans"].orderBy("place").select("symbols", "id").collect()]
    assert places == sorted(places, key=lambda r: (-r[0], r[1]))
    assert rows(got["members"], "section", "component", "id") == {("cycles", min(c), x) for c in loops for x in c} | {("orphans", min(c), x) for c in weak if c != main for x in c}
    score = plain_betweenness(pairs)
    assert as_dict(got["bottlenecks"], "id", "betweenness") == {k: pytest.approx(v) for k, v in score.items() if v > 0}
    best = max(score, key=lambda k: score[k])
    assert got["bottlenecks"].filter("place = 1").first().note == f"{score[best] * 100:.0f}% of shortest dependency paths pass through this symbol"
    assert {r.id for r in got["critical_symbols"].collect()} == every == {r.id for r in got["risk_hotspots"].collect()}


def test_risk_of_known_and_unknown_symbols(spark):
    e = edges(spark, [(1, 2), (3, 2), (3, 2), (2, 4)])
    known = spark.createDataFrame([(2, "two", "f", 3, 0.8, True, 0.0, "", ""), (4, "four", "f", None, None, None, None, "", "")], SYMBOLS)
    rank = spark.createDataFrame([(1, 0.1), (2, 0.4), (3, 0.1), (4, 0.2)], "id long, rank double")
    r = {x.id: x for x in A.risks(known, e, rank).collect()}
    assert r[2].risk == pytest.approx(0.3 + 0.2 * 0.8) and r[2].factors == ["high pagerank 0.40", "semantic drift 0.80"] and r[2].dependents == 2
    assert r[4].risk == pytest.approx(0.15 + 0.25 + 0.15 + 0.1) and r[4].factors == ["high pagerank 0.20", "low test coverage (0 test guards)", "no SIR metadata"]
    assert r[1].risk == pytest.approx(0.075 + 0.25 + 0.15 + 0.1) and (r[1].name, r[1].file, r[1].dependents) == ("1", "", 0)


def test_only_what_is_asked_for(spark):
    none = spark.createDataFrame([], SYMBOLS)
    got = A.health_report(none, edges(spark, []), limit=0)
    assert tuple(got["summary"].first()) == (0, 0, 0, 0)
    assert all(df.count() == 0 for name, df in got.items() if name != "summary")
    assert set(A.health_report(none, edges(spark, [(1, 2)]), include=())) == {"summary"}


def test_new_cycles_compare_whole_sets(spark):
    now = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8), (9, 8)], "id long, component long")
    was = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (10, 3), (5, 5), (6, 6), (8, 8)], "id long, component long")
    assert as_dict(A.new_cycles(now, was), "id", "symbols") == {3: 2, 5: 2, 8: 2}  # shrunk, joined, with an unknown member; 1 is unchanged
    assert as_dict(A.new_cycles(now), "id", "symbols") == {1: 2, 3: 2, 5: 2, 8: 2}
    assert as_dict(A.new_cycles(now, was.limit(0)), "id", "symbols") == {1: 2, 3: 2, 5: 2, 8: 2}


@pytest.mark.parametrize("seed", [1, 8])
def test_new_cycles_of_graphs(spark, seed):
    a, b = graph_of(seed), graph_of(seed)[5:] + [(0, 1)]
    old, new = plain_parts(a)[0], plain_parts(b)[0]
    got = A.new_cycles(graph.strongly_connected(edges(spark, b)), graph.strongly_connected(edges(spark, a)))
    assert as_dict(got, "id", "symbols") == {min(c): len(c) for c in new - old if len(c) > 1}


def test_boundaries_and_the_whole_drift_report(spark):
    e = edges(spark, [(1, 2), (1, 2), (2, 3), (3, 4), (4, 5), (5, 1)])
    now = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 1), (5, 9)], "id long, community long")
    was = spark.createDataFrame([(1, 1), (2, 1), (3, 5), (4, 1)], "id long, community long")
    first = A.boundary_violations(e, now)
    assert rows(first, "id", "other", "informational") == {(1, 2, True), (2, 3, True), (4, 5, True), (5, 1, True)}
    assert rows(A.boundary_violations(e, now, was.limit(0)), "informational") == {(True,)}
    later = A.boundary_violations(e, now, was)
    assert rows(later, "id", "other", "informational") == {(1, 2, False), (4, 5, False), (5, 1, False)}  # 2 -> 3 crossed before
    structural = A.structural_drift(edges(spark, [(1, 2), (2, 1), (7, 8)]))
    assert rows(structural, "drift_type", "id", "symbols") == {("new_cycle", 1, 2), ("orphaned", 7, 2)}
    semantic = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, magnitude double")
    seen = spark.createDataFrame([("semantic", 2, None, None), ("boundary_violation", 4, 5, "calls"), ("orphaned", 1, None, None)], "drift_type string, id long, other long, edge_kind string")
    entries, counts = A.drift_report(semantic, later, structural, seen)
    assert rows(entries, "drift_type", "id", "other") == {("semantic", 1, None), ("boundary_violation", 1, 2), ("boundary_violation", 5, 1), ("new_cycle", 1, None), ("orphaned", 7, None)}
    assert counts.first().asDict() == {"semantic_drifts": 1, "boundary_violations": 2, "emerging_hubs": 0, "new_cycles": 1, "orphaned_subgraphs": 1}
    assert A.drift_report(semantic, first, structural)[1].first().boundary_violations == 0  # information only


def test_hubs_grow_against_the_earlier_graph(spark):
    before = edges(spark, [(k, k + 1) for k in range(1, 30)])
    now = edges(spark, [(k, k + 1) for k in range(1, 30)] + [(k, 5) for k in range(10, 30)])
    hubs = A.structural_drift(now, before).filter("drift_type = 'emerging_hub'")
    assert 5 in {r.id for r in hubs.collect()} and hubs.filter(F.col("magnitude") <= 0).count() == 0
