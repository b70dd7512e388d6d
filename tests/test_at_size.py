"""Steps that have to hold at size: the same results by plans that grow with the input."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlab.operators import aggregates as A, analysis, blocks, communities, graph, joins, vector_index


def plain_neighbors(e, s):
    res = {(a, i, k) for a, n, k in e for i, q, _ in s if q == n and n is not None}
    both = {(a, b, k) for a, b, k in res} | {(b, a, joins.REVERSE.get(k)) for a, b, k in res}
    return sorted(((a, b, k, q, f) for a, b, k in both for i, q, f in s if i == b and b is not None), key=repr)


def test_names_of_many_bearers_are_not_written_out(spark):
    rng = random.Random(5)
    names = [f"n{k}" for k in range(6)] + [None]
    for symbols, kinds in (
        ([(k, names[k % 6], f"f{k % 4}") for k in range(40)] + [(None, "n1", "f0")], ["calls", "depends_on", "x", "y"]),
        ([(k // 2, names[k % 5], f"f{k % 4}") for k in range(40)], ["calls", "called_by", None]),
    ):
        e = [(rng.randrange(44), rng.choice([*names, "none"]), rng.choice(kinds)) for _ in range(300)]
        ed = spark.createDataFrame(e, "source_id long, target_qualified_name string, edge_kind string")
        sy = spark.createDataFrame(symbols, "id long, qualified_name string, file_path string")
        counts = Counter((a, i, k) for a, n, k in e for i, q, _ in symbols if q == n and n is not None)
        assert {tuple(r)[:3]: r.n for r in joins.edge_counts(ed, sy).collect()} == counts
        pairs = Counter()
        for (a, i, _), n in counts.items():
            for p, _, f in symbols:
                for q, _, g in symbols:
                    if p == a and q == i and i is not None and f != g:
                        pairs[min(f, g), max(f, g)] += n
        assert {tuple(r)[:2]: r.n_edges for r in joins.file_dependencies(ed, sy).collect()} == pairs
        got = joins.neighbors(ed, sy).select("symbol_id", "neighbor_id", "edge_type", "neighbor_name", "neighbor_file").collect()
        assert sorted(map(tuple, got), key=repr) == plain_neighbors(e, symbols)
    plan = joins.neighbors(ed.filter("edge_kind = 'calls'"), sy.dropDuplicates(["id"]))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Union", 1)[0]  # nothing is made distinct behind the joins


def test_static_groups_are_the_listed_pairs(spark):
    rng = random.Random(8)
    rows = {(c, f"f{rng.randrange(9)}", c // 3) for c in range(60) for _ in range(3)}
    commits = spark.createDataFrame(sorted(rows), "commit long, file string, at long")
    of = [(f"f{k}", g) for k in range(8) for g in ({k % 3, 7} if k < 2 else {k % 3})] + [("f3", None), ("f4", None), ("f5", 2)]
    pairs = {(a, b) for a, g in of for b, h in of if a < b and g is not None and g == h}
    got = A.mine_coupling(commits, static_groups=spark.createDataFrame(of, 'file string, "group" long'.replace('"', "`")), min_support=1)
    want = A.mine_coupling(commits, static_pairs=spark.createDataFrame(sorted(pairs), "file_a string, file_b string"), min_support=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.filter("static > 0").count() and want.filter("static = 0").count()


def test_blocks_of_vectors_meet_blocks_of_queries(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(900)]  # many ties
    rows += [(1000, None), (1001, [0.0] * 4), (1002, [1.0, 2.0]), (1050, [1.0, None, 2.0, 0.0]), (1004, []), (1100, [float("nan")] * 4), (1150, [3.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("query"), "embedding")
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and None not in x and np.linalg.norm(x) > 0}
    want = set()
    for q in (i for i in unit if i % 50 == 0):
        s = {i: round(float(x @ unit[q]), 12) for i, x in unit.items() if len(x) == len(unit[q])}
        want |= {(q, i, r) for r, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:7], 1)}
    for block in (vector_index.BLOCK, 120):
        assert {(r.query, r.id, r["rank"]) for r in vector_index.exact(v, asked, 7, block).collect()} == want
    x = np.round(rng.normal(size=(3000, 3)), 1)
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, i, s = vector_index._best(x[:40], x, np.arange(len(x)), 9)
    full = np.round(x[:40] @ x.T, 12)
    assert [tuple(r) for r in zip(q, i)] == [(a, b) for a in range(40) for b in np.lexsort((np.arange(len(x)), -full[a]))[:9]]


def test_files_meet_in_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [(int(f), [float(x) for x in rng.normal(size=5)]) for f in rng.choice(9, 300, p=[0.6] + [0.05] * 8)]
    rows += [(20, [0.0] * 5), (21, None), (22, [1.0, 2.0]), (23, [2.0, 4.0]), (None, [1.0, 2.0])] + [(24, [1.0, 0.0, 0.0, 0.0, 0.0])] * 30
    v = spark.createDataFrame(rows, "file long, embedding array<double>")
    files = [*range(9), 20, 21, 22, 23, 24, 99]
    pairs = [(a, b) for a in files for b in files if a < b and (a + b) % 5] + [(3, 3), (7, 2), (1, 2)]

    def cosine(x, y):
        n = np.linalg.norm(x) * np.linalg.norm(y) if x and y and len(x) == len(y) else 0
        return min(1.0, max(0.0, float(np.dot(x, y) / n))) if n else 0.0

    known = {f for f, _ in rows}
    want = {(a, b): max(cosine(x, y) for f, x in rows if f == a for g, y in rows if g == b) for a, b in pairs if {a, b} <= known}
    for block in (joins.BLOCK, 40):
        got = joins.max_pair_similarity(spark.createDataFrame(pairs, "file_a long, file_b long"), v, block)
        assert {(r.file_a, r.file_b): r.similarity for r in got.collect()} == pytest.approx(want, abs=1e-12)
    assert "MapInArrow" in (p := got._jdf.queryExecution().executedPlan().toString()) or "CoGroupsInArrow" in p


def test_reports_compute_what_is_asked_for(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2, "calls"), (2, 1, "calls"), (3, 4, "calls"), (4, 2, "calls")], "source_id long, target_id long, edge_kind string")
    known = spark.createDataFrame([(1, "a", "f", 1, 0.5, True, 0.2)], "id long, name string, file string, tests int, drift double, has_record boolean, recency double")
    drift = lambda **more: sorted(tuple(r) for r in analysis.structural_drift(e, e.filter("source_id > 1"), 0.5, 0.0, **more).collect())
    both, hot = drift(), analysis.health_report(known, e)["risk_hotspots"].collect()
    assert drift(include=("new_cycle",)) == [r for r in both if r[0] == "new_cycle"] != []

    def never(*_, **__):
        raise AssertionError("not asked for")

    monkeypatch.setattr(graph, "strongly_connected", never)
    monkeypatch.setattr(graph, "connected_components", never)
    got = analysis.health_report(known, e, include=("risk_hotspots",), summary=False)
    assert set(got) == {"risk_hotspots"} and got["risk_hotspots"].collect() == hot
    assert drift(include=("emerging_hub",)) == [r for r in both if r[0] == "emerging_hub"]


def test_container_pairs_come_up_once_without_a_shuffle_behind_the_join(spark):
    rng = random.Random(3)
    rows = [(0, f"f{k % 2}", k, f"0:{k}", ["s", "t", ""][k % 3]) for k in range(60)]
    e = spark.createDataFrame(rows, "run int, file string, id long, node string, stem string")
    groups = spark.createDataFrame([(n, n, k % 13 == 0) for k, (_, _, _, n, _) in enumerate(rows)], "node string, rep string, split boolean")
    ties = {tuple(sorted(f"0:{k}" for k in rng.sample(range(60), 2))) for _ in range(14)}
    g = spark.createDataFrame([(a, b, 1) for a, b in ties], "a string, b string, weight long")
    tied = {x for t in ties for x in t}
    single = [r for k, r in enumerate(rows) if k % 13 and r[4]]
    want = {tuple(sorted((x[3], y[3]))) for x in single for y in single if x[3] != y[3] and (x[1], x[4]) == (y[1], y[4]) and x[3] not in tied}
    added, rescued = communities.container_rescue(e, groups, g)
    got = [(r.a, r.b) for r in added.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.node for r in rescued.collect()} == {x for p in want for x in p} - tied
    assert "Aggregate" not in added._jdf.queryExecution().executedPlan().toString()


def test_ranks_step_by_blocks_of_nodes(spark, monkeypatch):
    """Several blocks and spans of targets, ids out of order, sinks and repeats: the ranks of plain power iteration, and steps that move a row for each block."""
    monkeypatch.setattr(blocks, "SIZE", 8)
    monkeypatch.setattr(blocks, "SPAN", 2)
    monkeypatch.setattr(blocks, "LEAST", 4)
    rng = random.Random(8)
    pairs = [(rng.randrange(60) * 7 % 61, rng.randrange(75) * 7 % 83) for _ in range(300)]
    every = sorted({x for p in pairs for x in p})
    out = Counter(a for a, _ in pairs)

    def plain(start, back, keep, steps):
        r = dict(start)
        for _ in range(steps):
            lost = sum(v for x, v in r.items() if not out[x])
            new = {x: back[x] * ((1 - keep) + keep * lost) for x in every}
            for a, b in pairs:
                new[b] += keep * r[a] / out[a]
            r = new
        return r

    even = dict.fromkeys(every, 1 / len(every))
    ed = spark.createDataFrame(pairs, "source_id long, target_id long")
    rows = []
    powers = graph._powers
    monkeypatch.setattr(graph, "_powers", lambda *a: rows.append(powers(*a)) or rows[-1])
    got = {r.id: r["rank"] for r in graph.pagerank(ed, 0.85, 6).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in plain(even, even, 0.85, 6).items()}
    assert rows[0].columns == ["b", "v", "k"]
    seeds = [x for x in every if x % 5 == 0]
    s = {x: (1 / len(seeds) if x in seeds else 0.0) for x in every}
    got = {r.id: r["rank"] for r in graph.personalized_pagerank(ed, spark.createDataFrame([(x,) for x in [*seeds, 999]], "id long"), 0.15, 6).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in plain(s, s, 0.85, 6).items() if v > 0}


@pytest.mark.parametrize("together", [200_000, 12])
def test_small_weak_components_are_walked_inside_tasks(spark, monkeypatch, together):
    monkeypatch.setattr(graph, "TOGETHER", together)
    rng = random.Random(4)
    pairs = [(f"{c}{rng.randrange(n):02}", f"{c}{rng.randrange(n):02}") for c, n, m in (("a", 14, 20), ("b", 5, 8), ("c", 6, 6), ("d", 9, 11)) for _ in range(m)] + [("x", "x"), ("y", "z")]
    every = {x for p in pairs for x in p}
    far = {x: {x} for x in every}
    for _ in every:
        for a, b in pairs:
            for x in every:
                far[x] |= {b} if a in far[x] else set()
    e = spark.createDataFrame(pairs, "source_id string, target_id string")
    got = {r.id: r.component for r in graph.strongly_connected(e, graph.connected_components(e)).collect()}
    assert got == {x: min(y for y in far[x] if x in far[y]) for x in every}
    assert len(set(got.values())) < len(every)


def test_strong_components_go_by_blocks_of_nodes(spark, monkeypatch):
    """Several blocks of nodes, a chain, cycles that meet one way, loops; a round moves no row for a node or an edge."""
    monkeypatch.setattr(blocks, "LEAST", 8)
    monkeypatch.setattr(blocks, "SIZE", 8)
    monkeypatch.setattr(blocks, "SPAN", 2)
    monkeypatch.setattr(graph, "cut", lambda _: pytest.fail("rows of nodes or edges"))
    rng = random.Random(8)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(40 + k, 41 + k) for k in range(5)] + [(60, 61), (61, 62), (62, 60), (62, 50), (50, 51), (51, 50), (51, 3), (70, 70)]
    every = {x for p in pairs for x in p}
    far = {x: {x} for x in every}
    for _ in every:
        for a, b in pairs:
            for x in every:
                far[x] |= {b} if a in far[x] else set()
    got = {r.id: r.component for r in graph.strongly_connected(spark.createDataFrame(pairs, "source_id long, target_id long")).collect()}
    assert got == {x: min(y for y in far[x] if x in far[y]) for x in every}


@pytest.mark.parametrize("together", [40, 1_000_000])
def test_moves_of_small_components_are_the_rounds_of_joins(spark, monkeypatch, together):
    monkeypatch.setattr(communities, "TOGETHER", together)
    cuts = []
    monkeypatch.setattr(communities, "cut", lambda df, f=communities.cut: cuts.append(1) or f(df))
    rng = random.Random(7)
    pairs = [(k * 100 + rng.randrange(n), k * 100 + rng.randrange(n)) for k, n in enumerate((30, 9, 9, 2)) for _ in range(3 * n)] + [(900, 900)]
    e = spark.createDataFrame(pairs, "source_id long, target_id long")
    got = {r.id: r.community for r in communities.louvain(e).collect()}
    if together > len(pairs):
        assert len(cuts) <= 8  # a round of joins has two
    u = communities.cut(graph.undirected(e))
    nodes = graph.nodes(e).withColumns({"total": F.lit(float(len(pairs))), "resolution": F.lit(1.0)})
    assert got == {r.id: r.community for r in communities.local_moves(u, nodes).collect()}


def test_container_rescue_is_spanned_by_few_edges(spark):
    held = [("a", "b"), ("a", "c"), ("b", "c"), ("0", "b"), ("0", "c"), ("0", "a"), ("b", "z"), ("a", "z"), ("c", "z"), ("x", "y")]  # a, b, c rescued, 0 and z tied
    thin = communities._spanning(spark.createDataFrame([(a, b, 1) for a, b in held], "a string, b string, weight long"))
    assert thin.count() <= 7
    c = {r.id: r.component for r in graph.connected_components(thin.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))).collect()}
    assert c == {**dict.fromkeys("0abcz", "0"), "x": "x", "y": "x"}


def test_moves_of_stems_are_those_of_their_pairs():
    """Rescued stems go through the rounds as a row for each group: the communities of the listed pairs, and no pair where there are many."""
    r = np.random.default_rng(5)
    for _ in range(150):
        n, m = int(r.integers(2, 50)), int(r.integers(0, 90))
        stem = r.integers(-1, int(r.integers(1, 5)), n)
        zero = (r.random(n) < r.random()) & (stem >= 0)
        ends = np.sort(r.integers(0, n, (2, m)), axis=0)
        weight = r.integers(1, 4, m).astype(float)
        i, j = np.triu_indices(n, 1)
        held = (stem[i] >= 0) & (stem[i] == stem[j]) & (zero[i] | zero[j])
        a, b, every = np.r_[ends[0], i[held]], np.r_[ends[1], j[held]], np.r_[weight, np.ones(held.sum())]
        if len(a):
            fixed = np.arange(n), np.full(n, every.sum()), np.full(n, r.choice([0.1, 0.5, 1.0]))
            rounds = int(r.choice([2, 50]))
            assert (communities._rounds(*fixed, *ends, weight, rounds, stem, zero) == communities._rounds(*fixed, a, b, every, rounds)).all()
    n = 20_000  # 200 million pairs
    none = np.zeros(0, dtype=np.int64)
    got = communities._rounds(np.arange(n), np.full(n, n * (n - 1) / 2), np.full(n, 0.5), none, none, none.astype(float), 3, np.zeros(n, dtype=int), np.ones(n, dtype=bool))
    assert (got != np.arange(n)).sum() == 3  # of nodes that are all joined one moves in a round


def test_stems_stand_for_the_pairs_of_container_rescue(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(0, f"f{k % 2}", k, f"0:{k}", ["s", "t", "", f"u{k}"][k % 4]) for k in range(60)]
    e = spark.createDataFrame(rows, "run int, file string, id long, node string, stem string")
    groups = spark.createDataFrame([(n, n, k % 13 == 0) for k, (_, _, _, n, _) in enumerate(rows)], "node string, rep string, split boolean")
    ties = {tuple(sorted(f"0:{k}" for k in rng.sample(range(60), 2))) for _ in range(14)}
    g = spark.createDataFrame([(a, b, 1) for a, b in ties], "a string, b string, weight long")
    added, rescued = communities.container_rescue(e, groups, g)
    stems = communities.container_stems(e, groups, g)
    pairs = sorted((r.a, r.b) for r in added.collect())
    assert sorted((r.a, r.b) for r in communities._listed(stems).collect()) == pairs
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    assert {r.rep: (r.weight, r.other) for r in stems.collect()} == {k: (len(v), min(v)) for k, v in near.items()}
    assert {r.rep for r in stems.collect() if not r.tied} == {r.node for r in rescued.collect()}
    monkeypatch.setattr(communities, "_listed", lambda *_: pytest.fail("pairs are listed"))
    nodes = stems.select(F.col("rep").alias("id"), F.lit(40.0).alias("total"), F.lit(0.5).alias("resolution"))
    weak = stems.select(F.col("rep").alias("id"), F.col("stem").alias("component"))
    none = spark.createDataFrame([], "a string, b string, weight long")
    moved = communities.local_moves(none, nodes, weak=weak, stems=stems)
    listed = communities.local_moves(spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, weight long"), nodes)
    assert sorted(moved.collect()) == sorted(listed.collect())


@pytest.mark.parametrize("within", [30, 2_000_000])
def test_components_of_scopes_are_those_of_the_whole_graph(spark, monkeypatch, within):
    monkeypatch.setattr(graph, "WITHIN", within)
    rng = random.Random(9)
    pairs = [(k, f"{k}:{rng.randrange(m)}", f"{k}:{rng.randrange(m)}") for k, m in enumerate((40, 9, 3)) for _ in range(m)] + [(3, f"3:{x:03}", f"3:{x + 1:03}") for x in range(25)]
    e = spark.createDataFrame(pairs, "scope int, source_id string, target_id string")
    assert sorted(graph.components_within(e).collect()) == sorted(graph.connected_components(e.drop("scope")).collect())


def test_moves_with_short_keys_are_those_with_long_ones():
    """Counts are summed up inside sorted keys, other weights beside them: half the weights, and half the totals, move the same nodes."""
    r = np.random.default_rng(2)
    for n, m in ((40, 80), (400, 4_000), (2_000, 30_000)):
        a, b = np.sort(r.integers(0, n, (2, m)), axis=0)
        weight = r.integers(1, 5, m) * 1.0
        whole = communities._rounds(np.arange(n), np.full(n, weight.sum()), np.ones(n), a, b, weight, 50)
        assert (whole == communities._rounds(np.arange(n), np.full(n, weight.sum() / 2), np.ones(n), a, b, weight / 2, 50)).all()
        assert len(np.unique(whole)) < n


def test_names_of_many_bearers_take_little_room_in_files(spark, tmp_path):
    """Edges of one name follow each other, so their bearers repeat in order: 240,000 rows in less than a byte each."""
    rng = random.Random(3)
    s = spark.createDataFrame([(k * 7919 % 100_003, f"n{k % 40}") for k in range(4_000)], "id long, qualified_name string")
    s.write.parquet(f"{tmp_path}/symbols")  # a file of known size would be sent out
    s = spark.read.parquet(f"{tmp_path}/symbols")
    e = spark.createDataFrame([(k, f"n{rng.randrange(40)}", "calls") for k in range(2_400)], "source_id long, target_qualified_name string, edge_kind string")
    plan = joins.edge_counts(e, s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # a table of bearers that is sent out leaves names mixed
    joins.edge_counts(e, s).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 240_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 240_000
