"""Hand-computed cases for the operators."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlab.functions import exprs as X
from skeinlab.operators import aggregates as A, graph, graph_local, joins, ranking, search, temporal

DIAMOND = [(1, 2), (1, 3), (2, 4), (3, 4)]
CYCLE_TAIL = [(1, 2), (2, 3), (3, 1), (3, 4)]
TRIANGLES = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4)]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source_id long, target_id long, edge_kind string")


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_pagerank_counts_parallel_edges_and_spreads_dangling_mass(spark):
    r = as_dict(graph.pagerank(edges(spark, [(1, 2), (1, 2), (1, 3)]), 0.85, 1), "id", "rank")
    lost = 2 / 3
    base = 0.15 / 3 + 0.85 * lost / 3
    assert r[1] == pytest.approx(base)
    assert r[2] == pytest.approx(base + 0.85 * (1 / 3) * 2 / 3)
    assert sum(r.values()) == pytest.approx(1.0)


def test_personalized_pagerank_keeps_mass_at_seeds(spark):
    seeds = spark.createDataFrame([(1,)], "id long")
    r = as_dict(graph.personalized_pagerank(edges(spark, DIAMOND), seeds, 0.15, 20), "id", "rank")
    assert sum(r.values()) == pytest.approx(1.0)
    assert r[2] == pytest.approx(r[3])
    assert r[1] > r[4] > 0


def test_hops_and_paths(spark):
    e = edges(spark, [*DIAMOND, (4, 5)])
    start = spark.createDataFrame([(1,)], "id long")
    assert as_dict(graph.k_hop(e, start, 2), "id", "depth") == {1: 0, 2: 1, 3: 1, 4: 2}
    assert as_dict(graph.k_hop(e, start, -1), "id", "depth") == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert [r.id for r in graph.shortest_path(e, 1, 5).orderBy("step").collect()] == [1, 2, 4, 5]
    assert graph.shortest_path(e, 5, 1).count() == 0


def test_components(spark):
    e = edges(spark, [(9, 8), (8, 7), (7, 6), (1, 2), (4, 4)])
    assert as_dict(graph.connected_components(e), "id", "component") == {9: 6, 8: 6, 7: 6, 6: 6, 1: 1, 2: 1, 4: 4}
    assert as_dict(graph.strongly_connected(edges(spark, CYCLE_TAIL)), "id", "component") == {1: 1, 2: 1, 3: 1, 4: 4}
    assert as_dict(graph.strongly_connected(edges(spark, TRIANGLES)), "id", "component") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_local_algorithms(spark):
    assert as_dict(graph_local.louvain(edges(spark, TRIANGLES)), "id", "community") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    b = as_dict(graph.betweenness(edges(spark, DIAMOND)), "id", "score")
    assert b[2] == pytest.approx(0.5 / 6) and b[1] == 0
    twice = as_dict(graph.betweenness(edges(spark, [*DIAMOND, (1, 2)])), "id", "score")
    assert twice[2] == pytest.approx(2 / 3 / 6)
    t = graph_local.toposort(edges(spark, [*DIAMOND, (8, 9), (9, 8)]).withColumn("f", F.lit("x")), "f").orderBy("place")
    assert [r.id for r in t.collect()] == [1, 2, 3, 4, 8, 9]
    assert graph_local.agglomerate([{1, 2}, {1, 2}, {7}], 0.5) == [[0, 1], [2]]


def plain_betweenness(pairs):
    """Pair by pair: the share of the shortest paths from a to c that pass b, by path counts."""
    every = sorted({x for p in pairs for x in p})
    out = {x: [b for a, b in pairs if a == x and a != b] for x in every}
    far, ways = {}, {}
    for s in every:
        far[s], ways[s], level = {s: 0}, {s: 1}, [s]
        while level:
            new = {}
            for x in level:
                for y in out[x]:
                    if y not in far[s]:
                        new[y] = new.get(y, 0) + ways[s][x]
            far[s].update({y: far[s][level[0]] + 1 for y in new})
            ways[s].update(new)
            level = list(new)
    score = dict.fromkeys(every, 0.0)
    for a in every:
        for c in far[a]:
            for b in far[a]:
                if len({a, b, c}) == 3 and c in far[b] and far[a][b] + far[b][c] == far[a][c]:
                    score[b] += ways[a][b] * ways[b][c] / ways[a][c]
    return {x: v / max(1, (len(every) - 1) * (len(every) - 2)) for x, v in score.items()}


@pytest.mark.parametrize("messages", [200_000_000, 400])
def test_betweenness_equals_path_counts(spark, messages):
    """Repeated edges, loops, a tail, an isolated loop and two components; all starts at once and in blocks."""
    r = random.Random(5)
    pairs = [(r.randrange(14), r.randrange(14)) for _ in range(34)] + [(20, 21), (21, 22), (21, 22), (22, 23), (20, 23), (30, 30)]
    got = as_dict(graph.betweenness(edges(spark, pairs), messages), "id", "score")
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in plain_betweenness(pairs).items()}
    assert max(got.values()) > 0.05


@pytest.mark.parametrize("packed", [4_000_000, 20, 0])
def test_betweenness_by_ranges_of_starts_and_by_rows(spark, monkeypatch, packed):
    """Components inside tasks, in ranges of a few starts, do not go by rows; larger ones do, with the same scores."""
    r = random.Random(6)
    pairs = [(r.randrange(14), r.randrange(14)) for _ in range(40)] + [(20, 21), (21, 22), (21, 22), (22, 23), (20, 23), (30, 30)]
    pairs += [(40 + r.randrange(9), 40 + r.randrange(9)) for _ in range(30)]
    monkeypatch.setattr(graph, "PACKED", packed)
    monkeypatch.setattr(graph, "WALKED", 100)
    if packed == 4_000_000:
        monkeypatch.setattr(graph, "_owed_by_rows", lambda *_: pytest.fail("by rows"))
    for together in (200_000, 40, 8):  # all in one task, one alone, all alone
        monkeypatch.setattr(graph, "TOGETHER", together)
        got = as_dict(graph.betweenness(edges(spark, pairs), 2_000), "id", "score")
        assert got == {k: pytest.approx(v, abs=1e-12) for k, v in plain_betweenness(pairs).items()}
        if packed < 4_000_000:
            break


def test_betweenness_holds_few_bytes_for_an_edge():
    """The walk of one task holds a component in both directions and its levels in less than 40 bytes an edge."""
    r = np.random.default_rng(1)
    n, k = 2_000, 100_000
    count = np.bincount(r.integers(0, n, k), minlength=n).astype(np.int32)
    y, m = r.integers(0, n, k).astype(np.int32), np.ones(k, dtype=np.uint8)
    tracemalloc.start()
    graph._owed(count, y, m, 0, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * k


def test_betweenness_of_an_edge_that_occurs_often(spark):
    pairs = [(1, 2), (1, 3), (2, 4), (3, 4)] + [(1, 2)] * 299
    got = as_dict(graph.betweenness(edges(spark, pairs)), "id", "score")
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in plain_betweenness(pairs).items()}


def test_betweenness_without_paths(spark):
    assert graph.betweenness(edges(spark, [])).count() == 0
    assert as_dict(graph.betweenness(edges(spark, [(1, 2), (3, 3)])), "id", "score") == {1: 0.0, 2: 0.0, 3: 0.0}


def test_staleness_flows_to_dependents(spark):
    e = edges(spark, [(2, 1), (3, 2), (4, 3)])
    seeds = spark.createDataFrame([(1, 1.0, 0.8)], "id long, staleness double, delta double")
    assert as_dict(graph.propagate_staleness(e, seeds, 0.5, 0.15), "id", "induced") == {2: pytest.approx(0.4), 3: pytest.approx(0.2)}


def test_epicenter_walk(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4)])
    h = spark.createDataFrame(
        [(1, 10, 1, 0.5, False, True), (2, 9, 2, 0.6, False, True), (3, 9, 3, 0.3, True, False), (4, 9, 4, 0.9, True, False), (4, 20, 5, 1.0, True, False)],
        "symbol_id long, ts_us long, id long, delta_sem double, source_changed boolean, neighbor_changed boolean",
    )
    got = graph.trace_epicenters(e, h, spark.createDataFrame([(1,)], "id long")).orderBy("hop").collect()
    assert [(r.id, r.at) for r in got] == [(1, 10), (2, 9), (4, 9)]


def test_coupling(spark):
    rows = [(c, f, c) for c, fs in {1: "abc", 2: "ab", 3: "abd", 4: "".join(chr(97 + k) for k in range(8))}.items() for f in fs]
    c = A.mine_coupling(spark.createDataFrame(rows, "commit long, file string, at long"), min_support=3, max_files=4).collect()
    assert [(r.file_a, r.file_b, r.co_change_count, r.temporal, r.coupling_type, r.last_commit) for r in c] == [("a", "b", 3, 1.0, "hidden_operational", 3)]


def test_velocity_and_stability(spark):
    fp = spark.createDataFrame([(1, 1, 0.9, False, True), (1, 2, 0.4, True, False), (1, 3, 0.1, False, False)], "b int, symbol_id long, delta_sem double, source_changed boolean, config_changed boolean")
    w = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 3.0)], "symbol_id long, weight double")
    r = A.velocity(fp, w, "b", 0.2).first()
    assert (r["shift"], r.regenerated, r.above_noise) == (pytest.approx(0.05), 2, 1)
    c = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "symbol_id long, community string")
    assert as_dict(A.community_stability(fp, c, w, 0.2), "community", "stability") == {"x": 0.0, "y": 1.0}
    s = A.ema(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "k int, v double"), "k", "v", 0.5)
    assert as_dict(s, "k", "ema") == {1: 1.0, 2: 1.5, 3: 2.75}


def test_percentile_and_histogram(spark):
    d = spark.createDataFrame([("a", x) for x in (1, 2, 2, 5)] + [("b", 7)] + [("c", 3), ("c", 3)], "g string, v int")
    got = sorted((r.g, r.v, r.percentile) for r in ranking.mid_rank_percentile(d, ["g"], "v").collect())
    assert got == [("a", 1, 0.0), ("a", 2, 0.5), ("a", 2, 0.5), ("a", 5, 1.0), ("b", 7, 0.5), ("c", 3, 0.5), ("c", 3, 0.5)]
    h = A.histogram(spark.createDataFrame([(0.0,), (0.05,), (1.0,)], "v double"), F.col("v"))
    assert as_dict(h, "bucket", "n") == {0: 2, 9: 1, **dict.fromkeys(range(1, 9), 0)}


def test_auc_and_logistic(spark):
    d = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, y boolean")
    assert A.auc(d, "s", "y").first().auc == pytest.approx(3.5 / 4)
    w = A.train_logistic(spark.createDataFrame([(1.0, 1), (-1.0, 0)], "x double, y int"), ["x"], "y", 0.1, 200)
    assert w[0] == pytest.approx(0.0, abs=1e-9) and w[1] > 1


def test_rrf(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank long")
    b = spark.createDataFrame([("x", 1)], "id string, rank long")
    assert as_dict(search.fuse([a, b]), "id", "rrf") == {"x": pytest.approx(2 / 61), "y": pytest.approx(1 / 62)}


def test_cosines(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert value(spark, X.cosine_unit(v(1, 0), v(-1, 0))) == 0
    assert value(spark, X.cosine_signed(v(1, 0), v(-1, 0))) == -1
    assert value(spark, X.cosine(v(0, 0), v(1, 0))) is None
    assert value(spark, X.cosine_unit(v(1), v(1, 0))) == 0


def test_scalars(spark):
    assert value(spark, X.millis(F.lit(999_999_999_999))) == 999_999_999_999_000
    assert value(spark, X.millis(F.lit(1_000_000_000_001))) == 1_000_000_000_001
    assert value(spark, X.raw_penalty(F.lit(15.0), 10.0, 20.0)) == 0.5
    assert value(spark, X.raw_penalty(F.lit(900.0), 10.0, 20.0)) == 2.0
    assert value(spark, X.dice(F.lit("abab"), F.lit("ab"))) == pytest.approx(2 * 1 / 4)
    assert value(spark, X.noisy_or(F.lit(0.5), F.lit(0.5))) == 0.75
    assert value(spark, X.time_staleness(F.lit(5.0), 5.0, 1.0)) == 0.5
    assert value(spark, X.effective_age(F.lit(2.0), F.lit(1.0))) == 4.0
    assert value(spark, X.estimate_tokens(F.lit("é" * 7))) == 4
    assert value(spark, X.first_sentence(F.lit(" a! b. c"))) == "a! b."
    assert value(spark, X.layer(F.lit("src/http_server.rs"), F.lit("x"), F.lit(None).cast("string"))) == "Interface"
    assert value(spark, X.keywords(F.lit("Fix the retry of the Retry cache"))) == ["fix", "retry", "cache"]
    assert value(spark, X.sparse_match(F.lit("a::Cache"), F.lit("p"), F.lit("fn"), F.lit("cache"))) == 0
    assert value(spark, X.is_ignored(F.lit("x/Node_Modules/y.js"), X.IGNORED_PARTS)) is True
    assert value(spark, F.lit("src/a.rs").rlike(X.glob_to_regex("src/*.rs"))) is True
    q = value(spark, F.struct(*[c.alias(k) for k, c in X.quality_signals(F.lit("Returns `x` when parse_it fails, then retries on timeout")).items()]))
    assert q.specificity == pytest.approx(3 / 5) and q.behavioral_depth == 1.0 and q.error_coverage == 0.5


def test_streaks_sessions_ranges(spark):
    s = ["fail", "pass", "fail", "fail", "ambiguous", "fail"]
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate(s)], "c int, k int, status string")
    assert [r.streak for r in temporal.fail_streaks(d, "c", ["k"]).orderBy("k").collect()] == [1, 0, 1, 2, 2, 3]
    e = spark.createDataFrame([("p", 0), ("p", 5), ("p", 11)], "p string, at long")
    assert sorted((r.started, r.n) for r in temporal.sessions(e, "p", "at", 5).collect()) == [(0, 2), (11, 1)]
    r = spark.createDataFrame([("f", 1, 10), ("f", 3, 4), ("f", 14, 20), ("f", 30, 31)], "f string, s int, e int")
    assert sorted((x.s, x.e) for x in temporal.merge_ranges(r, "f", "s", "e", 5).collect()) == [(1, 20), (30, 31)]


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 0), ("b", 4, 9)], "k string, id int, at long")
    right = spark.createDataFrame([("a", 4, 1, "x"), ("a", 4, 2, "y"), ("a", 6, 3, "z")], "k string, t long, v int, h string")
    got = {r.id: r.matched_h for r in joins.asof(left, right, "k", "at", "t", ["v"], ["h"]).collect()}
    assert got == {1: "y", 2: "y", 3: None, 4: None}


def test_token_budget_stops_at_the_first_misfit(spark):
    d = spark.createDataFrame([(0, 0, 1, "x" * 35), (0, 1, 2, "x" * 70), (0, 2, 3, "x" * 7), (1, 0, 4, "x" * 14)], "layer int, place int, id int, content string")
    assert sorted(r.id for r in ranking.token_budget(d, 15).collect()) == [1, 4]


def test_snapshots(spark):
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, h string")
    a = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, h string")
    assert as_dict(temporal.snapshot_diff(b, a, "k", "h"), "k", "change") == {1: "removed", 2: "updated", 3: "same", 4: "added"}
    assert math.isclose(value(spark, X.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))), 0.5)


def test_calibration_takes_the_first_pairs_of_each_sort(spark):
    def brute(rows, cap):
        rows = sorted(rows)
        cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        pairs = [(a[0] == b[0], cos(a[2], b[2])) for k, a in enumerate(rows) for b in rows[k + 1 :]]
        same, other = [s for t, s in pairs if t][:cap], [s for t, s in pairs if not t][:cap]
        return max(0.3, min(0.95, (sum(same) / len(same) + sum(other) / len(other)) / 2)), len(same) + len(other)

    hot = ["a"] * 30 + ["b"] * 3  # the first file holds more than 4 * cap vectors
    alone = [f"a{k:02}" for k in range(30)] + ["b"] * 6 + ["c"] * 2  # as many files of one vector come first
    few = ["a"] * 4 + ["b"] + ["c"] * 2  # fewer partners than cap
    for files in (hot, alone, few):
        rows = [(f, k, [1.0 + k % 3, 2.0 - k % 5, float(ord(f[0]) - 96)]) for k, f in enumerate(files)]
        v = spark.createDataFrame(rows, "file string, id long, embedding array<double>")
        got = A.calibrate(v, cap=5, least=2).first()
        want = brute(rows, 5)
        assert got.threshold == pytest.approx(want[0]) and got.sample_size == want[1]


def plain_paths(pairs, info, start, max_hops, budget):
    """A queue of paths, one start."""
    out = {}
    for a, b in sorted(set(pairs)):
        out.setdefault(a, []).append(b)
    best, todo = (-1.0, ()), [(start,)]
    while todo and budget:
        path, budget = todo.pop(0), budget - 1
        known = [info[x] for x in path if x in info]
        moves = sum(a[1] != b[1] for a, b in zip(known, known[1:]))
        score = 10 * len({x[0] for x in known}) + 4 * moves + 100 * sum(x[2] for x in known) + len(path)
        best = max(best, (round(score, 9), tuple(-x for x in path)))
        if len(path) <= max_hops:
            todo += [(*path, y) for y in out.get(path[-1], ()) if y not in path]
    return best[0], [-x for x in best[1]]


@pytest.mark.parametrize(("hops", "budget"), [(10, 2500), (3, 40), (2, 7)])
def test_interesting_paths_are_those_of_a_queue(spark, hops, budget):
    rng = random.Random(8)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(60)]
    info = {k: (f"l{k % 4}", f"f{k % 3}", rng.randrange(64) / 1024) for k in range(25) if k % 7}
    nodes = spark.createDataFrame([(k, *v) for k, v in info.items()], "id long, layer string, file string, centrality double")
    starts = spark.createDataFrame([(k,) for k in (0, 3, 3, 24, 99)], "id long")
    got = {r.start: (round(r.score, 9), r.path) for r in graph.interesting_path(edges(spark, pairs), nodes, starts, hops, budget).collect()}
    assert got == {k: plain_paths(pairs, info, k, hops, budget) for k in (0, 3, 24, 99)}


def test_interesting_paths_runs_with_the_limits_of_the_operator(spark, monkeypatch):
    from skeinlab.plans import queries_graph  # noqa: F401  registers the query
    from skeinlab.plans.registry import QUERIES

    seen = []
    monkeypatch.setattr(graph, "interesting_path", lambda e, n, starts, max_hops=10, max_expansions=2500: seen.append((max_hops, max_expansions)))
    QUERIES["interesting_paths"](spark, "/root/testdata/sf0.001")
    assert seen == [(10, 2500)]


def test_calibration_of_languages(spark):
    ten = [(k, "src/lib.rs", [1.0, 0.0], "rust") for k in range(10)]
    two = [(100 + k, "a", [1.0, 0.0], "go") for k in range(12)] + [(200 + k, "b", [0.0, 1.0], "go") for k in range(12)]
    one = [(300 + k, "c", [1.0, 0.0], "c") for k in range(30)] + [(400, "d", [0.0, 0.0], "c")]
    df = spark.createDataFrame(ten + two + one, "id long, file string, embedding array<double>, language string")
    got = {r.language: (r.threshold, r.sample_size) for r in A.calibrate_languages(df, ["rust", "Go", "c", "default"]).collect()}
    assert got.keys() == {"Go", "default"} and got["Go"] == (0.5, 132 + 144)  # rust has too few, c no second file with a vector


def test_no_more_paths_go_on_than_the_budget_takes(spark, monkeypatch):
    pairs = [(a, b) for a in range(40) for b in range(40) if a != b]
    nodes = spark.createDataFrame([(k, "l", "f", k / 1024) for k in range(40)], "id long, layer string, file string, centrality double")
    sizes, stored = [], graph.store

    def watched(df, *folder):
        out = stored(df, *folder)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "store", watched)
    got = graph.interesting_path(edges(spark, pairs), nodes, spark.createDataFrame([(0,)], "id long"), 10, 100).collect()
    assert len(got[0].path) == 3 and sum(sizes[1:]) <= 60  # 1 start, 39 paths behind it, and those that use up 60 more


def test_markers_are_looked_for_in_a_text_put_into_lower_case_once(spark):
    rows = [("Retries, then falls back: bypassed BY after_all; if-not", 6 / 4), ("bytes thenceforth 3when iffy", 0.0), ("WHEN\nwhile", 2 / 4), (" ", 0.0), ("", 0.0)]
    q = X.quality_signals(F.col("t"))
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", q["behavioral_depth"].alias("depth"))
    assert {r.t: r.depth for r in df.collect()} == {t: min(1.0, d) for t, d in rows}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
