"""The partitioned vector index against brute force, and the audit and absorption that work in rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlab.operators import graph, health, ordered, temporal, vector_index


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in centers[k % 12] + rng.normal(scale=0.4, size=16)], "x") for k in range(1500)]
    rows += [(2000, None, "x"), (2001, [0.0] * 16, "x"), (2002, [1.0, 2.0], "x"), (2003, rows[3][1], "x"), (2004, [], "x")]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, list_name string")
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.build(vectors, path, lists=24)
    return vectors, vector_index.load(spark, path)


def asked(vectors):
    return vectors.filter("id % 50 = 0").select(F.col("id").alias("query"), "embedding")


def as_lists(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["id"])
    return out


def test_index_finds_what_brute_force_finds(store):
    vectors, index = store
    truth = vector_index.exact(vectors, asked(vectors), 10)
    assert vector_index.recall(vector_index.search(index, asked(vectors), 10), truth).first().recall >= 0.9
    assert 1 <= index[2] < 24
    assert as_lists(vector_index.search(index, asked(vectors), 10, probes=24)) == as_lists(truth)  # all lists: exact
    x = {r.id: np.array(r.embedding) for r in vectors.filter("size(embedding) = 16").collect() if any(r.embedding)}
    for q, ids in as_lists(truth).items():
        if q in x:
            s = {i: round(float(v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q])), 9) for i, v in x.items()}
            assert ids == sorted(s, key=lambda i: (-s[i], i))[:10]
    assert index[0].count() == vectors.count()  # every row is kept


def test_one_query_opens_its_lists_alone(store):
    vectors, index = store
    q = vectors.filter("id = 7").first().embedding
    found = vector_index.search_one(index, q, 5, probes=3)
    assert found.first().id == 7
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "IN (" in plan.upper()
    assert vector_index.search_one(index, [0.0] * 16, 5).count() == vector_index.search_one(index, [1.0], 5).count() == 0


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<double>")
    vector_index.build(none, str(tmp_path / "i"))
    index = vector_index.load(spark, str(tmp_path / "i"))
    assert vector_index.search(index, none.select(F.col("id").alias("query"), "embedding"), 3).count() == 0


def test_audit_takes_callees_by_name_before_callers_by_id(spark):
    calls = spark.createDataFrame([(1, 2), (1, 3), (9, 1), (8, 1), (3, 4), (2, 4), (9, 5), (4, 6), (1, 2), (2, 1)], "source_id long, target_id long")
    names = spark.createDataFrame([(1, "root"), (2, "z"), (3, "a"), (4, "m"), (5, "n"), (6, "far"), (8, "k"), (9, "l")], "id long, name string")
    listed, totals = graph.audit_chain(calls, names, 1)
    assert [(r.id, r.role, r.depth) for r in listed.orderBy("place").collect()] == [(1, "root", 0), (3, "callee", 1), (2, "callee", 1), (8, "caller", 1), (9, "caller", 1), (4, "callee", 2), (5, "callee", 2)]
    assert tuple(totals.first()) == (2, 4, 2, 7)
    listed, totals = graph.audit_chain(calls, names, 1, "callees", 9, 2)
    assert [r.id for r in listed.orderBy("place").collect()] == [1, 3] and tuple(totals.first()) == (0, 4, 3, 5)
    assert graph.audit_chain(calls, names, 77)[1].first().found == 0
    with pytest.raises(ValueError, match="direction"):
        graph.audit_chain(calls, names, 1, "sideways")


def plain_absorb(clusters, used):
    """One trait: {method: cluster's first method}"""
    groups = [sorted(m for m in clusters if clusters[m] == c) for c in sorted({c for c in clusters.values() if c >= 0})]
    while True:
        best = None
        for f in groups:
            a = set().union(*(used.get(m, set()) for m in f))
            for t in groups:
                b = set().union(*(used.get(m, set()) for m in t))
                s = len(a & b) / len(a | b) if a | b else 0.0
                if len(f) == 1 and f != t and a and s >= 0.8:
                    best = min(best or (-s, f, t), (-s, f, t))
        if not best:
            return {m: g[0] for g in groups for m in g}
        groups = [g for g in groups if g not in best[1:]] + [sorted(best[1] + best[2])]


def test_single_clusters_join_those_with_their_consumers(spark):
    rng = random.Random(6)
    rows, usage, want = [], [], {}
    for t in ("T", "U"):
        clusters = {f"m{k:02}": (k if k < 8 else 8 if k < 12 else -1) for k in range(14)}
        used = {m: set(rng.choice(("abcd", "abcde", "wxyz", "wxyzv", "pq"))) for m in clusters if m != "m07"}
        rows += [(t, m, c) for m, c in clusters.items()]
        usage += [(t, m, x) for m, u in used.items() for x in u] * 2
        want |= {(t, m): c for m, c in plain_absorb(clusters, used).items()} | {(t, m): None for m in ("m12", "m13")}
    got = health.absorb_single_clusters(spark.createDataFrame(rows, "trait string, method string, cluster int"), spark.createDataFrame(usage, "trait string, method string, consumer string"))
    assert {(r.trait, r.method): r.cluster for r in got.collect()} == want
    assert any(c and c != m for (_, m), c in want.items())


def test_running_sums_and_averages_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.uniform(-1, 1)) for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    rows.sort()
    s, want = None, []
    for _, v in rows:
        s = v if s is None else s * 0.7 + v * 0.3
        want.append(s)
    got = ordered.smoothed(df, "k", "v", 0.3, "ema").orderBy("k").collect()
    assert [r.ema for r in got] == pytest.approx(want) and got[0].__fields__ == ["k", "v", "ema"]
    sums = ordered.with_sums(df, ["k"], v=F.col("v")).orderBy("k").collect()
    assert [r["_index"] for r in sums] == list(range(700)) and [r.before_v for r in sums] == pytest.approx([sum(v for _, v in rows[:k]) for k in range(700)])
    assert ordered.at_index(df, ["k"], F.col("_n") - 1).first().k == rows[-1][0]
    later = ordered.next_value(df, ["k"], "k", "then").orderBy("k").collect()
    assert [r.then for r in later] == [k for k, _ in rows[1:]] + [None]
    quiet = temporal.quiet_points(df.select("k"), "k", 40)
    assert sorted(r.k for r in quiet.collect()) == [a for (a, _), b in zip(rows, [*(k for k, _ in rows[1:]), 10**9]) if b - a >= 40]
    assert ordered.smoothed(df.limit(0), "k", "v", 0.3, "ema").count() == ordered.with_sums(df.limit(0), ["k"]).count() == 0
