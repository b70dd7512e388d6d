"""Recall, trends, intents, task symbols and the git source."""

import subprocess

import pytest
from pyspark.sql import functions as F

from skeinlab.functions import specs, udfs
from skeinlab.operators import catalog, health, recall
from skeinlab.sources import git, tables


def test_periods():
    assert [specs.period(x) for x in (None, " 7D", "1h", "2w")] == [("24h", 86400), ("7d", 604800), ("1h", 3600), ("24h", 86400)]


def test_recall_falls_back_without_semantic_candidates(spark):
    lexical = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    facts = spark.createDataFrame([(1, 0, None), (2, 99, 1000), (3, 0, None)], "id long, accesses long, last_ms long")
    none = spark.createDataFrame([], "id long, rank long, similarity double")
    for semantic in (None, none):
        notes, used = recall.recall(lexical, semantic, facts, "hybrid", 1000, 10)
        assert used == "lexical" and [r.id for r in notes.collect()] == [2, 1]  # use raises the second
    some = spark.createDataFrame([(3, 1, 0.9), (1, 2, 0.2)], "id long, rank long, similarity double")
    notes, used = recall.recall(lexical, some, facts, "hybrid", 1000, 10)
    assert used == "hybrid" and [r.id for r in notes.collect()] == [1, 2, 3]
    assert [r.id for r in recall.recall(lexical, some, facts, "semantic", 1000, 10)[0].collect()] == [3, 1]


def test_task_symbols_against_a_plain_walk(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)]
    dense, sparse = [(1, 1), (5, 2)], [(5, 1), (6, 2)]
    rrf = {}
    for i, r in dense + sparse:
        rrf[i] = rrf.get(i, 0) + 1 / (60 + r)
    seeds = sorted(rrf, key=lambda i: (-rrf[i], i))[:2]
    known = {x for e in edges for x in e}
    s = {i: (1 / len([x for x in seeds if x in known]) if i in seeds else 0.0) for i in known}
    rank = dict(s)
    for _ in range(20):
        new = {i: 0.15 * s[i] for i in known}
        for i in known:
            out = [b for a, b in edges if a == i]
            for j in out:
                new[j] += 0.85 * rank[i] / len(out)
            if not out:
                for j in known:
                    new[j] += 0.85 * rank[i] * s[j]
        rank = new
    want = {i: 0.6 * rrf.get(i, 0) + 0.4 * rank.get(i, 0) for i in known | set(rrf)}
    frame = lambda rows: spark.createDataFrame(rows, "id long, rank long")
    got = recall.task_symbols(frame(dense), frame(sparse), spark.createDataFrame(edges, "source_id long, target_id long"), top_k=2).collect()
    assert {r.id: r.score for r in got} == pytest.approx({i: v for i, v in want.items() if v > 0}, abs=1e-6)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_trend(spark):
    runs = spark.createDataFrame([(k, 50 + k, f"c{k}") for k in range(12)], "run_at long, score long, commit string")
    assert health.trend(runs, 70, "new").first().trend == [*range(53, 62), 70]
    assert health.trend(runs, 61, "c11").first().trend == list(range(52, 62))
    assert health.trend(runs.limit(0), 9, None).first().trend == [9]


def test_intents_end_once(spark):
    i = spark.createDataFrame([("a", "pending", 1, None), ("b", "failed", 2, 5), ("c", "complete", 3, 6), ("d", "graph_done", 0, None)], "intent_id string, status string, created_at long, completed_at long")
    assert [r.intent_id for r in catalog.incomplete_intents(i).collect()] == ["d", "a"]
    assert {r.intent_id: r.next_status for r in catalog.replay_intents(i, failed_too=True).collect()} == {"d": "complete", "a": "sqlite_done", "b": "pending"}
    done = catalog.update_status(i, spark.createDataFrame([("d", "complete")], "intent_id string, status string"), 9).orderBy("intent_id").collect()
    assert [(r.status, r.completed_at) for r in done] == [("pending", None), ("failed", 5), ("complete", 6), ("complete", 9)]


def test_git_source(spark, tmp_path):
    repo = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=A B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for k, text in enumerate(("one\ntwo\n", "one\n2\n\tthree\n")):
        (tmp_path / "x y.txt").write_text(text)
        (tmp_path / f"f{k}.txt").write_text("z")
        run("add", "-A")
        run("commit", "-qm", f"c{k}")
    c = git.commits(spark, repo)
    assert sorted(r.file for r in c.collect()) == ["f0.txt", "f1.txt", "x y.txt", "x y.txt"] and {r.author for r in c.collect()} == {"A B"}
    assert catalog.file_log(c, "x y.txt", 5).count() == 2 and catalog.file_log(c, "f1.txt", 5).count() == 1
    lines = git.blame(spark, repo, "x y.txt").orderBy("line").collect()
    assert [r.content for r in lines] == ["one", "2", "\tthree"] and lines[0].commit != lines[1].commit == lines[2].commit
    assert git.changed_paths(repo, "HEAD~1", "HEAD") == ["f1.txt", "x y.txt"]
    assert catalog.commit_files(c, lines[1].commit, F.col("file").startswith("f")).count() == 1


def test_staged_commits(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([(1, "a")], "id long, blob string")
    tables.write_staged({"records": one, "history": one}, root, "c1")
    tables.write_staged({"records": one.withColumn("id", one.id + 1)}, root, "c2")
    one.write.parquet(f"{root}/tables/records/attempt=a3")  # a crash before the commit is named
    assert sorted((r.id, r.commit) for r in tables.read_committed(spark, root, "records").collect()) == [(1, "c1"), (2, "c2")]
    assert tables.read_committed(spark, root, "history").count() == 1 and tables.read_committed(spark, root, "none") is None


def test_a_rewrite_that_fails_leaves_the_commit_as_it_was(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([(1, "a")], "id long, blob string")
    tables.write_staged({"records": one, "vectors": one}, root, "c1")
    broken = one.withColumn("blob", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        tables.write_staged({"records": one.withColumn("id", one.id + 8), "vectors": broken}, root, "c1")
    read = lambda name: [tuple(r) for r in tables.read_committed(spark, root, name).select("id", "commit").collect()]
    assert read("records") == read("vectors") == [(1, "c1")]
    tables.write_staged({"records": one.withColumn("id", one.id + 4)}, root, "c1")  # a rewrite that ends replaces the whole commit
    assert read("records") == [(5, "c1")] and tables.read_committed(spark, root, "vectors") is None


def test_migrations_start_at_the_version(spark):
    df = spark.createDataFrame([(1,)], "id long")
    steps = [lambda t: t.withColumn("a", F.lit(1)), lambda t: t.withColumn("b", F.lit(2))]
    assert tables.migrate(df, 0, steps)[0].columns == ["id", "a", "b"]
    out, version = tables.migrate(df, 1, steps)
    assert out.columns == ["id", "b"] and version == 2


def test_providers_fail_over(spark):
    def broken(units):
        raise ValueError("no answer")

    udfs.register_annotator("broken", broken)
    u = spark.createDataFrame([(k, f"word {k}") for k in range(150)], "id long, content string")
    got = udfs.annotate(u, "broken", fallback="first_words").collect()
    assert [(r.intent, r.error) for r in got] == [(f"word {k}", None) for k in range(150)]
    assert {(r.intent, r.error) for r in udfs.annotate(u, "broken", retries=0).collect()} == {(None, "no answer")}


def test_task_symbols_search_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        asked.add(1)
        return x

    ranks = spark.createDataFrame([(k, k + 1) for k in range(5)], "id long, rank long")
    e = spark.createDataFrame([(k, (k * 3 + 1) % 7) for k in range(7)], "source_id long, target_id long")
    out = recall.task_symbols(ranks.withColumn("rank", counted("rank")), ranks, e, top_k=2)
    assert len(out.collect()) == 7
    assert asked.value == 5
