"""Sources, sinks, extension functions and streams."""

import datetime as dt

from pyspark.sql import functions as F

from skeinlab.functions import udfs
from skeinlab.sources import code, tables
from skeinlab.streaming import streams


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src/a.rs").write_text("use crate::b;\n// note TODO\nfn main() { helper(1); }\nfn test_it() { main(); }\n")
    (tmp_path / "target/b.rs").write_text("fn gone() {}\n")
    (tmp_path / "src/c.txt").write_text("no")
    files = code.scan(spark, str(tmp_path))
    rows = {(r.row, r.name, r.target) for r in code.extract(files).collect()}
    assert ("symbol", "main", "") in rows and ("edge", "main", "helper") in rows and ("edge", "test_it", "main") in rows
    assert any(r[0] == "test" for r in rows) and not any(r[1] == "gone" for r in rows)
    loc = code.count_loc(files).first()
    assert (loc["loc"], loc["todo"]) == (3, 1)


def test_requests_and_results(spark, tmp_path):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt_hash string")
    left = tables.pending_requests(c, spark.createDataFrame([(1, "a"), (2, "x")], "id int, prompt_hash string"))
    tables.write_requests(left, str(tmp_path / "q"), 1)
    good, bad = tables.read_results(spark, str(tmp_path / "q"), "id int, prompt_hash string")
    assert [tuple(r) for r in good.collect()] == [(2, "b")] and bad.count() == 0
    (tmp_path / "r").mkdir()
    (tmp_path / "r/x.jsonl").write_text('{"id": 3}\nnot json\n\n')
    good, bad = tables.read_results(spark, str(tmp_path / "r"), "id int")
    assert [r.id for r in good.collect()] == [3] and [r.value for r in bad.collect()] == ["not json"]


def test_merge_and_partitions(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1, 7)], "id int, v string, at int, hits int")
    b = spark.createDataFrame([(1, "y", 2, 0), (2, "z", 1, 0)], "id int, v string, at int, hits int")
    got = {r.id: (r.v, r.hits) for r in tables.merge(a, b, ["id"], "at", ["hits"]).collect()}
    assert got == {1: ("y", 7), 2: ("z", 0)}
    for s in ("s1", "s2", "s1"):
        tables.write_snapshot(b.withColumn("tag", F.lit(s)), str(tmp_path / "snap"), s)
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 4


def test_units_and_embeddings(spark):
    d = spark.createDataFrame([("p", "one\n\ntwo"), ("q", None)], "path string, content string")
    assert [(r.content, r.start, r.end) for r in udfs.parse_documents(d).orderBy("start").collect()] == [("one", 0, 3), ("two", 5, 8)]
    e = udfs.embed(d, "content").collect()
    assert len(e[0].embedding) == 32 and sum(e[1].embedding) == 0
    j = udfs.first_json_object(spark.createDataFrame([('x {"a": "}"} y',), ("none",)], "t string"), "t", "j").collect()
    assert [r.j for r in j] == ['{"a": "}"}', None]


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_debounce_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(seconds=1)), ("a", t + dt.timedelta(seconds=60)), ("z", t + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "p string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("p string, at timestamp").parquet(str(tmp_path / "in"))
    got = {(r.p, r.n) for r in _run(streams.debounce(s, "p", "at", "5 seconds", "1 minute"), "debounced")}
    assert {("a", 2), ("a", 1)} <= got


def test_streak_stream(spark, tmp_path):
    rows = [(1, k, x) for k, x in enumerate(["fail", "pass", "fail", "fail", "ambiguous", "fail"])]
    spark.createDataFrame(rows, "c long, k long, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("c long, k long, status string").parquet(str(tmp_path / "in"))
    assert sorted((r.k, r.streak) for r in _run(streams.contract_streaks(s, "c", "k"), "streaks")) == [(3, 2), (5, 3)]


def test_velocity_sink(spark, tmp_path):
    w = spark.createDataFrame([(1, 1.0)], "symbol_id long, weight double")
    sink = streams.velocity_sink(str(tmp_path / "v"), w, 0.0, 0.5)
    for k, x in ((0, 1.0), (1, 0.0), (1, 0.0)):
        sink(spark.createDataFrame([(1, x, True, False)], "symbol_id long, delta_sem double, source_changed boolean, config_changed boolean"), k)
    got = spark.read.parquet(str(tmp_path / "v")).orderBy("batch").collect()
    assert [(r.batch, r.velocity) for r in got] == [(0, 1.0), (1, 0.5)]
