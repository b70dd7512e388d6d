"""The pipeline on a small corpus."""

import random

import pyarrow.parquet as pq
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [a + b for a in "bcdfghklmn" for b in ("a", "e", "i", "o", "u", "an", "en", "in", "on", "un")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(30)
    rows = [(k, text(100), "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(60, rows[0][1], "en", "s0", 0), (61, rows[1][1] + " tail", "en", "s1", 0), (62, f"{text(60)} {item} {text(20)}", "en", "s0", 0), (63, "short", "en", "s0", 0), (64, None, None, None, None), (65, "la la la " * 60, "en", "s2", 0)]
    rows += [(None, text(100), None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"stage{k}")
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        left[name] = [r.doc_id for r in docs.collect()]
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(60)) | {None}
    assert set(left["quality_rules"]) == clean | {60, 61, 62}
    assert set(left["near_dedup"]) == clean | {62}
    assert set(left["decontamination"]) == clean
    assert set(left["mixing_weights"]) <= clean and len(left["mixing_weights"]) > 40
    assert sorted(left["byte_shards"], key=str) == sorted(left["mixing_weights"], key=str)
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in run) == sorted(map(str, left["byte_shards"]))
    assert {r.shard for r in run} == set(range(8))


def test_shards_follow_the_order_of_the_mixed_rows(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(5, 60)))
    rows = [(k, text(), "en", f"s{k % 3}", 0) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = str(tmp_path / "mixed")
    corpus_pipeline.mixing_weights(spark, docs, str(tmp_path)).write.parquet(out)
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    written = [k for f in files for k in pq.read_table(f).column("doc_id").to_pylist()]
    got = corpus_pipeline.byte_shards(spark, spark.read.parquet(out), str(tmp_path)).orderBy("shard", "slot").collect()
    assert len(files) > 1 and written != sorted(written)
    assert [r.doc_id for r in got] == written
