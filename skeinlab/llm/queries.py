"""Registered queries of the training-data operators, and the oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlab.llm import band_join, decontaminate, fill_middle, language_model, licenses, mixing, neardup, pii, quality, secrets, sharding, substrings, toxicity
from skeinlab.llm.common import partitions, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_pigeonhole_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage, with the item and the best match."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of each, range-sorted by first training position."""
    plan = mixing.curriculum_plan(table(spark, sf_dir, "documents"))
    out = plan.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("first_position"), F.element_at(F.array_insert("positions", 1, F.lit(None).cast("double")), -1).alias("last_position"))
    return out.repartitionByRange(partitions(spark), F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


@query
def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document and the licence whose entire text it is, if any."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_license_digests"] = licenses.oracle_sql()


@query
def op4_de_bruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay when passages of 13 words or more from earlier documents go."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), width=13, with_text=False).drop("kept_text")


@query
def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality.quality_outliers(docs, carry=("doc_id",))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query
def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def fold_of(n: int = 5):
    """crc32 of the id as text, modulo n; a null id has the empty text's."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


@query
def op7_fuzzy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learned from four fifths of them."""
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of() != 0)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted")


@query
def op8_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 contiguous shards of near-equal bytes."""
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 in SQL: the 256-entry table follows from the reflected polynomial, then one fold over the bytes.
ORACLE_SQL["op8_shard_bytes"] = """
WITH tab AS (SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])),
                lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY n) AS tb FROM range(256) r(n)),
s AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                list_transform(range(length(x) // 2), lambda i: CAST(('0x' || x[2*i+1:2*i+2]) AS BIGINT))),
                lambda a, b: xor(a >> 8, tb[1 + (xor(a, b) & 255)]))) AS text_crc32 FROM s, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
q AS (SELECT *, CAST(least(7, ((2 * before + size) * 8) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q
"""


@query
def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document; the model learns from four fifths of them."""
    out = language_model.score_documents(table(spark, sf_dir, "documents"), fold_of() == 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_odd_sketch_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on 4-word shingles at similarity 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op11_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest lines of other items within the price band of each item, and sums over all of its pairs."""
    return band_join.nearest_lines(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"))


ORACLE_SQL["op11_band_join"] = band_join.ORACLE_SQL


@query
def op12_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and put together to fill its middle."""
    return fill_middle.fill_middle(table(spark, sf_dir, "documents"), with_text=False)


ORACLE_SQL["op13_fill_middle"] = fill_middle.ORACLE_SQL
