"""Shared pieces: table access, scratch tables, bounded broadcasts, global prefix sums, word hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window as W

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of a frame that is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send whole texts and sets to Python by at most `rows` rows, unless the session asks for some other number than the default.

    Batches are held outside the heap, twice while they grow; 10,000 long texts for each task are too much.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def scratch_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one is set only where none is named and all runs in one process (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skeinlab-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_left: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner sweeps it
            return


class Scratch:
    """Tables written to the shared checkpoint folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{scratch_root(self.spark)}/skeinlab-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        _left.append((self.spark, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no remaining frame reads."""
        for name in names:
            _delete(self.spark, self.paths.pop(name))


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone, which it does when both sides collect garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Row numbers from here on are hashes, of rows that no id of their own tells apart.
HASHED_IDS = 1 << 62


def with_row_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(row, uid, text) for each row, all of its columns in the struct `row`, and whether ids are null or repeated.

    uid is the id, as a long, where it is a number of this row alone. Rows without such an id are numbered from HASHED_IDS
    on by a hash of the whole row, so that equal rows share a number and others do not.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row")[id_col].try_cast("long")
    ids = rows.select(own.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL OR id >= " + str(HASHED_IDS))
    odd = Scratch(docs.sparkSession).cut(ids.select("id"), "odd-ids")
    n = odd.limit(BROADCAST_ROWS + 1).count()
    hashed = F.lit(HASHED_IDS) + F.pmod(F.xxhash64("row"), F.lit(HASHED_IDS))
    uid = own
    if n:
        rows = rows.join(bounded_broadcast(odd.filter("id IS NOT NULL"), n), own == F.col("id"), "left")
        uid = F.when(own.isNull() | F.col("id").isNotNull(), hashed).otherwise(own)
    return rows.select("row", uid.alias("uid"), F.col("row")[text_col].alias("text")), bool(n)


def bounded_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast only when the row count (counted here unless given) is within BROADCAST_ROWS."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def with_prefix(scratch: Scratch, df: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """Rows in global order with _before (sizes of all earlier rows), _index (their number) and _total.

    The frame is dealt out by ranges of `order`; each partition sums its own rows in order, and the
    per-partition totals (one row for each partition) give the offsets. Nothing else leaves the executors.
    """
    spark = scratch.spark
    modest_batches(spark)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_lb", T.LongType()), T.StructField("_li", T.LongType())])
    at = df.columns.index(size)

    def sums(batches):
        before = index = 0
        for b in batches:
            sizes = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + before
            arrays = [*b.columns, pa.array(ends - sizes), pa.array(np.arange(index, index + len(sizes)))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, "_lb", "_li"])
            before, index = (int(ends[-1]) if len(sizes) else before), index + len(sizes)

    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.cut(ranged.mapInArrow(sums, schema), name)
    ends = ranged.groupBy("_part").agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("c"))
    every = W.orderBy("_part")
    offsets = ends.select(
        "_part",
        (F.sum("s").over(every) - F.col("s")).alias("_os"),
        (F.sum("c").over(every) - F.col("c")).alias("_oc"),
        F.sum("s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_total"),
    )  # one row for each partition
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn("_before", F.col("_lb") + F.col("_os"))
        .withColumn("_index", F.col("_li") + F.col("_oc"))
        .drop("_part", "_lb", "_li", "_os", "_oc")
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each run of `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(seed) + np.uint64(0x9E3779B97F4A7C15), np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix64(out)


_SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASE = 0x9E3779B97F4A7C15
#: A random number for each byte; fixed by its seed.
_BYTES = np.random.default_rng(20240311).integers(0, 2**64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def hash_words(text: bytes, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a text begins, its bytes and its 64-bit hash: a polynomial in its bytes' random numbers, mixed.

    Sums over all bytes before each place give the words' polynomials by difference; the text goes by in
    pieces that end in a space, so that the sums stay small enough for the cache.
    """
    whole = np.frombuffer(b" " + text + b" ", np.uint8)
    starts, sizes, hashes, at = [], [], [], 0
    while at < len(whole) - 1:
        end = min(at + piece, len(whole) - 1)
        if end < len(whole) - 1:
            rest = _SPACES[whole[end : end + piece]]
            while not rest.any():
                end += len(rest)
                rest = _SPACES[whole[end : end + piece]]
            end += int(rest.argmax())
        x = whole[at : end + 1]
        inside = ~_SPACES[x]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, last = edges[0::2], edges[1::2]
        if len(_powers[0]) < len(x):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                steps = np.full(2 * len(x), np.uint64(base))
                steps[0] = 1
                _powers[k] = np.cumprod(steps)
        sums = np.cumsum(_BYTES[x] * _powers[0][: len(x)])
        starts.append(first + at)
        sizes.append(last - first)
        hashes.append(mix64((sums[last - 1] - sums[first - 1]) * _powers[1][first]))
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts) - 1, np.concatenate(sizes), np.concatenate(hashes)
