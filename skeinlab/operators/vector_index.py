"""Partitioned vector index: centroids of a bounded sample, lists as folders, searches that read the nearest lists only.

The exact search stays in `search.vector_topk` and in `exact` here; `recall` measures the index against it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Vectors that centroids are fitted on, at most; the index holds every vector.
SAMPLE, LISTS, STEPS = 20_000, 64, 12
#: Recall of the first CALIBRATED_AT that the probed lists have to reach, on so many queries of the sample against all of it.
TARGET, CALIBRATED_AT, QUERIES = 0.95, 10, 400
#: Numbers in a block of vectors (half as many in one of queries), queries that are scored at once, scores of which one maximum is taken.
BLOCK, STRIP, GROUP = 4_000_000, 128, 64


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit_centroids(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, steps: int = STEPS, target: float = TARGET) -> tuple[np.ndarray, int]:
    """Unit centroids, and how many lists a search has to probe for the target recall, by spherical k-means on the `sample` vectors (id, embedding) whose ids hash lowest, so reruns agree.

    Vectors of another length than most, and zero ones, are left out; fewer vectors give fewer centroids.
    """
    few = vectors.filter("embedding IS NOT NULL AND size(embedding) > 0").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()  # a bounded sample
    sizes = [len(r.embedding) for r in few]
    if not sizes:
        return np.empty((0, 0)), 1
    size = max(set(sizes), key=lambda n: (sizes.count(n), -n))
    x = _unit(np.array([r.embedding for r in few if len(r.embedding) == size], np.float64))
    x = x[np.linalg.norm(x, axis=1) > 0]
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else np.empty((0, size))
    for _ in range(steps):
        at = (x @ c.T).argmax(axis=1) if len(c) else np.empty(0, int)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    if not len(c):
        return c, 1
    asked = x[:QUERIES]
    found = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :CALIBRATED_AT]
    order = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)  # place of each list for each query
    places = np.sort(np.take_along_axis(order, (x @ c.T).argmax(axis=1)[found], axis=1).ravel())
    return c, int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1


def _nearest_lists(df: DataFrame, centroids: np.ndarray, probes: int, column: str) -> DataFrame:
    """The rows with `column`: the numbers of the `probes` nearest centroids; -1 for vectors that none can be compared with."""
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])
    at = df.columns.index("embedding")
    size = centroids.shape[1]

    def place(batches):
        for b in batches:
            rows = b.column(at).to_pylist()
            fits = [v is not None and len(v) == size and size > 0 and None not in v for v in rows]
            out = [[-1]] * len(rows)
            if any(fits):
                x = np.array([v for v, ok in zip(rows, fits, strict=True) if ok], np.float64)
                best = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes].tolist()
                found = iter(zip(best, np.linalg.norm(x, axis=1).tolist(), strict=True))
                for k, ok in enumerate(fits):
                    if ok:
                        near, norm = next(found)
                        out[k] = near if norm > 0 else [-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(place, schema)


def build(vectors: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE) -> None:
    """Write the index of (id, embedding, ...): every row in the folder of its nearest centroid, and the centroids beside them.

    Rows whose vectors cannot be compared (null, of another length, zero) lie in the list -1, which no search reads.
    A list is written by as many tasks as hold its rows, so a heavy one is no single task.
    """
    centroids, probes = fit_centroids(vectors, lists, sample)
    placed = _nearest_lists(vectors, centroids, 1, "_lists").withColumn("list", F.col("_lists")[0]).drop("_lists")
    placed.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    rows = [(k, [float(x) for x in c], probes) for k, c in enumerate(centroids)]
    vectors.sparkSession.createDataFrame(rows, "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, int]:
    """Rows, centroids and the number of lists that a search probes by default."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most LISTS rows
    return spark.read.parquet(f"{path}/rows"), np.array([r.centroid for r in rows]) if rows else np.empty((0, 0)), rows[0].probes if rows else 1


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the k best of each query; queries' partial lists are cut in each task before they meet."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    s = pairs.filter("size(embedding) = size(_q)").withColumn("score", dot("embedding", "_q") / F.nullif(norm("embedding") * norm("_q"), F.lit(0.0))).filter("score IS NOT NULL")
    top = F.expr(f"slice(array_sort(collect_list(struct(-score AS far, id))), 1, {k})")
    part = s.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("query", "_part").agg(top.alias("best"))
    whole = part.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return whole.select("query", F.posexplode("best").alias("_p", "b")).select("query", "b.id", (-F.col("b.far")).alias("score"), (F.col("_p") + 1).alias("rank"))


def search(index: tuple[DataFrame, np.ndarray, int], queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query, id, score, rank): the k most similar rows of each query (query, embedding) among its `probes` nearest lists.

    Without `probes` as many are read as reached a recall of 0.95 on the sample. Queries are joined to the lists they probe; lists that no query probes are pruned. With as many probes as
    lists the result is exact. Ties go to the smaller id.
    """
    rows, centroids, enough = index
    asked = _nearest_lists(queries.select("query", "embedding"), centroids, probes or enough, "_lists").select("query", "embedding", F.explode("_lists").alias("list")).filter("list >= 0")
    width = max(1, centroids.shape[1])
    parts = lambda df, most: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) * width / most).cast("int").alias("n"))  # noqa: E731  one row for each list
    held = rows.filter("list >= 0").select("id", "embedding", "list")
    wide, tall = parts(held, BLOCK).withColumnRenamed("n", "_w"), parts(asked, BLOCK // 2).withColumnRenamed("n", "_t")
    sizes = F.broadcast(wide.join(tall, "list"))  # at most LISTS rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(sizes, "list").select("query", "embedding", "list", F.pmod(F.xxhash64("query"), F.col("_t")).cast("int").alias("_q"), every("_w").alias("_v"))
    v = held.join(sizes, "list").select("id", "embedding", "list", F.pmod(F.xxhash64("id"), F.col("_w")).cast("int").alias("_v"), every("_t").alias("_q"))
    return _met(q, v, ["list", "_q", "_v"], k)


def search_one(index: tuple[DataFrame, np.ndarray, int], query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """search for one vector: its lists are named in the filter, so the scan opens their folders alone."""
    rows, centroids, enough = index
    q = np.array(query, np.float64)
    if not len(centroids) or len(q) != centroids.shape[1] or not np.linalg.norm(q):
        return rows.select(F.lit(0).alias("query"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    near = [int(x) for x in np.argsort(-(centroids @ q), kind="stable")[: probes or enough]]
    return _scored(rows.filter(F.col("list").isin(near)).select("id", "embedding", F.lit(0).alias("query"), F.array(*[F.lit(float(x)) for x in query]).alias("_q")), k)


def usable_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of a column's usable vectors (no null inside, finite, not zero), and these as rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([n or 0 for n in pc.list_value_length(column).to_pylist()], np.int64)
    out = {}
    for n in sorted(set(sizes[sizes > 0].tolist())):
        at = np.flatnonzero(sizes == n)
        x = np.array(pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False), np.float64).reshape(len(at), n)  # nulls are NaN
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        good = np.isfinite(length) & (length > 0)
        if good.any():
            out[n] = at[good], x[good] / length[good, None]
    return out


def _best(queries: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score), flat: the k rows of x of the highest score (rounded to 12 digits) for each query; ties go to the smaller id.

    x is in the order of ids. All rows that reach the k-th score are looked at, so ties are not cut.
    """
    s = queries @ x.T
    wide = s.shape[1] // GROUP
    if wide > k:  # the k-th best of the groups' maxima bounds the k-th score from below
        tops = s[:, : wide * GROUP].reshape(len(s), GROUP, wide).max(axis=1)
        edge = np.partition(tops, wide - k, axis=1)[:, wide - k]
        q, j = np.nonzero(s >= edge[:, None] - 1e-11)
    else:
        q, j = (m.ravel() for m in np.indices(s.shape))
    v = np.round(s[q, j], 12)
    order = np.lexsort((j, -v, q))
    q, j, v = q[order], j[order], v[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], ids[j[keep]], v[keep]


def _met(queries: DataFrame, vectors: DataFrame, key: list[str], k: int) -> DataFrame:
    """(query, id, score, rank): the k best of the vectors (*key, id, embedding) that share their key with a query (*key, query, embedding).

    A key is a bounded block of each side; both meet as matrices. No pair is emitted that is not among a block's best.
    """
    schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = _arrow(schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            asked, held = usable_vectors(left.column("embedding")), usable_vectors(right.column("embedding"))
            for n in asked.keys() & held.keys():
                (at, q), (to, x) = asked[n], held[n]
                for first in range(0, len(q), STRIP):
                    i, j, score = _best(q[first : first + STRIP], x, to, k)
                    parts.append(pa.table([left.column("query").take(pa.array(at[first + i])), right.column("id").take(pa.array(j)), pa.array(score)], names=schema.names).cast(arrow))
        return pa.concat_tables(parts) if parts else arrow.empty_table()

    near = queries.groupBy(*key).cogroup(vectors.groupBy(*key)).applyInArrow(meet, schema)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))), 1, k)
    top = near.groupBy("query").agg(best.alias("best"))
    return top.select("query", F.posexplode("best").alias("_p", "b")).select("query", "b.id", (-F.col("b.far")).alias("score"), (F.col("_p") + 1).alias("rank"))


def exact(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The brute-force answer to `search`: each block of vectors meets each block of queries, and keeps k for each query.

    Blocks hold about `block` numbers. The work is queries times vectors, which the exact answer takes; what goes
    over the network is each side as often as the other has blocks.
    """
    numbers = lambda df: int(df.agg(F.sum(F.greatest(F.size("embedding"), F.lit(0)).cast("long"))).first()[0] or 0)
    wide, tall = max(1, -(-numbers(vectors) // block)), max(1, -(-numbers(queries) // (block // 2 or 1)))
    q = queries.select("query", "embedding", F.pmod(F.xxhash64("query"), F.lit(tall)).cast("int").alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("_v"))
    v = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(wide)).cast("int").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(tall - 1))).alias("_q"))
    return _met(q, v, ["_q", "_v"], k)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(queries, wanted, hits, recall) of search results against exact ones."""
    j = truth.select("query", "id").join(found.select("query", "id", F.lit(1).alias("_hit")), ["query", "id"], "left")
    return j.agg(F.countDistinct("query").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("hits"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
