"""Steps over a graph as a matrix in blocks: a row for each block of nodes, not for each node or edge.

Nodes are numbered in the order of their ids. A vector is (b, v): the numbers of one block of nodes, packed. Edges are
(b, s, w, starts, t): the edges out of a block, packed and sorted by target; those of a block are cut again by ranges of
targets, so that no row grows with the graph. A step is a join on the block, sums (or least or largest values) by target
inside a task, and a fold of what the blocks send each other. Where edges stay among near ids, hardly anything is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from skeinlab.operators import ordered
from skeinlab.session import store

#: Nodes of a block, at least and at most, and blocks of targets that one row of edges goes to.
LEAST, SIZE, SPAN = 1024, 16384, 64
#: What a target has that nothing reaches, and how values meet.
KINDS = {"sum": (0.0, np.add), "min": (np.inf, np.minimum), "max": (-np.inf, np.maximum)}


def numbered(nodes: DataFrame, folder: str | None = None) -> tuple[DataFrame, int, int]:
    """Nodes (id, ...) with their number `n` from 0 in the order of ids, how many they are, and the size of a block."""
    out = store(ordered.with_sums(nodes, ["id"]).withColumnRenamed("_index", "n"), folder)
    count = out.count()
    size = LEAST
    while size < SIZE and size * 64 < count:
        size *= 2
    return out, count, size


def numbers(buffer: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(buffer.as_buffer(), dtype=kind)


def vector(rows: DataFrame, size: int, value: str = "value") -> DataFrame:
    """(b, v) of rows (n, value); nodes without a row have 0."""

    def fill(g: pa.Table) -> pa.Table:
        n = g["n"].to_numpy()
        v = np.zeros(size)
        v[n % size] = g["value"].to_numpy()
        return pa.table({"b": pa.array([int(n[0] // size)], pa.int64()), "v": pa.array([v.tobytes()], pa.binary())})

    return rows.select(F.floor(F.col("n") / size).alias("b"), "n", F.col(value).cast("double").alias("value")).groupBy("b").applyInArrow(fill, "b long, v binary")


def values(vectors: DataFrame, size: int, name: str = "v") -> DataFrame:
    """(n, value) of vectors (b, v), places behind the last node included."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, v in zip(batch["b"].to_pylist(), batch[name], strict=True):
                yield pa.RecordBatch.from_pydict({"n": pa.array(np.arange(b * size, (b + 1) * size)), "value": pa.array(numbers(v))})

    return vectors.select("b", name).mapInArrow(spell, "n long, value double")


def packed(edges: DataFrame, size: int, count: int) -> DataFrame:
    """Edges (s, t, w) of `count` nodes, each pair of numbers once, packed by blocks of sources and kept on disk, dealt out by block: to no more tasks than there are blocks."""
    tasks = min(max(1, -(-count // size)), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack(g: pa.Table) -> pa.Table:
        s, t, w = (g[c].to_numpy() for c in ("s", "t", "w"))
        at = np.lexsort((s, t))
        s, t, w = s[at], t[at], w[at]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        row = {"s": (s % size).astype(np.int32), "w": w, "starts": starts.astype(np.int64), "t": t[starts]}
        return pa.table({"b": pa.array([int(s[0] // size)], pa.int64()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in row.items()}})

    e = edges.select(F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"), F.col("w").cast("double").alias("w"))
    e = e.groupBy(F.floor(F.col("s") / size).alias("b"), F.floor(F.col("t") / (size * SPAN)).alias("span")).applyInArrow(pack, "b long, s binary, w binary, starts binary, t binary")
    return e.repartition(tasks, "b").persist(StorageLevel.DISK_ONLY)


def spread(vectors: DataFrame, edges: DataFrame, size: int, how: str, weighed: bool = False) -> DataFrame:
    """(b, v): what the values (b, v) of all sources come to at each target; blocks that nothing reaches have no row."""
    empty, meet = KINDS[how]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = numbers(batch["v"][k])[numbers(batch["s"][k], np.int32)]
                got = meet.reduceat(x * numbers(batch["w"][k]) if weighed else x, numbers(batch["starts"][k], np.int64))
                t = numbers(batch["t"][k], np.int64)[got != empty]
                got = got[got != empty]
                if len(t):
                    to = t // size
                    cuts = np.r_[0, np.flatnonzero(to[1:] != to[:-1]) + 1, len(t)]
                    parts = [(int(to[i]), (t[i:j] % size).astype(np.int32).tobytes(), got[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                    b, at, v = zip(*parts, strict=True)
                    yield pa.RecordBatch.from_pydict({"b": pa.array(b, pa.int64()), "at": pa.array(at, pa.binary()), "v": pa.array(v, pa.binary())})

    def fold(g: pa.Table) -> pa.Table:
        out = np.full(size, empty)
        for at, v in zip(g["at"], g["v"], strict=True):
            at = numbers(at, np.int32)
            out[at] = meet(out[at], numbers(v))
        return pa.table({"b": pa.array([g["b"][0].as_py()], pa.int64()), "v": pa.array([out.tobytes()], pa.binary())})

    sent = edges.join(vectors.select("b", "v").hint("shuffle_hash"), "b").mapInArrow(send, "b long, at binary, v binary")
    return sent.groupBy("b").applyInArrow(fold, "b long, v binary")


def mapped(rows: DataFrame, change: Callable[..., tuple], names: tuple[str, ...], counts: tuple[str, ...] = ()) -> DataFrame:
    """Rows (b, ...) of vectors `names` after change(b, **vectors), which gives those vectors and then the numbers `counts`; a missing vector is None."""
    given = [c for c in rows.columns if c != "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch["b"][k].as_py()
                got = change(b, **{c: numbers(batch[c][k]) if batch[c][k].is_valid else None for c in given})
                row = {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(names, got, strict=False)}
                yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int64()), **row, **{c: pa.array([int(x)], pa.int64()) for c, x in zip(counts, got[len(names):], strict=True)}})

    return rows.mapInArrow(run, ", ".join(["b long", *[f"{c} binary" for c in names], *[f"{c} long" for c in counts]]))
