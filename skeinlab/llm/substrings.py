"""Removal of passages that start in an earlier document, by a de Bruijn graph of repeated word k-mers.

Every run of `width` words is an edge, from the node of its first width - 1 words to that of its last.
Edges are keyed by an anchor, the rarest-looking pair of neighbouring words in them, so that equal edges
share an anchor: first the anchors that occur in more than one document are found, and only edges on
those are compared. Edges on an anchor that very many documents hold go by their best other pair instead.

Edges that a later document repeats form the graph; each has the coordinates of its first occurrence, its
source. Nodes are joined with their degrees. Where one edge enters and one leaves, the path goes on: edges
in step in the source become one stretch, and stretches that such a node links across sources one path.
What a document repeats is joined, by source coordinates, to the paths, and those pieces are what goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F, Window as W

from skeinlab.llm.common import Scratch, free, hash_words, mix64, modest_batches, partitions, window_hashes
from skeinlab.llm.graph import components

WIDTH = 13
#: Anchors of at most so many rows are never moved.
HOT_ROWS = 1000
#: Repeats and stretches meet in blocks of so many places of a source.
BLOCK = 64


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and hashes of a text's words."""
    return hash_words(text.encode("utf-8", "surrogatepass") if text else b"")[1:]


def pair_keys(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A key for each pair of neighbouring words: the longer the pair, the smaller; else by hash."""
    size = np.minimum(sizes, 127)
    return window_hashes(hashes, 2) >> np.uint64(8) | (255 - size[:-1] - size[1:]).astype(np.uint64) << np.uint64(56)


def anchors(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each edge the place and the key of its anchor: the pair of smallest key in it, ties by the leftmost."""
    n = len(key) - width + 2
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.concatenate([sliding_window_view(key[k : k + 65536 + width - 2], width - 1).argmin(axis=1) + np.arange(k, k + min(65536, n - k)) for k in range(0, n, 65536)])
    return at, key[at]


def _list(offsets, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _emit_anchors(width):
    def f(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            hs, own = [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                sizes, hashes = hashed(text) if ids[k] is not None else ((), ())
                if len(sizes) < width:
                    continue
                _, key = anchors(pair_keys(sizes, hashes), width)
                hs.append(np.unique(key))
                own.append(np.full(len(hs[-1]), k))
            own = np.concatenate(own) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(hs) if hs else np.empty(0, np.uint64)).view(np.int64)), b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own))], names=["h", "id", "th"])

    return f


def _shared(batches):
    """From rows sorted by h: those whose h occurs with more than one id. Holds at most one id's rows back."""
    last, first, many, held = None, None, False, []
    for b in batches:
        h, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(h):
            continue
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        lo, hi = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
        multi = lo != hi
        if h[0] == last:
            multi[0] = multi[0] or many or lo[0] != first
            if multi[0]:
                yield from held
                held = []
        else:
            held = []
        sizes = np.diff(np.r_[starts, len(h)])
        last, first, many = h[-1], lo[-1], bool(multi[-1])
        if not many:
            tail = b.slice(int(starts[-1]))
            held = [*held, tail] if len(starts) == 1 and held else [tail]
        yield b.filter(pa.array(np.repeat(multi, sizes)))


def _emit_edges(width, hot):
    """Runs of edges on one anchor, as the nodes they pass; equal runs of a document are one row with all their places.

    Runs on a hot anchor go by the best pair that is not hot, if they hold one.
    """
    hot = np.sort(np.array(hot, np.int64).view(np.uint64))

    def f(batches):
        for b in batches:
            h_out, k_out, places, packs = [], [], [], []
            flagged = b.column(3)
            for k, text in enumerate(b.column(2).to_pylist()):
                wanted = flagged[k].as_py()
                sizes, hashes = hashed(text) if wanted else ((), ())
                if len(sizes) < width:
                    continue
                pairs = pair_keys(sizes, hashes)
                at, key = anchors(pairs, width)
                nodes = window_hashes(hashes, width - 1, seed=width)
                keep = np.isin(key, np.array(wanted, np.int64).view(np.uint64))
                moved = np.isin(key, hot)
                if moved.any():
                    other, _ = anchors(np.where(np.isin(pairs, hot), pairs | np.uint64(0xFF << 56), pairs), width)
                    at = np.where(moved, other, at)
                    key = pairs[at]
                cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (moved[1:] != moved[:-1])])
                ends = np.r_[cut[1:], len(at)]
                runs: dict[tuple[int, bytes], list[int]] = {}
                heads = cut[keep[cut]]
                for s, e, h in zip(heads.tolist(), ends[keep[cut]].tolist(), key[heads].tolist(), strict=True):
                    runs.setdefault((h, nodes[s : e + 1].tobytes()), []).append(s)
                for (h, pack), at_all in runs.items():
                    h_out.append(h)
                    k_out.append(k)
                    places.append(at_all)
                    packs.append(pack)
            own = pa.array(k_out, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h_out, np.uint64).view(np.int64)), b.column(0).take(own), b.column(1).take(own), pa.array([p[0] for p in places], pa.int32()), pa.array([np.array(p, "<u4").tobytes() for p in places], pa.binary()), pa.array(packs, pa.binary())], names=["h", "id", "th", "pos", "places", "nodes"])

    return f


def _source(i: int, th: int) -> int:
    """One number for the text of hash th in the document i."""
    x = ((i ^ th * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93) & (2**64 - 1)
    return x - 2**64 if x >> 63 else x


class _Anchor:
    """Where the edges of one anchor were first seen, and which of them have been told.

    Runs are taken in the order of (id, pos). While all runs are equal only the first is kept, and edges are
    told apart from the second kind of run on; no edge occurs twice in a run.
    """

    def __init__(self, i: int, th: int, pos: int, pack: bytes):
        self.first, self.whole = (i, th, pos, pack), False
        self.seen: dict[int, tuple[int, int, int]] | None = None
        self.told: set[int] = set()
        self.known: dict[bytes, list[tuple[int, int, int, int]]] = {}

    @staticmethod
    def _edges(pack: bytes) -> list[int]:
        nodes = np.frombuffer(pack, np.uint64)
        return mix64(nodes[:-1] * np.uint64(0x9FB21C651E98DF25) + nodes[1:]).tolist()

    def take(self, i: int, th: int, pos: int, pack: bytes, new: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int]]:
        """(offset, size, src, src_start) of what the run repeats of smaller ids; edges not told yet go to `new`."""
        if self.seen is None:
            j, jth, at, run = self.first
            if run == pack:
                if j >= i:
                    return []
                if not self.whole:
                    self.whole = True
                    new.append((_source(j, jth), at, pack))
                    self.known[pack] = [(0, len(pack) // 8 - 1, new[-1][0], at)]
                return self.known[pack]
            where = _source(j, jth)
            self.seen = {e: (j, at + k, where) for k, e in enumerate(self._edges(run))}
            if self.whole:
                self.told.update(self.seen)
        if pack in self.known:  # all of its edges are of smaller ids than an earlier run's
            return self.known[pack]
        out: list[tuple[int, int, int, int]] = []
        here, last, begun, all_old = _source(i, th), False, None, True
        for k, e in enumerate(self._edges(pack)):
            d, q, where = self.seen.setdefault(e, (i, pos + k, here))
            if d >= i:
                last, begun, all_old = False, None, False
                continue
            if last and out[-1][2] == where and out[-1][3] + out[-1][1] == q:
                out[-1] = (out[-1][0], out[-1][1] + 1, where, out[-1][3])
            else:
                last = True
                out.append((k, 1, where, q))
            if e in self.told:
                begun = None
                continue
            self.told.add(e)
            if begun is not None and new[-1][0] == where and new[-1][1] + k - begun == q:
                new[-1] = (where, new[-1][1], pack[8 * begun : 8 * k + 16])
            else:
                begun = k
                new.append((where, q, pack[8 * k : 8 * k + 16]))
        if all_old:
            self.known[pack] = out
        return out


def _repeats(batches):
    """From anchor runs sorted by (h, id, pos): what repeats an edge of a smaller id, and each such edge once.

    Rows with `starts` are stretches of a document that go on in step in the source; rows with `nodes` are
    stretches of a source whose edges no row has told yet. Keeps one anchor at a time.
    """
    last, anchor = None, None
    for b in batches:
        own, start, size, src, src_start, new = [], [], [], [], [], []
        cols = [b.column(k).to_pylist() for k in range(6)]
        for row, (h, i, th, pos, places, pack) in enumerate(zip(*cols, strict=True)):
            if h != last:
                last, anchor = h, _Anchor(i, th, pos, pack)
                continue
            for k, long, where, q in anchor.take(i, th, pos, pack, new):
                own.append(row)
                start.append(places if not k else (np.frombuffer(places, "<u4") + np.uint32(k)).tobytes())
                size.append(long)
                src.append(where)
                src_start.append(q)
        at, n = pa.array(own, pa.int64()), len(new)
        f_src, f_start, f_nodes = zip(*new, strict=True) if new else ((), (), ())
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary())]
        each = [pa.concat_arrays([x, y]) for x, y in zip((b.column(1).take(at), b.column(2).take(at), pa.array(start, pa.binary())), none, strict=True)]
        sizes = size + [len(p) // 8 - 1 for p in f_nodes]
        yield pa.RecordBatch.from_arrays([*each, pa.array(sizes, pa.int32()), pa.array([*src, *f_src], pa.int64()), pa.array([*src_start, *f_start], pa.int32()), pa.array([None] * len(own) + list(f_nodes), pa.binary())], names=["id", "th", "starts", "size", "src", "src_start", "nodes"])


def _passed(batches):
    """The nodes of each stretch: an edge enters from src, q - 1 (role 1), or leaves to src, q (role 2), or both (role 3)."""
    for b in batches:
        packs = [np.frombuffer(p, np.int64) for p in b.column(3).to_pylist()]
        if not packs:
            continue
        sizes = np.array([len(p) for p in packs])
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        role = np.full(ends[-1], 3, np.int8)
        role[ends - sizes], role[ends - 1] = 2, 1
        q = (place + np.repeat(b.column(1).to_numpy(), sizes)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(packs)), pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(q), pa.array(role)], names=["node", "src", "q", "role"])


def compact(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(src, start, size, path): stretches of sources without a branch, and the maximal nonbranching path they are on.

    `edges` has (src, src_start, size, nodes): stretches of distinct edges, as the 64-bit hashes of the size + 1
    nodes they pass. A path is named by the least hash of its stretches; a cycle is one path.
    """
    n = partitions(scratch.spark)
    nodes = edges.select("src", "src_start", "size", "nodes").mapInArrow(_passed, "node long, src long, q int, role byte").repartition(n, "node")
    enters, leaves = F.col("role") % 2 == 1, F.col("role") >= 2
    degrees = nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(enters).alias("n_in"),
        F.count_if(leaves).alias("n_out"),
        *[F.max(F.when(on, F.col(c))).alias(f"{side}_{c}") for side, on in (("in", enters), ("out", leaves)) for c in ("src", "q")],
    )
    one = (F.col("n_in") == 1) & (F.col("n_out") == 1)
    # The filter needs both sides, so that both read the one shuffle of the nodes.
    branching = degrees.filter((F.col("rows") > 1) & ~one).select("node", F.lit(1).alias("branching"))
    breaks = nodes.join(branching.hint("merge"), "node").filter(F.col("role") + F.col("branching") == 4).select("src", "q")
    links = degrees.filter((F.col("rows") == 2) & one).select(F.col("in_src").alias("a_src"), (F.col("in_q") - 1).alias("a_q"), F.col("out_src").alias("src"), F.col("out_q").alias("q"))
    links = scratch.cut(links.filter("a_src <> src OR a_q <> q"), "links")
    in_step = (F.col("a_src") == F.col("src")) & (F.col("a_q") + 1 == F.col("q"))
    # Starts of stretches, less those that a link joins to the edge before them.
    marks = edges.select("src", F.col("src_start").alias("q"), (F.col("src_start") + F.col("size")).alias("stop"), F.lit(0).alias("joined"))
    marks = marks.unionByName(breaks.select("src", "q", F.lit(None).cast("int").alias("stop"), F.lit(0).alias("joined")))
    marks = marks.unionByName(links.filter(in_step).select("src", "q", F.lit(None).cast("int").alias("stop"), F.lit(1).alias("joined")))
    marks = marks.repartition(n, "src").groupBy("src", "q").agg(F.max("stop").alias("stop"), F.max("joined").alias("joined"))
    along = W.partitionBy("src").orderBy("q")  # one document's marks
    pieces = marks.select("src", "q", F.least(F.last("stop", ignorenulls=True).over(along), F.lead("q").over(along)).alias("stop"), F.sum(1 - F.col("joined")).over(along).alias("k"))
    stretches = pieces.groupBy("src", "k").agg(F.min("q").alias("start"), F.sum(F.col("stop") - F.col("q")).cast("int").alias("size"))
    stretches = scratch.cut(stretches.select("src", "start", "size", F.xxhash64("src", "start").alias("own")), "stretches")
    across = links.filter(~in_step).select(F.col("a_src"), F.col("a_q"), F.xxhash64("src", "q").alias("b"))
    ends = stretches.select(F.col("src").alias("a_src"), (F.col("start") + F.col("size") - 1).alias("a_q"), F.col("own").alias("a"))
    named = components(across.join(ends, ["a_src", "a_q"]).select("a", "b"), scratch, "path")
    return stretches.join(named, F.col("own") == F.col("node"), "left").select("src", "start", "size", F.coalesce("component", "own").alias("path"))


def _on_paths(repeats: DataFrame, paths: DataFrame) -> DataFrame:
    """The pieces of repeats that lie on one path each; off is where a piece begins in its repeat.

    Both sides are cut into blocks of the source, in which there are at most BLOCK stretches; a source
    that very many documents repeat is a skewed key, which the join splits.
    """

    def blocks(start, size):
        return F.explode(F.sequence((F.col(start) / BLOCK).cast("int"), ((F.col(start) + F.col(size) - 1) / BLOCK).cast("int")))

    left = repeats.withColumn("block", blocks("src_start", "size"))
    right = paths.select("src", "start", F.col("size").alias("long"), "path").withColumn("block", blocks("start", "long"))
    first = F.greatest("src_start", "start", F.col("block") * BLOCK)
    stop = F.least(F.col("src_start") + F.col("size"), F.col("start") + F.col("long"), (F.col("block") + 1) * BLOCK)
    met = left.join(right.hint("merge"), ["src", "block"]).select("id", "th", "starts", (first - F.col("src_start")).alias("off"), (stop - first).alias("size"), "path")
    return met.filter("size > 0")


def _rewrite(width, with_text):
    def f(batches):
        for b in batches:
            n_words, n_removed, digests, texts, spans, longest = [], [], [], [], [], []
            for text, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = split_words(text)
                gone = np.zeros(len(words), bool)
                whole: list[list[int]] = []
                each = [(at + p["off"], p["size"], p["path"]) for p in paths or () for at in np.frombuffer(p["starts"], "<u4").tolist()]
                for start, size, path in sorted(each):
                    gone[start : start + size + width - 1] = True
                    w = whole[-1] if whole else None
                    if w and w[2] == path and w[0] + w[1] == start:
                        w[1] += size
                    else:
                        whole.append([start, size, path])
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if paths else b" ".join(words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "surrogatepass") if with_text else None)
                spans.append(len(whole))
                longest.append(max((w[1] + width - 1 for w in whole), default=0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(spans, pa.int64()), pa.array(longest, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "n_paths", "longest_path", "kept_text"])

    return f


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept_sha256, n_paths, longest_path, kept_text (null unless with_text).

    A word goes if any run of `width` words that covers it also starts in a document of smaller id;
    runs are judged on the input. Kept words are joined by one space. n_paths counts the unbroken spans that
    go, each on one nonbranching path, and longest_path is the longest of them in words.

    Null and empty texts have no words; texts shorter than `width` keep all; repeats inside one document
    (or between rows of one id) stay; rows without an id keep all their words; an empty table gives no rows.
    """
    modest_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_emit_anchors(width), "h long, id long, th long")
    scratch = Scratch(docs.sparkSession)
    shared = scratch.cut(found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_shared, "h long, id long, th long"), "shared")
    # Anchors of more rows than half of what falls to a task; there are less than two for each task.
    most = max(HOT_ROWS, shared.count() // (2 * n))
    hot = [r.h for r in shared.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("h").collect()]
    wanted = shared.groupBy("id", "th").agg(F.collect_set("h").alias("wanted"))  # at most one document's anchors
    edges = rows.join(wanted.hint("merge"), ["id", "th"], "left").select("id", "th", "text", "wanted").mapInArrow(_emit_edges(width, hot), "h long, id long, th long, pos int, places binary, nodes binary")
    edges = edges.repartition(n, "h").sortWithinPartitions("h", "id", "pos")
    found = scratch.cut(edges.mapInArrow(_repeats, "id long, th long, starts binary, size int, src long, src_start int, nodes binary"), "repeats")
    scratch.drop("shared")
    del shared, wanted, edges
    free(docs.sparkSession)
    paths = compact(scratch, found.filter("nodes IS NOT NULL").select("src", "src_start", "size", "nodes"))
    pieces = _on_paths(found.filter("starts IS NOT NULL").select("id", "th", "starts", "size", "src", "src_start"), paths)
    paths = pieces.groupBy("id", "th").agg(F.collect_set(F.struct("starts", "off", "size", "path")).alias("paths"))  # one document's
    out = rows.join(paths.hint("merge"), ["id", "th"], "left").select("id", "th", "text", "paths")
    out = out.mapInArrow(_rewrite(width, with_text), "id long, n_words long, n_removed long, kept_sha256 string, n_paths long, longest_path long, kept_text string")
    return out.withColumnRenamed("id", id_col)
