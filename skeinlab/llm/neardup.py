"""Near-duplicate documents: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from skeinlab.llm.common import Scratch, hash_words, mix64, modest_batches, partitions, window_hashes, with_row_ids
from skeinlab.llm.graph import components

WIDTH, PERCENT = 5, 80
#: Bands of rows: a pair at the threshold 0.8 is missed by all with chance (1 - 0.8**4)**32 < 1e-7.
BANDS, ROWS = 32, 4
#: Bits of an odd sketch, in 64-bit words.
SKETCH_WORDS = 8
#: The screen lets through pairs estimated above the threshold less this margin (seven standard errors or so).
MARGIN = 0.25
#: Members of a block: buckets are compared block against block.
BLOCK = 1000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; a shorter text is one shingle; no words, none."""
    words = hash_words(text.encode("utf-8", "surrogatepass").lower())[2] if text else ()
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words)), seed=min(width, len(words))))


class _Sketcher:
    def __init__(self, bands: int, rows: int, words: int):
        rng = np.random.default_rng(20240917)
        k = bands * rows
        self.mul = (rng.integers(1, 2**32, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
        self.add = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)
        self.bands, self.rows, self.words = bands, rows, words
        self.slot = (np.arange(k, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """MinHash values: multiply-add on 32 mixed bits of each shingle, in blocks to bound memory."""
        x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        out = np.full(len(self.mul), np.uint32(0xFFFFFFFF), np.uint32)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            h = self.mul[:, None] * part[None, :]
            h += self.add[:, None]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            np.minimum(out, h.min(axis=1), out=out)
        return out

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes and the odd sketch: each (slot, minimum) toggles one bit."""
        low = self.minima(shingles)
        window = mix64(self.slot ^ low.astype(np.uint64))
        bands = window.reshape(self.bands, self.rows)
        folded = bands[:, 0].copy()
        for k in range(1, self.rows):
            folded = mix64(folded * np.uint64(31) + bands[:, k])
        bits = np.bincount((window % np.uint64(64 * self.words)).astype(np.int64), minlength=64 * self.words) & 1
        sketch = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)
        return folded.view(np.int64), sketch.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS, words: int = SKETCH_WORDS) -> DataFrame:
    """(id, n, sig, bands, sketch) from (id, text): sig tells equal shingle sets, n is the set size."""

    def sketch(batches):
        sketcher = _Sketcher(bands, rows, words)
        for b in batches:
            ns, sigs, bs, sk = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width)
                ns.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                folded, bits = sketcher.of(s) if len(s) else (None, None)
                bs.append(folded)
                sk.append(bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bs, pa.list_(pa.int64())), pa.array(sk, pa.list_(pa.int64()))], names=["id", "n", "sig", "bands", "sketch"])

    return docs.mapInArrow(sketch, "id long, n long, sig binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def sets(batches):
        for b in batches:
            out = [shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(sets, "id long, shingles array<long>")


def screen(a: Column, b: Column, percent: int, samples: int, words: int = SKETCH_WORDS, margin: float = MARGIN) -> Column:
    """Whether two odd sketches may come from sets of similarity percent / 100: their XOR has few enough bits.

    With k samples in n bits the count of differing bits has mean n / 2 (1 - exp(-4 k (1 - J) / n)).
    """
    n = 64 * words
    most = n / 2 * (1 - math.exp(-4 * samples * (1 - (percent / 100 - margin)) / n))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) <= int(most)


def _confirm(pairs: DataFrame, texts: DataFrame, sigs: DataFrame, width: int, percent: int, samples: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    thin = sigs.select("id", "n", "sketch")
    p = pairs.join(thin.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    p = p.join(thin.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    p = p.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & screen(F.col("sa"), F.col("sb"), percent, samples))
    p = scratch.cut(p.select("a", "b", "na", "nb"), f"{name}-screened")
    ids = p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
    sets = scratch.cut(_sets(texts.join(ids, "id", "left_semi").select("id", "text"), width), f"{name}-sets")
    q = p.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    q = q.withColumn("both", F.size(F.array_intersect("xa", "xb")))
    out = scratch.cut(q.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b"), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-screened")
    return out


def _tiles(rest: DataFrame, *bucket: str) -> DataFrame:
    """Members of buckets dealt to tiles (i, j), i <= j: pairs of blocks of about BLOCK members each.

    Members of a bucket's largest component need not meet each other: their blocks, numbered after all
    others, meet those of the other members only. So a bucket's rows grow with its size, and not with the
    square of it, as long as almost all of it is one component.
    """
    n = F.count(F.lit(1))
    sizes = rest.groupBy(*bucket, "component").agg(n.alias("_n"))
    sizes = sizes.groupBy(*bucket).agg(F.max_by("component", F.struct("_n", -F.col("component"))).alias("_most"), F.max("_n").alias("_m"), F.sum("_n").alias("_all"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    out = rest.join(sizes, list(bucket)).withColumn("_few", blocks(F.col("_all") - F.col("_m"))).withColumn("_many", blocks(F.col("_m")))
    major = F.col("component") == F.col("_most")
    own = F.when(major, F.col("_few") + F.pmod(F.xxhash64("id"), F.col("_many"))).otherwise(F.pmod(F.xxhash64("id"), F.col("_few"))).cast("int")
    last = F.when(major, F.col("_few")).otherwise(F.col("_few") + F.col("_many")) - 1
    out = out.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), last)))
    return out.withColumn("i", F.least("_b", "_o")).withColumn("j", F.greatest("_b", "_o"))


def _runs(batches, keys: int):
    """Tables of the rows of one key each, from batches sorted by their first `keys` columns."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        k = np.column_stack([t.column(c).to_numpy() for c in range(keys)])
        cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield t.slice(s, e - s)
        held = t.slice(cuts[-1])
    if held is not None:
        yield held


def _able(percent: int, samples: int):
    """Members of a tile whose size and sketch allow a link to a member of another component."""
    n_bits = 64 * SKETCH_WORDS
    most = n_bits / 2 * (1 - math.exp(-4 * samples * (1 - (percent / 100 - MARGIN)) / n_bits))

    def f(batches):
        for t in _runs(batches, 4):
            component, n = t.column("component").to_numpy(), t.column("n").to_numpy()
            sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
            keep = np.zeros(len(n), bool)
            for k in range(len(n)):
                ok = (component != component[k]) & (np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * percent)
                if ok.any():
                    keep[k] = (np.bitwise_count(sketch[ok] ^ sketch[k]).sum(axis=1) <= most).any()
            if keep.any():
                yield from t.select(["band", "h", "i", "j", "id", "component"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return f


def _linked(percent: int):
    """Links between components of a tile, on full sets: enough of them to join whatever they join."""

    def f(batches):
        for t in _runs(batches, 4):
            ids, component = t.column("id").to_pylist(), t.column("component").to_pylist()
            lists = t.column("shingles").combine_chunks()
            n = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(ids)), n)
            _, code, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            shared = times[code] > 1  # shingles of one member alone are in no intersection
            kept, code = np.unique(code[shared], return_inverse=True)
            owner = owner[shared]
            both = np.zeros((len(ids), len(ids)), np.float32)
            order = np.argsort(code, kind="stable")
            owner, code = owner[order], code[order]
            for at in range(0, len(kept), 1024):
                lo, hi = np.searchsorted(code, [at, at + 1024])
                m = np.zeros((len(ids), 1024), np.float32)
                m[owner[lo:hi], code[lo:hi] - at] = 1.0
                both += m @ m.T
            x, y = np.nonzero(np.triu(both * 100 >= (n[:, None] + n[None, :] - both) * percent, 1))
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            out = []
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                ca, cb = find(component[a]), find(component[b])
                if ca != cb:
                    root[max(ca, cb)] = min(ca, cb)
                    out.append((ids[a], ids[b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return f


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: components of links of Jaccard similarity >= percent / 100.

    component_id is the smallest id of the component, null if none of it has one; kept tells whether the
    row's id is that one. Rows without an id, and rows that share one, are compared like any others, each
    on its own text; an empty table gives no rows. For the rest see `row_components`.
    """
    keyed, odd = with_row_ids(docs, id_col, text_col)
    found = row_components(keyed.select("uid", "text"), width, percent, bands, rows)
    if not odd:
        return found.select(F.col("uid").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("uid") == F.col("component")).alias("kept"))
    named = keyed.select("uid", F.col("row")[id_col].alias("id")).join(found, "uid")
    named = Scratch(docs.sparkSession).cut(named, "named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return named.join(least, "component").select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def row_components(rows_of: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uid, n_shingles, component) for each distinct uid of (uid, text); the component is its smallest uid.

    Documents with one shingle set collapse to their smallest id first. In each band bucket all members
    are compared with the smallest only; then, where a bucket still holds different components, its members
    are compared block against block inside tasks of bounded size, which emit no pairs but the links that
    join components. Links inside a component that is already known change nothing and are not sought.

    Null and empty texts have no shingles and stand alone. Rows of one uid are taken to have one text.
    """
    spark = rows_of.sparkSession
    scratch = Scratch(spark)
    modest_batches(spark)
    texts = rows_of.select(F.col("uid").alias("id"), "text")
    sigs = scratch.cut(signatures(texts, width, bands, rows), "signatures")
    copies = scratch.cut(sigs.filter("n > 0").groupBy("sig", "n").agg(F.min("id").alias("rep")), "copies")
    reps = scratch.cut(sigs.filter("n > 0").join(copies.select("rep", F.col("sig").alias("s")), (F.col("id") == F.col("rep")) & (F.col("sig") == F.col("s")), "left_semi").dropDuplicates(["id"]), "reps")
    member = reps.select("id", F.posexplode("bands").alias("band", "h"))
    buckets = member.groupBy("band", "h").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
    joint = scratch.cut(member.join(buckets, ["band", "h"]).select("band", "h", "id", "lead"), "buckets")
    pairs = joint.filter("id <> lead").groupBy("lead", "id").agg(F.first("band").alias("_")).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    alike = texts.join(reps.select("id"), "id", "left_semi")
    links = _confirm(pairs, alike, reps, width, percent, bands * rows, scratch, "leaders")
    known = scratch.cut(components(links, scratch, "cc-leaders"), "known")
    # Buckets that still hold members of different components.
    label = joint.join(known, joint["id"] == known["node"], "left").select("band", "h", "id", "lead", F.coalesce("component", "id").alias("component"))
    mixed = label.groupBy("band", "h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("many")).filter("lo <> hi AND many > 2").select("band", "h")
    rest = label.join(mixed, ["band", "h"]).join(reps.select("id", "n", "sketch"), "id")
    rest = scratch.cut(_tiles(rest, "band", "h").select("band", "h", "i", "j", "id", "component", "n", "sketch"), "rest")
    tile = ["band", "h", "i", "j"]
    parts = partitions(spark)
    able = rest.repartition(parts, *tile).sortWithinPartitions(*tile).mapInArrow(_able(percent, bands * rows), "band int, h long, i int, j int, id long, component long")
    able = scratch.cut(able, "able")
    sets = scratch.cut(_sets(alike.join(able.select("id").distinct(), "id", "left_semi").select("id", "text"), width), "able-sets")
    full = able.join(sets, "id").select(*tile, "id", "component", "shingles")
    more = full.repartition(parts, *tile).sortWithinPartitions(*tile).mapInArrow(_linked(percent), "a long, b long").distinct()
    links = links.unionByName(scratch.cut(more, "rest-links"))
    # Copies hang on their representative and need no rounds of their own.
    found = scratch.cut(components(links, scratch, "cc-all"), "found")
    rep_of = sigs.filter("n > 0").join(copies, ["sig", "n"]).select("id", "rep", "n").join(found, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    none = sigs.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    out = rep_of.unionByName(none).groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component_id"))
    return out.select(F.col("id").alias("uid"), "n_shingles", F.col("component_id").alias("component"))
