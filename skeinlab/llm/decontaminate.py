"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may occur with up to e word edits. Cut into e + 1 pieces, at least one piece must
then occur unchanged: exact piece hits are found first, and the window around each is verified with
Myers' bit-parallel edit distance, the words being the symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinlab.llm.common import modest_batches, window_hashes

ERROR_RATE = 0.2
#: Items are matched in blocks of about this many words, so what a task holds is bounded; each block scans the documents once.
BLOCK_WORDS = 2_000_000

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def budget(m: int, rate: float = ERROR_RATE) -> int:
    return int(m * rate)


def pieces(m: int, e: int) -> list[tuple[int, int]]:
    """Offsets of e + 1 near-equal pieces of m words."""
    cuts = [m * k // (e + 1) for k in range(e + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def myers(pattern_masks: dict[int, int], m: int, text: Iterable[int]) -> tuple[int, int]:
    """Least edit distance of a pattern to any substring of `text`, and where the first such substring ends.

    Column differences of the dynamic programme are kept as bits of two integers.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, symbol in enumerate(text, 1):
        eq = pattern_masks.get(symbol, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diag | up) & full, up & diag
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1  # the first row is all zeros: a match may start anywhere
        up, down = (minus | ~(diag | plus)) & full, plus & diag & full
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        self.index: dict[int, dict[tuple[int, ...], list[tuple[int, int, tuple[int, ...]]]]] = {}  # by words compared first
        found = []
        for item_id, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            if not ids:
                continue
            m, e = len(ids), budget(len(ids), rate)
            masks: dict[int, int] = {}
            for k, s in enumerate(ids):
                masks[s] = masks.get(s, 0) | 1 << k
            found += [(len(self.items), a, ids[a:b]) for a, b in pieces(m, e)]
            self.items.append((item_id, m, e, masks))
        for x, a, p in found:
            self.index.setdefault(min(4, len(p)), {}).setdefault(p[:4], []).append((x, a, p))
        self.bits = {}  # a screen over the first words of all pieces
        for gram, index in self.index.items():
            h = np.array([window_hashes(k, gram)[0] for k in np.array(list(index), np.uint64)])
            self.bits[gram] = np.zeros(1 << 22, bool)
            self.bits[gram][h & np.uint64((1 << 22) - 1)] = True

    def find(self, text: str | None) -> dict[int, tuple[int, int, int, int]]:
        """item_id -> (distance, start_word, end_word, matches) of the best match; ties take the first."""
        words = words_of(text)
        out: dict[int, tuple[int, int, int, int]] = {}
        if not words or not self.items:
            return out
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        numbers = np.array(ids, np.uint64)
        hits = []
        for gram, bits in self.bits.items():
            h = window_hashes(numbers, gram)
            hits += [(at, gram) for at in np.flatnonzero(bits[h & np.uint64((1 << 22) - 1)]).tolist()]
        done: dict[int, int] = {}  # windows before this word are verified, by item
        for at, gram in sorted(hits):
            for x, a, p in self.index[gram].get(tuple(ids[at : at + gram]), ()):
                if tuple(ids[at : at + len(p)]) != p:
                    continue
                item_id, m, e, masks = self.items[x]
                start = at - a
                if start < done.get(x, -1):
                    continue
                lo = max(0, start - e)
                window = ids[lo : start + m + e]
                distance, end = myers(masks, m, window)
                if distance <= e:
                    done[x] = lo + end
                    found = (distance, max(0, lo + end - m), lo + end)
                    best = out.get(item_id)
                    out[item_id] = (*min(found, best[:3]), best[3] + 1) if best else (*found, 1)
        return out


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and test item it holds: id, item_id, distance, start_word, end_word, n_matches.

    Every whole text is searched for every item, items in blocks of bounded size. Items and texts without
    words (null, empty, punctuation) match nothing; items without an id are left out; texts of one item id
    are reported as one; repeated documents each get their rows; an empty table gives no rows. Distances are in words after lower-casing and
    dropping ASCII punctuation; start and end are the best match's span, to within the edits.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    sized = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 6 / block_words))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id long, distance int, start_word int, end_word int, n_matches int"
    out = None
    for k in range(blocks):
        mine = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else sized
        block = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in mine.toLocalIterator() if r.item_id is not None))

        def search(batches, block=block):
            matcher = Matcher(block.value, rate)
            for b in batches:
                rows = [(i, item, *found) for i, text in enumerate(b.column(1).to_pylist()) for item, found in sorted(matcher.find(text).items())]
                at = pa.array([r[0] for r in rows], pa.int64())
                cols = [b.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.int32()) for k in range(2, 6)]]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "item_id", "distance", "start_word", "end_word", "n_matches"])

        found = docs.select(id_col, text_col).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out
