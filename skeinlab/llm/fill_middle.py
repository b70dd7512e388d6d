"""Fill-in-middle transformation: a byte DFA counts units and finds sentinels, a second pass locates the cuts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skeinlab.llm.common import modest_batches

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100: from here on texts stay plain; below this the suffix goes first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: Bytes of a lane, and lanes that step through the table together.
LANE, LANES = 512, 8192
_PAD, _UNIT, _HIT = 256, 1, 1 << 16


class Scanner:
    """Transition table over bytes: states are the prefixes of sentinels and the continuation bytes that a code point still needs.

    A transition counts a unit where a code point begins, and a hit where a sentinel ends. The state
    depends on the last `warm` bytes only, so a text is cut into lanes that start `warm` bytes early.
    """

    def __init__(self, sentinels: tuple[str, ...]):
        words = [s.encode("ascii") for s in sentinels]
        if not all(words):
            raise ValueError("a sentinel is empty")
        names = sorted({w[:k] for w in words for k in range(len(w))}, key=lambda x: (len(x), x))
        at = {name: k for k, name in enumerate(names)}
        self.warm = max(3, max(map(len, words)) - 1)
        needs = {k: len(names) + k - 1 for k in (1, 2, 3)}
        n = len(names) + 3
        to, flag = np.zeros((n, _PAD + 1), np.int64), np.zeros((n, _PAD + 1), np.int64)

        def suffix(x: bytes) -> int:
            return next(at[x[k:]] for k in range(len(x) + 1) if x[k:] in at)

        for state in range(n):
            for byte in range(256):
                need = state - len(names) + 1  # continuation bytes wanted, if over 0
                if 0x80 <= byte < 0xC0:
                    to[state, byte] = needs[need - 1] if need > 1 else 0
                    flag[state, byte] = 0 if need > 0 else _UNIT
                elif byte >= 0xC0:
                    to[state, byte] = needs[1 if byte < 0xE0 else 2 if byte < 0xF0 else 3]
                    flag[state, byte] = _UNIT
                else:
                    read = (names[state] if need <= 0 else b"") + bytes([byte])
                    to[state, byte] = suffix(read)
                    flag[state, byte] = _UNIT + _HIT * any(read.endswith(w) for w in words)
        self.next, self.flag = (to * (_PAD + 1)).ravel(), flag.ravel()

    def _columns(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes of the lanes by step, `warm` of them before each lane; steps behind the end of a lane are pads."""
        steps = np.arange(-self.warm, int((end - start).max()))
        at = start[None, :] + steps[:, None]
        out = buf[np.minimum(at, len(buf) - 1)].astype(np.int64)
        out[at >= end[None, :]] = _PAD
        return out

    def count(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that begin and sentinels that end in each lane buf[start:end]."""
        tally = np.zeros(len(start), np.int64)
        for a in range(0, len(start), LANES):
            part = slice(a, a + LANES)
            state = np.zeros(len(start[part]), np.int64)
            for t, byte in enumerate(self._columns(buf, start[part], end[part])):
                state += byte
                if t >= self.warm:
                    tally[part] += self.flag[state]
                state = self.next[state]
        return tally % _HIT, tally // _HIT

    def locate(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Where in buf the unit of the given number, counted from 0 in its lane, begins."""
        found = end.copy()
        for a in range(0, len(start), LANES):
            part = slice(a, a + LANES)
            want, first, where = unit[part], start[part], found[part]
            state, seen = np.zeros(len(want), np.int64), np.zeros(len(want), np.int64)
            for t, byte in enumerate(self._columns(buf, first, end[part])):
                state += byte
                if t >= self.warm:
                    begins = self.flag[state] & _UNIT
                    here = (begins == 1) & (seen == want)
                    where[here] = first[here] + (t - self.warm)
                    seen += begins
                state = self.next[state]
        return found


def _split(n: int, h1: int, h2: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def join_parts(form: str, prefix: bytes, middle: bytes, suffix: bytes, sentinels: tuple[bytes, ...]) -> bytes:
    p, s, m = sentinels
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restore_text(output: bytes, form: str, sentinels: tuple[bytes, ...] = tuple(s.encode() for s in SENTINELS)) -> bytes:
    """The text that an output was made of: its parts are found by their sentinels, which no text holds."""
    p, s, m = sentinels
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    at = output.index(second, len(first))
    end = output.index(m, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(m) :]
    return one + middle + two if form == "psm" else two + middle + one


def _transform(scan: Scanner, texts: list[bytes], numbers: np.ndarray, sentinels: tuple[bytes, ...]):
    """(n, form, prefix, middle, output) of each text."""
    gap = b"\0" * scan.warm  # no sentinel and no code point reaches across
    buf = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + scan.warm) - sizes
    lanes = -(-sizes // LANE)
    doc = np.repeat(np.arange(len(texts)), lanes)
    first = np.cumsum(lanes) - lanes
    start = begin[doc] + (np.arange(len(doc)) - first[doc]) * LANE
    end = np.minimum(start + LANE, (begin + sizes)[doc])
    units, hits = scan.count(buf, start, end)
    before = np.append(0, np.cumsum(units))  # units of all earlier lanes
    found = np.append(0, np.cumsum(hits))
    n = before[first + lanes] - before[first]
    barred = found[first + lanes] > found[first]
    forms, cuts = [], []
    for k in range(len(texts)):
        h1, h2, h3, h4 = (int(x) for x in numbers[k])
        plain = not sizes[k] or barred[k] or h3 % 100 >= PLAIN_FROM
        forms.append("plain" if plain else "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm")
        if not plain:
            cuts += [(k, c) for c in _split(int(n[k]), h1, h2)]
    where = np.empty(0, np.int64)
    if cuts:
        k, unit = np.array(cuts, np.int64).T
        # The lane that holds a unit; the unit behind the last one begins where the text ends.
        lane = np.minimum(np.searchsorted(before, before[first[k]] + unit, "right") - 1, first[k] + lanes[k] - 1)
        where = scan.locate(buf, start[lane], end[lane], before[first[k]] + unit - before[lane]) - begin[k]
    at = iter(zip(cuts, where.tolist()))
    for k, text in enumerate(texts):
        if forms[k] == "plain":
            yield int(n[k]), "plain", None, None, text
        else:
            (a, i), (b, j) = next(at), next(at)
            yield int(n[k]), forms[k], a[1], b[1] - a[1], join_parts(forms[k], text[:i], text[i:j], text[j:], sentinels)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, with_text: bool = True) -> DataFrame:
    """Each text cut in three at random places and put together anew, so that a model learns to fill the middle.

    Returns the id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars, output_sha256,
    restored_sha256 (of the text rebuilt from output and form) and, with_text, the output. Places and form
    follow from the hash of `seed:id`. A table-driven DFA over bytes counts the beginnings of code points and
    the ends of sentinels in lanes of 512 bytes, all lanes of a block at once; the second pass goes through the
    lanes only that hold a cut. No shuffle; memory is a block of 4 MB of text, or one text if that is longer.

    Null text counts as empty; empty texts and texts that hold a sentinel stay plain. A null id is the empty
    text in the hash; repeated rows each get the same result. An empty table gives no rows. Other columns are left out.
    """
    modest_batches(docs.sparkSession)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), *[F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k}") for k in range(4)])
    marks, raw = tuple(sentinels), tuple(s.encode("ascii") for s in sentinels)
    scanner = Scanner(marks)
    fields = [docs.schema[id_col], *(T.StructField(c, t) for c, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output_sha256", T.StringType()), ("restored_sha256", T.StringType())))]
    fields += [T.StructField("output", T.StringType())] * with_text

    def run(batches):
        for b in batches:
            texts, ids = b.column(1).cast(pa.binary()), b.column(0)
            numbers = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)], axis=1)
            at = 0
            while at < len(texts):
                block, size, end = [], 0, at
                while end < len(texts) and (not block or size + len(block[-1]) <= LANE * LANES):
                    block.append(texts[end].as_py())
                    size, end = size + len(block[-1]), end + 1
                out = list(_transform(scanner, block, numbers[at:end], raw))
                columns = [ids.slice(at, end - at), *(pa.array([r[k] for r in out], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.int64()), (3, pa.int64())))]
                columns.append(pa.array([hashlib.sha256(r[4]).hexdigest() for r in out]))
                columns.append(pa.array([hashlib.sha256(restore_text(r[4], r[1], raw)).hexdigest() for r in out]))
                if with_text:
                    columns.append(pa.array([r[4].decode() for r in out], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
                at = end

    return rows.mapInArrow(run, T.StructType(fields))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST(('0x' || h[1:8]) AS BIGINT) AS h1, CAST(('0x' || h[9:16]) AS BIGINT) AS h2, CAST(('0x' || h[17:24]) AS BIGINT) AS h3, CAST(('0x' || h[25:32]) AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""
