"""Band join, personal data and fill-in-middle against plain versions, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlab.llm import band_join, fill_middle, licenses, pii, toxicity

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, p string, cell string"
ITEMS = "item_id long, name string, price double, u string, rank string, best string"


def shop(spark, items, lines):
    """Both tables, with extra columns whose names clash with the operator's own."""
    return (
        spark.createDataFrame([(i, "n", p, "x", "y", "z") for i, p in items], ITEMS),
        spark.createDataFrame([(s, n, i, 1, q, a, "x", "y") for s, n, i, q, a in lines], LINES),
    )


def by_pairs(items, lines, k=5):
    """Every item against every line."""
    priced = []
    for s, n, i, q, a in lines:
        if None not in (s, i, q, a) and q and not math.isnan(a):
            c = math.floor(100 * a + 0.5)
            priced.append(((2 * c + q) // (2 * q), s, n, i, zlib.crc32(f"{s},{'' if n is None else n},{i}".encode())))
    out = collections.Counter()
    for i, price in items:
        p = None if price is None or i is None or math.isnan(price) else math.floor(100 * price + 0.5)
        mine = [(abs(u - p), u, s, n, li, crc) for u, s, n, li, crc in priced if p is not None and li != i and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p)]
        mine.sort(key=lambda x: (x[0], x[1], x[2], x[3] is not None, x[3] or 0, x[4]))
        sums = (len(mine), sum(x[0] for x in mine), sum(x[5] for x in mine))
        for r, x in enumerate(mine[:k]):
            out[(i, r + 1, *x[:5], *sums)] += 1
        if not mine:
            out[(i, 0, None, None, None, None, None, 0, 0, 0)] += 1
    return out


@pytest.fixture(scope="module")
def stock():
    rng = random.Random(7)
    prices = [rng.choice((3.0, 3.05, 3.11, 9.99, 50.0, 398.0, 399.0)) if k % 3 else round(rng.uniform(2, 400), 2) for k in range(150)]
    items = [*enumerate(prices), (150, None), (151, float("nan")), (None, 3.0), (152, 1e30), (153, -1.0), (7, prices[7]), (8, 3.0), (154, 0.0)]
    lines = []
    for s in range(900):
        i = rng.randrange(12) if s % 3 else 5  # a third of the lines has one item and nearly one price
        q = rng.randrange(1, 9)
        unit = 3.0 if s % 3 == 0 else prices[rng.randrange(150)] * rng.choice((1.0, 1.0, 1.01, 0.998))
        lines.append((s // 3, s % 7, i, q, round(unit * q, 2)))
    lines += lines[:40] + [lines[0]] * 30
    lines += [(None, 1, 2, 1, 3.0), (1, None, 2, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 2, None, 3.0), (1, 1, 2, 1, None), (1, 1, 2, 0, 3.0), (1, 2, 3, -2, -6.01), (1, 1, 2, 1, float("nan")), (1, 1, 2, 1, 1e300), (5, 1, 4, 2, -2.01)]
    return items, lines


def kept_lines(lines):
    return [x for x in lines if x[4] is None or not x[4] > 1e290]  # beyond what doubles hold in cents: never pairs


@pytest.mark.parametrize(("cells", "least"), [(None, 10_000), (40, 1)])
def test_band_join_is_every_item_against_every_line(spark, stock, cells, least):
    items, lines = stock
    got = band_join.nearest_lines(*shop(spark, items, lines), cells=cells, least=least)
    want = by_pairs([(i, None if p == 1e30 else p) for i, p in items], kept_lines(lines))
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_band_pairs_are_all_pairs(spark, stock):
    items, lines = stock
    got = band_join.band_pairs(*shop(spark, items, lines), cells=20, least=1)
    pairs = collections.Counter((r.item_id, r.gap, r.u, r.sale_id, r.line_no, r.line_item_id) for r in got.collect())
    want = by_pairs([(i, None if p == 1e30 else p) for i, p in items], kept_lines(lines), k=10**6)
    listed = collections.Counter()
    for k, n in want.items():
        if k[1]:
            listed[(k[0], *k[2:7])] += n
    assert pairs == listed


def test_band_join_of_empty_tables(spark, stock):
    items, lines = shop(spark, *stock)
    assert band_join.nearest_lines(items.limit(0), lines).count() == 0
    alone = band_join.nearest_lines(items, lines.limit(0)).collect()
    assert len(alone) == len(stock[0]) and {r["rank"] for r in alone} == {0} and {r.n_pairs for r in alone} == {0}
    assert band_join.band_pairs(items.limit(0), lines).count() == 0


def test_regions_are_split_where_load_is_and_hot_prices_become_grids(spark):
    rows = [(k, 5, 50) for k in range(300, 400)] + [(390, 0, 90_000), (5_000, 40_000, 40_000), (9_000, 1, 1)]
    points = spark.createDataFrame(rows, "price long, lefts long, rights long").groupBy("price").agg(F.sum("lefts").alias("lefts"), F.sum("rights").alias("rights"))
    to = band_join.plan_regions(points, cells=50, least=100)
    where = np.searchsorted(to.last, [5_000, 390, 9_000], "left")
    assert to.down[where[0]] > 5 and to.across[where[0]] > 5  # one price, many items and lines
    assert to.down[where[1]] > 5  # lines that every cut would leave on both sides
    light = np.searchsorted(to.last, 320, "left")
    assert to.down[light] == 1 and to.across[light] == 1
    assert (np.diff(to.last) > 0).all() and (np.diff(to.low) >= 0).all() and (np.diff(to.high) >= 0).all()
    assert band_join.plan_regions(points.filter("price < 0"), cells=4) is None


# ---- personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_base(t):
    """The four patterns as they are written, by a backtracking engine."""
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(CARD, t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def base_hash(spans):
    return hashlib.sha256(",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


TEXTS = [
    None, "", " \n", "nothing here", "a@b.c d@e.f.g, x@y @z.w q@r.s@t.u", "@a.b@c.d._x%y@e-f.g.h.", "me.last+tag@mail.example.com", "é.ü@b.cc äö x@ü.de",
    "1.2.3.4 1.2.3.4.5.6.7.8.9 256.1.1.1 001.002.003.0004 1.2.3 1..2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 5", "4111  1111 1111 1111",
    "call +1 (843) 555-7672 170.106.47.218 now", "+1 (843) 555-7672, +49 30 1234567, +1 2 3, +1234567890123456789, + 12345", "+1" + " " * 500 + "23456789 0", "card +1 (843) 555-7672 4111111111111111 end",
    "IBAN DE89 3704 0044 0532 0130 00 AND", "DE88370400440532013000", "born 12.03.1984 or 12.03.1984 elsewhere and nothing else that matters in this long part of the text 1984-03-12",
    "SSN 078-05-1120 and order 078-05-1120", "phone (030) 1234 5678", "order (030) 1234 5678", "7" * 3000, "12 " * 2000, "a.b-c_" * 2000 + "@x.y", "x@" + "a-" * 2000, ("mail a@b.cd " * 500), "\U0001f600 a@b.c 1.1.1.1 \U0001f600",
]


def test_pii_base_is_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("0123456789  .-+@abz_%()é") for _ in range(rng.choice((20, 200, 900)))) for _ in range(400)]
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)] + [(None, "a@b.c", "x", "y"), (3, "b@c.d", "x", "y"), (3, "b@c.d", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string, spans string")
    got = pii.digest(pii.find_pii(docs)).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        spans = plain_base(t)
        want[(i, *[sum(x[1] == k for x in spans) for k in range(4)], base_hash(spans))] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:  # base spans stay among all spans
        listed = r.spans.split(",") if r.spans else []
        if r.doc_id is not None and r.doc_id != 3:
            base = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in plain_base(texts[r.doc_id])]
            assert not collections.Counter(base) - collections.Counter(listed)
    assert pii.digest(pii.find_pii(docs.limit(0))).count() == 0


def added(t):
    return [(pii.KINDS[k], t[a:b]) for a, k, b, _ in pii.spans_of(t) if k >= len(pii.BASE_KINDS)]


def test_pii_checksums_and_context_decide_on_added_spans(spark):
    assert added("call +1 (843) 555-7672 170.106.47.218 now") == [("phone_part", "+1 (843) 555-7672")]
    assert added("card +1 (843) 555-7672 4111111111111111 end") == [("phone_part", "+1 (843) 555-7672"), ("card_part", "4111111111111111")]
    assert added("IBAN DE89 3704 0044 0532 0130 00 AND") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("IBAN DE88 3704 0044 0532 0130 00 AND") == []  # the remainder is not 1
    assert added("SSN 078-05-1120") == [("social", "078-05-1120")] and added("part 078-05-1120") == [] and added("SSN 666-05-1120") == []
    assert added("born 12.03.1984") == [("birth", "12.03.1984")] and added("on 12.03.1984") == []
    assert added("phone (030) 1234 5678") == [("local_phone", "(030) 1234 5678")] and added("order (030) 1234 5678") == []
    assert pii.score("visa 4111111111111111", "card", 5, 21) > pii.score("4111111111111111", "card", 0, 16) > pii.score("isbn 4111111111111111", "card", 5, 21)
    docs = spark.createDataFrame([(1, "to a@b.cd or +49 30 1234567."), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.masked for r in pii.find_pii(docs, masked=True).collect()} == {1: "to <email> or <phone>.", 2: ""}


# ---- fill in the middle


def plain_middle(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_middle_is_the_plain_version(spark):
    rng = random.Random(11)
    letters = ["a", "b", " ", "\n", "\0", "é", "ß", "字", "߿", "ࠀ", "￿", "\U00010000", "\U0001f600", "<", "P", ">", "S", "M"]
    texts = [None, "", "a", "é", "\U0001f600", "<P>", "<<P>", "<P", "x<S>y", "<M", "<S", "P>", "字" * 511 + "<P>", "a" * 511 + "<M>", "a" * 510 + "<S>b", "a" * 512, "a" * 513, "ab" * 40_000, "字" * 70_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.choice((1, 3, 40, 600, 1500)))) for _ in range(300)]
    texts += ["".join(rng.choice(letters[:13]) for _ in range(rng.choice((5, 511, 512, 1024, 5000)))) for _ in range(200)]
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)] + [(None, "words", "x", "y"), (5, "again", "x", "y"), (5, "again", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n string")
    got = fill_middle.fill_middle(docs).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        n, form, a, m, out = plain_middle(i, t)
        want[(i, n, form, a, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), out)] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(docs.limit(0)).count() == 0


def test_scanner_counts_transitions_with_other_sentinels():
    scan = fill_middle.Scanner(("<|fim|>", "<|fin|>", "ab"))
    text = "x<|fim<|fim|>é<|fin|><|fi aab字".encode()
    gap = b"\0" * scan.warm
    buf = np.frombuffer(gap + text + gap, np.uint8)
    for lane in (4, 7, 100):
        start = np.arange(scan.warm, scan.warm + len(text), lane)
        end = np.minimum(start + lane, scan.warm + len(text))
        units, hits = scan.count(buf, start, end)
        assert units.sum() == len(text.decode()) and hits.sum() == 3
    with pytest.raises(ValueError, match="empty"):
        fill_middle.Scanner(("", "a", "b"))


def test_registered_new_queries(spark):
    from skeinlab.llm import queries

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    assert queries.QUERIES["op12_checked_pii"](spark, d).count() == n
    got = queries.QUERIES["op13_fill_middle"](spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(got) == n and all(r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in got)
    joined = queries.QUERIES["op11_band_join"](spark, d)
    items = [(r.item_id, r.price) for r in spark.read.parquet(f"{d}/items.parquet").collect()]
    lines = [(r.sale_id, r.line_no, r.item_id, r.quantity, r.amount) for r in spark.read.parquet(f"{d}/sale_lines.parquet").collect()]
    assert collections.Counter(tuple(r) for r in joined.collect()) == by_pairs(items, lines)


def test_edits_of_short_terms():
    fuzzy = toxicity.FuzzyLexicon({"dumb": 3.0, "oaf": 4.0, "nitwit": 5.0}, {})
    assert fuzzy.match("dumb") == (3.0, 0) and fuzzy.match("dumm") == fuzzy.match("dub") == fuzzy.match("duumb") == (3.0, 1)
    assert fuzzy.match("dmm") is None and fuzzy.match("oaff") is None and fuzzy.match("nitwlt") == (5.0, 1)


def test_lines_of_more_licences_than_are_sent_out(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Released under the MIT License.\nLicensed under CC BY 4.0\n"), (1, "Released under the MIT License.\nLicensed under CC BY 4.0\n"), (None, None), (2, "words"), (3, "released under the mit license")], "doc_id long, text string")
    few = sorted(map(str, licenses.scan_licenses(docs).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 2)
    assert sorted(map(str, licenses.scan_licenses(docs).collect())) == few and "CC-BY-4.0,MIT" in few[0] + few[1]


def test_last_stages_with_clashing_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    names = ["row", "uid", "gone", "size", "shard", "slot", "text_crc32", "written_0", "_before", "_index", "_total", "_part", "item_id", "a.b"]
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = words(40)
    rows = [(k, t, "en", "s", 1, *["x"] * len(names)) for k, t in [(1, words(80)), (2, f"{words(10)} {passage} {words(10)}"), (3, None), (None, ""), (4, "one"), (4, "one")]]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{n}` string' for n in names)}")
    df.write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "docs")), str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    left = stages["decontamination"](spark, docs, d)
    assert left.columns == docs.columns and {tuple(r)[5:] for r in left.collect()} == {("x",) * len(names)} and left.count() == 5
    out = stages["byte_shards"](spark, docs, d)
    added = ["size", "text_crc32", "shard", "slot"]
    assert out.columns == [c for c in docs.columns if c not in added] + added and out.count() == 6 and out.filter("`a.b` = 'x' AND _before = 'x'").count() == 6
    none = docs.limit(0)
    none.write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    assert all(stages[name](spark, none, d).count() == 0 for name in ("decontamination", "byte_shards"))
