"""Secret scans: direct patterns, and weak parts that are linked into credentials within a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skeinlab.llm.common import Scratch

# The direct kinds, in the order in which ties at one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

# Weak parts: none of them is reported alone. A name may follow an underscore, as in DB_USER.
ID_PART = r"""(?<![\p{L}\p{N}])(?:AKIA[A-Z0-9]{4,}|(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,})"""
KEY_PART = r"""(?:(?<![\p{L}\p{N}])(?i:pass(?:word|wd)?|pwd|secret|token|api_?key|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+)"""
END_PART = r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+[A-Za-z0-9/:._-]*|(?<![\p{L}\p{N}])(?i:(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})"""
#: Most code points between the starts of parts of one credential.
SCOPE = 200


def _placed(rows: Column) -> Column:
    """Matches (n, e, g) with e, the length of a match and the gap before it, made its end: running sums by doubling.

    In round k each match takes on the sum that ends 2^k places before it; nothing is appended, so a text
    of very many matches takes their number times its logarithm.
    """

    def doubled(a: Column, k: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), k)
        more = F.transform(a, lambda x, i: F.struct(x["n"].alias("n"), (x["e"] + F.when(i >= by, F.get(a, i - by)["e"]).otherwise(0)).alias("e"), x["g"].alias("g")))
        return F.when(by < F.size(a), more).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(29)), rows, doubled)


def _spans(text: Column, pattern: str, keep: str | None = None) -> Column:
    """Array of (start, end) of the leftmost non-overlapping matches, in code points.

    The matches and the gaps between them (a split keeps every gap) give all offsets by running sums.
    `keep` is a SQL condition on `g`, the second group of a match, and `m`, the match.
    """
    p = F.lit(pattern)
    m, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    g = F.regexp_extract_all(text, p, F.lit(2)) if keep and "g" in keep.split() else m
    rows = F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("b"), g.alias("g"))
    sizes = F.transform(rows, lambda r: F.struct(F.length(r["m"]).alias("n"), (F.length(r["b"]) + F.length(r["m"])).alias("e"), r["g"].alias("g")))
    found = F.transform(_placed(sizes), lambda r: F.struct((r["e"] - r["n"]).alias("s"), r["e"].alias("e"), r["g"].alias("g")))
    if keep:
        found = F.filter(found, lambda x: F.length(x["g"]) >= int(keep.rpartition(" ")[2]))
    return found


def _where(text: Column, test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast("array<struct<s:int,e:int,g:string>>"))


def _named(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _render(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Direct matches (assign, access, hex) always count. Weak identifiers, keys and endpoints are exploded
    to intervals and joined within the same text and the same or the next block of `scope` code points; a
    weak key is reported (linked_key) only with an identifier within `scope`, and so is that identifier
    (linked_id); an endpoint within `scope` of such a key joins them (linked_end). Weak parts that overlap
    a direct span on the same place add nothing new and are left out.

    Null text counts as empty; repeated rows each get the same result; null ids are kept; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    rows = rows.select(
        "*",
        _where(F.col("_t"), F.col("_t").rlike(ASSIGN), _spans(F.col("_t"), ASSIGN, f"g >= {MIN_ASSIGN}")).alias("_assign"),
        _where(F.col("_t"), F.col("_t").contains("AKIA"), _spans(F.col("_t"), f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}")).alias("_access"),
        # Greedy runs of at least the length wanted are the maximal runs of that length.
        _where(F.col("_t"), F.col("_t").rlike(f"[0-9a-f]{{{MIN_HEX},}}"), _spans(F.col("_t"), f"[0-9a-f]{{{MIN_HEX},}}")).alias("_hex"),
        # Only texts with an identifier and a key can have linked parts.
        (F.col("_t").rlike(ID_PART) & F.col("_t").rlike(KEY_PART)).alias("_hint"),
    )
    base = F.concat(_named(F.col("_assign"), "assign", 0), _named(F.col("_access"), "access", 1), _named(F.col("_hex"), "hex", 2))
    parts = rows.filter("_hint").select(
        "_id", F.xxhash64("_t").alias("_th"), F.length("_t").alias("_tl"),
        F.explode(F.concat(_named(_spans(F.col("_t"), ID_PART), "linked_id", 3), _named(_spans(F.col("_t"), KEY_PART), "linked_key", 4), _named(_spans(F.col("_t"), END_PART), "linked_end", 5))).alias("p"),
    ).distinct().select("_id", "_th", "_tl", "p", F.floor(F.col("p.s") / scope).alias("_block"))
    parts = Scratch(docs.sparkSession).cut(parts, "parts")
    key = ["_id", "_th", "_tl"]

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of `left` with a row of `right` that starts at most `scope` away in the same text."""
        reach = right.select(*[F.col(c).alias(f"r{c}") for c in key], F.col("p.s").alias("rs"), F.explode(F.sequence(F.col("_block") - 1, F.col("_block") + 1)).alias("r_block"))
        on = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")) & (F.col("_tl") == F.col("r_tl")) & (F.col("_block") == F.col("r_block"))
        return left.join(reach, on & (F.abs(F.col("p.s") - F.col("rs")) <= scope), "left_semi")

    ids, keys, ends = (parts.filter(F.col("p.kind") == k) for k in ("linked_id", "linked_key", "linked_end"))
    keyed = near(keys, ids)
    linked = keyed.unionByName(near(ids, keys)).unionByName(near(ends, keyed))
    linked = linked.groupBy("_id", "_th", "_tl").agg(F.collect_set("p").alias("_linked"))  # parts of one text
    out = rows.select("_id", F.xxhash64("_t").alias("_th"), F.length("_t").alias("_tl"), F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"), base.alias("_base"))
    r = linked.select(F.col("_id").alias("r_id"), F.col("_th").alias("r_th"), F.col("_tl").alias("r_tl"), "_linked")
    out = out.join(r, F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")) & (F.col("_tl") == F.col("r_tl")), "left")
    more = F.coalesce("_linked", F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>"))
    more = F.filter(more, lambda x: ~F.exists(F.col("_base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    out = out.withColumn("_more", more)
    return out.select(
        F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex",
        F.sha2(_render(F.col("_base")), 256).alias("base_sha256"), _render(F.concat("_base", "_more")).alias("spans"), F.size("_more").cast("long").alias("n_linked"),
    )
