"""Column expressions: similarity, ranking, staleness, risk, quality and text rules. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RRF_K = 60.0
DAY_MS = 86_400_000
RECENCY_MS = 30 * DAY_MS


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(c, F.lit(hi)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for zero or mismatched vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / F.nullif(n, F.lit(0.0)))


def cosine_unit(a: Column, b: Column) -> Column:
    """Cosine held to 0..1; zero for zero or mismatched vectors."""
    return clamp(F.coalesce(cosine(a, b), F.lit(0.0)))


def cosine_signed(a: Column, b: Column) -> Column:
    """Cosine held to -1..1; null for zero or mismatched vectors."""
    c = cosine(a, b)
    return F.when(c.isNotNull(), clamp(c, -1.0, 1.0))


def rrf(rank: Column, k: float = RRF_K) -> Column:
    """Reciprocal rank score of a rank that starts at 1."""
    return F.lit(1.0) / (F.lit(k) + rank)


def recency_access_boost(base: Column, accesses: Column, last_ms: Column, now_ms: Column) -> Column:
    recency = F.coalesce(clamp(F.lit(1.0) - F.greatest(now_ms - last_ms, F.lit(0)) / RECENCY_MS), F.lit(0.0))
    access = F.log(F.greatest(accesses, F.lit(0)) + 1.0) / F.log(F.lit(100.0))
    return F.greatest(base, F.lit(0.0)) * (F.lit(1.0) + recency * 0.1 + access * 0.05)


def bands(c: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """First label whose lower edge the value reaches."""
    out = F.lit(rest)
    for lo, name in reversed(edges):
        out = F.when(c >= lo, name).otherwise(out)
    return out


def risk_band(c: Column) -> Column:
    return bands(c, [(0.7, "critical"), (0.4, "high"), (0.2, "medium")], "low")


def staleness_band(c: Column) -> Column:
    return bands(c, [(0.8, "critical"), (0.5, "high"), (0.2, "medium")], "low")


def risk_grade(score: Column, worst_is_f: bool = True) -> Column:
    """Letter bands; by default a high risk gets the worst letter, the other way round on request."""
    c = F.lit(1.0) - score if worst_is_f else score
    return bands(c, [(0.93, "A+"), (0.85, "A"), (0.78, "B+"), (0.70, "B"), (0.60, "C"), (0.50, "D")], "F")


def risk_score(pagerank: Column, drift: Column, has_record: Column, tests: Column, most: Column) -> Column:
    share = F.when(most > 0, clamp(pagerank / F.nullif(most, F.lit(0.0)))).otherwise(0.0)
    return clamp(share * 0.45 + clamp(drift) * 0.35 + F.when(tests > 0, 0.0).otherwise(0.2) + F.when(has_record, 0.0).otherwise(0.2))


def fused_coupling(temporal: Column, static: Column, semantic: Column, weights=(0.5, 0.3, 0.2)) -> Column:
    return temporal * weights[0] + static * weights[1] + semantic * weights[2]


def coupling_type(temporal: Column, static: Column, semantic: Column) -> Column:
    return (
        F.when((static > 0) & (temporal >= 0.2), "multi")
        .when(static > 0, "structural")
        .when(semantic >= 0.3, "semantic")
        .when(temporal >= 0.5, "hidden_operational")
        .otherwise("temporal")
    )


def raw_penalty(value: Column, warn: float, fail: float) -> Column:
    """Nothing up to `warn`, linear to 1 at `fail`, then half the relative overshoot, at most 2."""
    if fail <= warn:
        return F.lit(0.0)
    slope = F.when(value <= warn, 0.0).when(value <= fail, (value - warn) / (fail - warn)).otherwise((value - fail) / fail * 0.5 + 1.0)
    return clamp(slope, 0.0, 2.0)


def time_staleness(days: Column, half_life: float, k: float) -> Column:
    return F.lit(1.0) / (F.exp((days - half_life) * -k) + 1.0)


def effective_age(days: Column, churn: Column) -> Column:
    return days * (F.log2(churn + 1.0) + 1.0)


def noisy_or(a: Column, b: Column) -> Column:
    return F.lit(1.0) - (F.lit(1.0) - a) * (F.lit(1.0) - b)


def staleness(source_changed: Column, deprecated: Column, s_time: Column, s_neighbor: Column) -> Column:
    hard = F.when(source_changed | deprecated, 1.0).otherwise(0.0)
    return F.greatest(hard, noisy_or(s_time, s_neighbor))


def recency_factor(raw: Column, now_ms: Column) -> Column:
    """Age as a share of 30 days; seconds and milliseconds are told apart by size; null counts as old."""
    ms = millis(raw)
    return F.when(raw.isNull(), 1.0).otherwise(clamp(F.greatest(now_ms - ms, F.lit(0)) / RECENCY_MS))


def millis(raw: Column) -> Column:
    return F.when((raw > 0) & (raw < 1_000_000_000_000), raw * 1000).otherwise(raw)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 3.5)


def collapse_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def content_key(text: Column) -> Column:
    """Hash that ignores case (ASCII) and white space runs."""
    return F.sha2(F.translate(collapse_space(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def prompt_hash(source: Column, neighbors: Column, config: Column) -> Column:
    """Three 16-digit segments: source, neighbours in any order, configuration."""
    part = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    return F.concat_ws("|", part(source), part(F.array_join(F.array_sort(neighbors), "\n")), part(config))


def changed_segments(old: Column, new: Column) -> Column:
    a, b = F.split(old, r"\|"), F.split(new, r"\|")
    return F.struct(*[(~F.get(a, F.lit(k)).eqNullSafe(F.get(b, F.lit(k)))).alias(name) for k, name in enumerate(("source_changed", "neighbor_changed", "config_changed"))])


def normalize_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda x: F.lower(F.btrim(x))), lambda x: x != "")))


def merge_tags(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def lexical_terms(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(query), r"[^a-z0-9_/-]+"), lambda x: x != ""))


def bigrams(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of character bigram multisets."""
    x, y = bigrams(a), bigrams(b)
    tally = lambda xs, v: F.size(F.filter(xs, lambda z: z == v))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, v: s + F.least(tally(x, v), tally(y, v)))
    total = F.size(x) + F.size(y)
    same = F.lower(F.regexp_replace(a, r"\s+", "")) == F.lower(F.regexp_replace(b, r"\s+", ""))
    return F.when(same, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both * 2.0 / F.greatest(total, F.lit(1)))


def has_marker(text_lower: Column, marker: str) -> Column:
    # Most texts lack most markers: a search for the bare word, byte by byte, comes first.
    return text_lower.contains(marker) & text_lower.rlike(f"(?<![a-z0-9]){marker}(?![a-z0-9])")


# Words that show described behaviour, and failure handling.
BEHAVIOR_WORDS = ("by", "then", "when", "if", "after", "before", "while", "returns", "produces", "emits", "triggers", "delegates", "falls back", "retries")
ERROR_WORDS = ("error", "fail", "panic", "fallback", "default", "missing", "invalid", "timeout", "retry", "graceful", "degraded", "skip", "abort")


def quality_signals(text: Column) -> dict[str, Column]:
    """Specificity, behaviour, error coverage and length of a description, and their weighted sum."""
    t = F.btrim(text)
    low = F.lower(t)
    token = F.transform(F.split(t, r"\s+"), lambda x: F.regexp_replace(x, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""))
    ids = F.array_distinct(F.concat(F.filter(token, lambda x: x.rlike(r"^(?=.*_)(?=.*[a-z])[a-z0-9_]+$") | x.rlike(r"^[A-Z](?=.*[a-z])[A-Za-z0-9]*$")), F.transform(F.regexp_extract_all(t, F.lit("`\\s*([^`]*[^`\\s])\\s*`"), F.lit(1)), lambda x: F.btrim(x))))
    # A variable of a function over one entry, so that a text is put into lower case once and not for each word.
    count = lambda words: F.get(F.transform(F.array(low), lambda x: sum((has_marker(x, w).cast("int") for w in words), F.lit(0))), F.lit(0))
    empty = t == ""
    parts = {
        "specificity": F.least(F.size(ids) / 5.0, F.lit(1.0)),
        "behavioral_depth": F.least(count(BEHAVIOR_WORDS) / 4.0, F.lit(1.0)),
        "error_coverage": F.least(count(ERROR_WORDS) / 2.0, F.lit(1.0)),
        "length_score": F.least(F.length(t) / 300.0, F.lit(1.0)),
    }
    parts = {k: F.when(empty, 0.0).otherwise(v) for k, v in parts.items()}
    parts["composite_quality"] = clamp(parts["specificity"] * 0.3 + parts["behavioral_depth"] * 0.3 + parts["error_coverage"] * 0.2 + parts["length_score"] * 0.2)
    return parts


def blend_quality(composite: Column, percentile: Column) -> Column:
    return clamp(composite * 0.6 + percentile * 0.4)


def difficulty(errors: Column, effects: Column, deps: Column, concurrent: Column) -> Column:
    return (
        F.when(errors > 2, 30.0).when(errors > 0, 10.0).otherwise(0.0)
        + F.when(effects > 1, 25.0).when(effects > 0, 10.0).otherwise(0.0)
        + F.when(deps > 5, 20.0).when(deps > 2, 10.0).otherwise(0.0)
        + F.when(concurrent, 25.0).otherwise(0.0)
    )


def difficulty_label(score: Column) -> Column:
    return F.when(score <= 15.0, "easy").when(score <= 40.0, "moderate").when(score <= 65.0, "hard").otherwise("very_hard")


# Words that place a symbol in a layer; the first rule that applies wins.
LAYER_RULES = (
    ("Interface", ("server", "handler", "route"), ("api",)),
    ("Connectors", ("client", "connector", "provider"), ()),
    ("Data", ("db", "store", "repo", "cache"), ("state",)),
    ("Wire Format", ("frame", "parse", "codec", "wire", "proto"), ()),
    ("Core Logic", ("cmd", "command", "service"), ()),
)


def layer(path: Column, name: Column, intent: Column) -> Column:
    """Layer of a symbol by ordered word rules over its path, name and description."""
    p, n, i = F.lower(path), F.lower(name), F.lower(F.coalesce(intent, F.lit("")))
    out = F.when(p.rlike(r"/tests/|^tests/|_test\.rs$") | n.rlike("::tests|test::"), "Tests")
    out = out.when(p.rlike(r"/bin/|(^|/)main\.rs$|cli") | n.rlike("::main|::cli"), "Interface")
    for label, words, path_words in LAYER_RULES:
        out = out.when(p.rlike("|".join(words + path_words)) | n.rlike("|".join(words)), label)
    return out.when(i.rlike("utility|helper") | n.contains("helper"), "Utilities").otherwise("Core Logic")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, or else exclamation mark, or else question mark, or all."""
    t = F.btrim(text)
    cut = lambda m: F.when(F.instr(t, m) > 0, F.instr(t, m))
    return F.substring(t, F.lit(1), F.coalesce(cut("."), cut("!"), cut("?"), F.length(t)))


def snippet(text: Column, most: int = 180) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def severity_rank(c: Column) -> Column:
    low = F.lower(F.btrim(c))
    return F.when(low == "critical", 4).when(low == "high", 3).when(low == "medium", 2).when(low == "low", 1).when(low == "info", 0)


def clause_status(similarity: Column) -> Column:
    """Pass above 0.88, fail below 0.50, ambiguous between; the same for prohibitions."""
    return F.when(similarity > 0.88, "pass").when(similarity < 0.50, "fail").otherwise("ambiguous")


def is_ignored(path: Column, markers: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.translate(path, "\\", "/")), "/"), F.array(*[F.lit(m) for m in markers]))


def glob_to_regex(pattern: str) -> str:
    """Only the star is special: any run of characters."""
    return "^" + ".*".join("".join("\\" + c if not c.isalnum() and c not in "_ " else c for c in part) for part in pattern.split("*")) + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_to_regex(p)) | base.rlike(glob_to_regex(p))
    return out


def humanize_test(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(name, r"^(test_|it_|should_)", ""), "_+", " "))


def json_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def language_hint(query: Column) -> tuple[Column, Column]:
    """(query without its first language hint, the hint or null)."""
    p = r"(?i)(?:^|\s)(?:lang|language):(\S+)"
    hint = F.regexp_extract(query, p, 1)
    return F.btrim(F.regexp_replace(query, F.lit(p), F.lit(" "))), F.when(hint != "", F.lower(hint))


# Words that are not keywords of a task; path components that are never scanned.
STOPWORDS = (
    "the", "and", "for", "with", "from", "into", "that", "this", "these", "those", "then", "than",
    "when", "where", "while", "what", "which", "who", "why", "how", "are", "was", "were", "will",
    "would", "should", "could", "must", "have", "has", "had", "use", "using", "used", "need",
    "needs", "make", "makes", "made", "task", "context",
)
IGNORED_PARTS = (
    ".git", "target", "node_modules", "vendor", ".venv", "venv", "pycache", "__pycache__", "dist", "build",
    ".tox", ".mypy_cache", ".pytest_cache", ".next", ".nuxt", ".output", "coverage",
)


def keywords(text: Column, most: int = 8) -> Column:
    """First distinct words of three letters or digits or more that are not stop words."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS))
    return F.slice(F.array_distinct(words), 1, most)


def sparse_match(name: Column, path: Column, kind: Column, token: Column) -> Column:
    """Match class 0 (best) to 5: leaf equal, segment prefix, in name, in path, kind equal, other."""
    n = F.lower(name)
    segments = F.split(F.replace(n, F.lit("::"), F.lit(".")), r"\.")
    return (
        F.when(F.element_at(segments, -1) == token, 0)
        .when(F.exists(segments, lambda x: x.startswith(token)), 1)
        .when(n.contains(token), 2)
        .when(F.lower(path).contains(token), 3)
        .when(F.lower(kind) == token, 4)
        .otherwise(5)
    )


def structural_magnitude(purpose_changed: Column, edges: Column, deps: Column, constraints: Column) -> Column:
    part = lambda c, w: F.least(c, F.lit(4)) / 4.0 * w
    return clamp(F.when(purpose_changed, 0.4).otherwise(0.0) + part(edges, 0.25) + part(deps, 0.25) + part(constraints, 0.10))


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_source_id(path: Column) -> Column:
    return F.concat(F.lit("file::"), path)


def synthetic_id(level: Column, language: Column, path: Column) -> Column:
    """Hash of level, language and path of a record that no symbol owns."""
    return F.sha2(F.concat_ws(":", F.btrim(level), F.lower(F.btrim(language)), normalize_path(F.btrim(path))), 256)


# Fixed values.
COMPLEXITY = ("Low", "Medium", "High", "Critical", "Unknown")
DEPRECATED_MODELS = ("qwen2.5-coder:7b",)


def complexity_label(value: Column) -> Column:
    """A known label in its usual spelling, else null."""
    label = F.initcap(F.lower(F.btrim(value)))
    return F.when(label.isin(*COMPLEXITY), label)


def record_fault(intent: Column, confidence: Column, complexity: Column) -> Column:
    """What is wrong with a record: its intent is blank, its confidence outside 0..1, its complexity unknown; null if nothing is."""
    return (
        F.when(F.coalesce(F.btrim(intent), F.lit("")) == "", "empty_intent")
        .when(confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1), "invalid_confidence")
        .when(complexity.isNotNull() & complexity_label(complexity).isNull(), "invalid_complexity")
    )


def is_deprecated(model: Column, deprecated: tuple[str, ...] = DEPRECATED_MODELS) -> Column:
    return F.lower(F.btrim(model)).isin(*[m.lower() for m in deprecated])


def is_edge_type(kind: Column, valid: list[str]) -> Column:
    return F.lower(kind).isin(*[v.lower() for v in valid])


def millis_to_day(ms: Column) -> Column:
    """yyyy-MM-dd of milliseconds since 1970, UTC."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd")


def iso_to_millis(text: Column) -> Column:
    """Milliseconds since 1970 of a date and time with its zone; null if it is none."""
    whole = F.btrim(text)
    return F.when(whole.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp(F.upper(whole))))


def dependency_entry(raw: Column) -> Column:
    """(name, reason) of "name: reason", "name - reason" or "name (reason)", the first form that fits; reason may be null."""
    t = F.btrim(raw)
    blank = lambda c: F.nullif(c, F.lit(""))
    after_colon = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(t, r"(?s)^[^:]*:", "")), r"^[()]+|[()]+$", ""))
    parts = F.regexp_extract(t, r"(?s)^(.+)\(([^(]*)\)$", 1), F.regexp_extract(t, r"(?s)^(.+)\(([^(]*)\)$", 2)
    pair = lambda name, reason: F.struct(name.alias("name"), reason.alias("reason"))
    return (
        F.when(t.contains(":"), pair(F.btrim(F.substring_index(t, ":", 1)), blank(after_colon)))
        .when(t.contains(" - "), pair(F.btrim(F.substring_index(t, " - ", 1)), blank(F.btrim(F.regexp_replace(t, r"(?s)^.*? - ", "")))))
        .when(F.btrim(parts[0]) != "", pair(F.btrim(parts[0]), blank(F.btrim(parts[1]))))
        .otherwise(pair(t, F.lit(None).cast("string")))
    )


def rerank_text(intent: Column, name: Column, kind: Column, path: Column) -> Column:
    """Text of a candidate for a reranker: its intent, if it has one, above its name, kind and path."""
    facts = F.concat(F.lit("qualified_name: "), name, F.lit("\nkind: "), kind, F.lit("\nfile_path: "), path)
    return F.concat_ws("\n", F.nullif(F.btrim(intent), F.lit("")), facts)


def diff_summary(purpose_before: Column, purpose_after: Column, added: dict[str, Column], removed: dict[str, Column]) -> Column:
    """One line of what changed: the purpose, then for each named array what came and what went."""
    changed = ~purpose_before.eqNullSafe(purpose_after)
    parts = [F.when(changed, F.concat(F.lit("purpose changed: '"), F.coalesce(purpose_before, F.lit("")), F.lit("' -> '"), F.coalesce(purpose_after, F.lit("")), F.lit("'")))]
    for name in added:
        for word, values in (("added", added[name]), ("removed", removed[name])):
            parts.append(F.when(F.size(values) > 0, F.concat(F.lit(f"{name} {word}: "), F.array_join(values, ", "))))
    return F.concat_ws("; ", *parts)
