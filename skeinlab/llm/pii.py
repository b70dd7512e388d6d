"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skeinlab.llm.common import modest_batches

# The kinds whose plain matches always stay, in the order in which ties at one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
# Kinds that the method adds: parts of runs that fail as a whole, and shapes that need a checksum or words nearby.
ADDED_KINDS = ("iban", "card_part", "phone_part", "local_phone", "social", "birth")
KINDS = BASE_KINDS + ADDED_KINDS

# Patterns are possessive, so that long runs of one class are gone through once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_GROUP = re.compile(r"[0-9]++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9./-])")
_WORD = re.compile(r"[^\W\d_]+")

# Lengths of the account numbers of these countries.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
# Words, lower case, that speak for a kind and against it.
FOR_WORDS = {
    "email": {"mail", "email", "contact", "correo", "courriel", "kontakt"},
    "ip": {"ip", "host", "address", "server", "client", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "mobile", "call", "fax", "cell", "telefon", "telefono", "teléfono", "téléphone", "handy", "anruf"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "social": {"ssn", "social", "security", "sozialversicherung"},
    "birth": {"born", "birth", "birthday", "dob", "geboren", "geburtstag", "né", "née", "naissance", "nacido", "nacida", "nacimiento"},
}
AGAINST_WORDS = {"isbn", "issn", "version", "token", "sha", "hash", "order", "invoice", "serial", "build", "commit", "model"}
#: Score before anything else is known, by kind; what a passed checksum, a word for it and a word against it change.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "card_part": 0.15, "phone_part": 0.6, "local_phone": 0.3, "social": 0.3, "birth": 0.2}
CHECKED, SUPPORT, OPPOSE = 0.4, 0.35, -0.35
#: An added span is reported from this score on; code points that are searched for words before and behind a span.
THRESHOLD, BEFORE, BEHIND = 0.5, 48, 24
_SAME = {"card_part": "card", "phone_part": "phone", "local_phone": "phone"}


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether letters as numbers (A is 10), the first four characters behind the rest, leave 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(_GROUP.findall(text))


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """At signs with a domain behind them; the name is the run before, down to the last match."""
    done = 0
    for m in _DOMAIN.finditer(t):
        at, size = m.start(), 64
        while True:
            low = max(done, at - size)
            n = _LOCAL.match(t[low:at][::-1]).end()
            if n < at - low or low == done:
                break
            size *= 4
        if n:
            yield at - n, m.end()
            done = m.end()


def _ips(t: str) -> Iterator[tuple[int, int]]:
    """Fours of numbers in runs of numbers and dots, from the left."""
    for m in _DOTTED.finditer(t):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield at, end
            at = end + 1


def _cards(t: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Digit runs that are card numbers, and card numbers of whole groups inside runs that are none."""
    whole, parts = [], []
    for m in _DIGITS.finditer(t):
        if m.end() - m.start() < 12:
            continue
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19:
            if luhn(digits):
                whole.append(m.span())
                continue
        if len(digits) < 13:
            continue
        groups, k = [g.span() for g in _GROUP.finditer(m[0])], 0
        while k < len(groups):
            found, size = None, 0
            for j in range(k, len(groups)):
                size += groups[j][1] - groups[j][0]
                if size > 19:
                    break
                if size >= 13 and (j - k + 1 < len(groups)) and luhn(_digits(m[0][groups[k][0] : groups[j][1]])) and m[0][groups[k][0]] in "3456":
                    found = j
            if found is not None:
                parts.append((m.start() + groups[k][0], m.start() + groups[found][1]))
                k = found
            k += 1
    return whole, parts


def _phones(t: str, others: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Phone numbers; and, of matches that run on into another confirmed span, what comes before that span."""
    whole, parts, at = [], [], 0
    others = sorted(others)
    for m in _PHONE.finditer(t):
        if 9 <= len(_digits(m[0])) <= 15:
            whole.append(m.span())
            continue
        while at < len(others) and others[at][0] <= m.start():
            at += 1
        if at < len(others) and others[at][0] < m.end():
            first = t[m.start() : others[at][0]].rstrip(" ().-")
            if 9 <= len(_digits(first)) <= 15:
                parts.append((m.start(), m.start() + len(first)))
    return whole, parts


def _ibans(t: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(t):
        want, seen = IBAN_LENGTHS.get(m[0][:2], 0), 0
        for k, c in enumerate(m[0]):
            seen += c != " "
            if seen == want:
                end = m.start() + k + 1
                if not t[end : end + 1].isalnum() and mod97(m[0][: k + 1].replace(" ", "")):
                    yield m.start(), end
                break


def _socials(t: str) -> Iterator[tuple[int, int]]:
    for m in _SOCIAL.finditer(t):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.span()


def _dates(t: str) -> Iterator[tuple[int, int]]:
    for m in _DATE.finditer(t):
        a, b, c = re.split(r"[./-]", m[0])
        day, month, year = (int(x) for x in ((c, b, a) if len(a) == 4 else (a, b, c)))
        if len(a) != 4 and month > 12:
            day, month = month, day
        if 1 <= month <= 12 and 1 <= day <= 31 and 1900 <= year <= 2030:
            yield m.span()


def score(t: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, with its checksum (all proposals of card and iban have passed theirs) and the words nearby."""
    name = _SAME.get(kind, kind)
    near = {w.lower() for w in _WORD.findall(t[max(0, start - BEFORE) : start]) + _WORD.findall(t[end : end + BEHIND])}
    out = PRIOR[kind] + CHECKED * (name in ("card", "iban")) + SUPPORT * bool(near & FOR_WORDS.get(name, set())) + OPPOSE * bool(near & AGAINST_WORDS)
    return min(1.0, max(0.0, out))


def spans_of(t: str) -> list[tuple[int, int, int, float]]:
    """(start, place of the kind in KINDS, end, score) of one text, in order. Base spans stay whatever their score."""
    emails, ips = list(_emails(t)) if "@" in t else [], list(_ips(t))
    cards, card_parts = _cards(t)
    phones, phone_parts = _phones(t, ips + cards + card_parts) if "+" in t else ([], [])
    out = [(a, KINDS.index(kind), b, score(t, kind, a, b)) for kind, found in zip(BASE_KINDS, (emails, ips, cards, phones)) for a, b in found]
    more = [("iban", _ibans(t)), ("card_part", card_parts), ("phone_part", phone_parts), ("local_phone", (m.span() for m in _LOCAL_PHONE.finditer(t))), ("social", _socials(t)), ("birth", _dates(t))]
    added = [(a, KINDS.index(kind), b, s) for kind, found in more for a, b in found if (s := score(t, kind, a, b)) >= THRESHOLD]
    out.sort()
    added.sort(key=lambda x: (x[0], -x[3], x[1]))
    # An added span gives way to base spans and to earlier added ones that it overlaps.
    taken, at, end, kept = sorted((a, b) for a, _, b, _ in out), 0, 0, []
    for x in added:
        while at < len(taken) and taken[at][1] <= x[0]:
            at += 1
        if x[0] >= end and not any(a < x[2] and x[0] < b for a, b in taken[max(0, at - len(BASE_KINDS)) : at + len(BASE_KINDS)]):
            kept.append(x)
            end = x[2]
    return sorted(out + kept)


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """(id, pii): the spans of personal data of each text, by start, then kind; with `masked`, also the text with each span replaced by its kind.

    A span has kind, start and end (code points, end exclusive), score and whether it is a base span. Patterns
    propose; cards have to pass Luhn's check and account numbers the remainder by 97; words before and behind
    raise or lower the score. Base spans (email, ip, card, phone) always stay; other kinds are reported from a
    score of 0.5 on and where they overlap no base span. No shuffle; texts go through once, in linear time.

    Null text counts as empty; null and repeated ids are kept row by row; an empty table gives no rows. Other
    columns are left out.
    """
    modest_batches(docs.sparkSession)
    fields = [docs.schema[id_col], T.StructField("pii", _SPANS)] + [T.StructField("masked", T.StringType())] * masked

    def hide(t: str, spans) -> str:
        out, at = [], 0
        for a, k, b, _ in spans:
            if a >= at:
                out += [t[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join(out) + t[at:]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [spans_of(t) for t in texts]
            rows = [[{"kind": KINDS[k], "start": a, "end": e, "score": s, "base": k < len(BASE_KINDS)} for a, k, e, s in spans] for spans in found]
            columns = [b.column(0), pa.array(rows, _ARROW)]
            if masked:
                columns.append(pa.array([hide(t, spans) for t, spans in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).mapInArrow(run, T.StructType(fields))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda x: x["base"])
    return found.select(id_col, *[count(kind) for kind in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
