"""Toxicity by fuzzy lexicon hits in context: Levenshtein automata run together with a trie of learned terms."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skeinlab.llm.common import bounded_broadcast, modest_batches

#: Labelled rows that the lexicon and the weights are fitted on, at most (smallest hashes of the id).
TRAIN_ROWS = 12_000
#: Log odds that a term needs, least toxic documents with it, words on either side of a hit that are its context.
LOG_ODDS, MIN_DOCS, CONTEXT = 3.0, 4, 6
STEM_SIZES = (4, 5, 6, 7)
STRIP = "\"'`.,;:!?()[]{}<>|*#$%&/\\-_~«»“”„‘’…¿¡"
QUOTES = "\"'`«»“”„‘’"
# Words that report what others say, and words that address someone.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes term word words phrase reported according means dit disait mot terme sagte sagt schrieb wort begriff dijo dice palabra término".split())
ADDRESS = frozenset("you your you're youre u ur tu te toi vous votre du dich dir dein sie ihr usted ustedes tú ti tus".split())


class FuzzyLexicon:
    """Deterministic product of a trie with the Levenshtein automata of its terms, built as words need it.

    A state is the set of (trie node, edits so far) that some prefix of the word can reach. Whole terms
    allow one edit from 4 characters and two from 9; stems match the start of a word, unedited.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], most: int = 500_000):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, int] | None] = [None]
        self.stem: list[str | None] = [None]
        self.terms, self.stems = terms, stems
        for t in terms:
            self.end[self._node(t)] = (t, 2 if len(t) >= 9 else 1 if len(t) >= 4 else 0)
        for t in stems:
            self.stem[self._node(t)] = t
        self.reach = max([0, *(e[1] for e in self.end if e)])
        self.states: list[tuple[tuple[int, int], ...]]
        self.number: dict[tuple, int]
        self.step: list[dict[str, int]]
        self.seen: dict[str, tuple[float, int] | None] = {}
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """Start with no states, which are built again as words need them."""
        self.states, self.number, self.step = [], {}, []
        self.first = self._state({0: 0})

    def _node(self, t: str) -> int:
        at = 0
        for c in t:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.end.append(None)
                self.stem.append(None)
            at = self.children[at][c]
        return at

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # trie characters that the word leaves out
            node, e = todo.pop()
            if e < self.reach:
                for child in self.children[node].values():
                    if nodes.get(child, self.reach + 1) > e + 1:
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        return self.number[key]

    def _next(self, s: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.states[s]:
            for d, child in self.children[node].items():
                cost = e + (d != c)
                if cost <= self.reach and cost < nodes.get(child, self.reach + 1):
                    nodes[child] = cost
            if e < self.reach and e + 1 < nodes.get(node, self.reach + 1):
                nodes[node] = e + 1
        out = self.step[s][c] = self._state(nodes)
        return out

    def match(self, word: str) -> tuple[float, int] | None:
        """(strength, edits) of the best term that the word is, or of the stem it starts with."""
        s, stem, node = self.first, None, 0
        for c in word:
            node = self.children[node].get(c, -1) if node >= 0 else -1
            if node >= 0 and self.stem[node]:
                stem = (self.stems[self.stem[node]], 0)
            s = self.step[s].get(c) if c in self.step[s] else self._next(s, c)
            if not self.states[s] and node < 0:
                break
        found = [stem] if stem else []
        for node, e in self.states[s]:
            end = self.end[node]
            if end and e <= end[1]:
                found.append((self.terms[end[0]], e))
        return max(found, key=lambda x: (x[0] - x[1], -x[1])) if found else None

    def look(self, token: str) -> tuple[float, int] | None:
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) >= self.most:
            self.seen.clear()
            self._forget()
        word = token.strip(STRIP)
        out = self.seen[token] = self.match(word) if len(word) >= 3 else None
        return out


FEATURES = ("any", "strongest", "total", "rate", "quoted", "address", "fuzzy")


def features(text: str | None, lexicon: FuzzyLexicon) -> list[float]:
    """Context-window scores of a text: a hit counts less inside quotes or beside reporting words, more beside address."""
    tokens = (text or "").lower().split()
    look, seen = lexicon.look, lexicon.seen
    hits = [k for k, t in enumerate(tokens) if (seen[t] if t in seen else look(t))]
    if not hits:
        return [0.0] * len(FEATURES)
    scores, quoted, address, fuzzy = [], 0, 0, 0
    for k in hits:
        strength, edits = look(tokens[k])
        around = tokens[max(0, k - CONTEXT) : k + CONTEXT + 1]
        bare = [t.strip(STRIP) for t in around]
        inside = tokens[k][0] in QUOTES or (any(t[0] in QUOTES for t in tokens[max(0, k - CONTEXT) : k]) and any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in tokens[k : k + CONTEXT + 1] if t.rstrip(".,;:!?")))
        told = any(b in REPORTING for b in bare)
        to = any(b in ADDRESS for b in bare)
        quoted += inside and told
        address += to
        fuzzy += edits > 0
        scores.append(strength * (0.6**edits) * (0.3 if inside and told else 0.7 if inside or told else 1.0) * (1.2 if to else 1.0))
    n = len(hits)
    return [1.0, max(scores) / 5, math.log1p(sum(scores)) / 3, min(1.0, 10 * n / len(tokens)), quoted / n, address / n, fuzzy / n]


def _tally(batches):
    """Toxic and other documents with each distinct word and stem, added up within a batch."""
    for b in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = {w for t in set((text or "").lower().split()) if len(w := t.strip(STRIP)) >= 3}
            mine = counts[int(bool(toxic))]
            mine.update("w" + w for w in words)
            mine.update({"s" + w[:k] for w in words for k in STEM_SIZES if len(w) > k})
        rows = [(t, toxic, n) for toxic, c in counts.items() for t, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["term", "toxic", "n"])


def learn_lexicon(labelled: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems that toxic documents hold far more often than others, with their log odds."""
    totals = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    counts = labelled.select("text", "toxic").mapInArrow(_tally, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (p + 1.0)) - F.log((F.col("q") + 0.5) / (n + 1.0))
    best = counts.filter(F.col("p") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LOG_ODDS).orderBy("term").collect()  # terms of the sample
    terms = {r.term[1:]: float(r.odds) for r in best if r.term[0] == "w"}
    stems = {r.term[1:]: float(r.odds) for r in best if r.term[0] == "s"}
    return terms, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights (intercept first) of ridge logistic regression, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(h, x.T @ (y - p) - pull * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each input row: id, score in [0, 1], predicted (1 if score >= 0.5, else 0).

    Lexicon and weights are fitted on at most `train_rows` labelled documents that satisfy `usable` (a
    condition on the id), those of smallest hash; scores see the text alone. With no toxic or no other
    label to learn from, every score is the smoothed share of toxic labels.

    Null and empty texts have no hits and get the score of a text without hits; labels that are null are
    left out; a document labelled twice counts twice; repeated rows are each scored; an empty table gives
    no rows.
    """
    modest_batches(docs.sparkSession)
    chosen = labels.filter(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("l_id"), "l_id", "toxic").limit(train_rows)
    labelled = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(bounded_broadcast(chosen, train_rows), F.col(id_col) == F.col("l_id")).select("text", "toxic")
    terms, stems = learn_lexicon(labelled)

    def measure(batches):
        lexicon = FuzzyLexicon(terms, stems)
        for b in batches:
            x = [features(t, lexicon) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    rows = labelled.mapInArrow(measure, "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # within train_rows
    x, y, n = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.toxic for r in rows], float), np.array([r.n for r in rows], int)
    x, y = np.repeat(x, n, axis=0), np.repeat(y, n)
    weights = fit_logistic(x, y) if len(set(y.tolist())) == 2 else np.r_[math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), np.zeros(len(FEATURES))]

    def score(batches):
        lexicon = FuzzyLexicon(terms, stems)
        for b in batches:
            f = np.array([features(t, lexicon) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(f @ weights[1:] + weights[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"
    return docs.select(id_col, text_col).mapInArrow(score, schema)
