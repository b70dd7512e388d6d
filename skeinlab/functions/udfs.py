"""Extension surface: providers and document parsers as Arrow-batched functions, with registries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

_embedders: dict[str, Callable[[list[str]], list[list[float]]]] = {}
_document_parsers: dict[str, Callable[[str, str], list[dict]]] = {}


def hash_embedding(texts: list[str], dim: int = 32) -> list[list[float]]:
    """Deterministic stand-in provider: signed hashed words, unit length."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


_embedders["hash"] = hash_embedding


def register_embedder(name: str, f: Callable[[list[str]], list[list[float]]]) -> None:
    _embedders[name] = f


def embed(df: DataFrame, text: str, provider: str = "hash", into: str = "embedding") -> DataFrame:
    """Adds an embedding column; texts go to the provider one Arrow batch at a time."""
    f = _embedders[provider]

    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(f(s.fillna("").tolist()))

    return df.withColumn(into, run(F.col(text)))


def paragraph_units(path: str, content: str) -> list[dict]:
    units, at = [], 0
    for part in (content or "").split("\n\n"):
        if part.strip():
            units.append({"unit_kind": "paragraph", "display_name": part.strip()[:40], "content": part, "start": at, "end": at + len(part)})
        at += len(part) + 2
    return units


_document_parsers["paragraph"] = paragraph_units


def register_document_parser(name: str, f: Callable[[str, str], list[dict]]) -> None:
    _document_parsers[name] = f


def parse_documents(docs: DataFrame, parser: str = "paragraph") -> DataFrame:
    """Units of (path, content): unit_kind, display_name, content, start, end."""
    f = _document_parsers[parser]

    def run(batches):
        for df in batches:
            rows = [{"path": p, **u} for p, c in zip(df["path"], df["content"], strict=True) for u in f(p, c)]
            yield pd.DataFrame(rows, columns=["path", "unit_kind", "display_name", "content", "start", "end"])

    return docs.select("path", "content").mapInPandas(run, "path string, unit_kind string, display_name string, content string, start int, end int")


def first_json_object(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the first balanced {...} of a text, strings respected; null if there is none."""

    def find(t: str | None) -> str | None:
        depth, start, quoted, skip = 0, None, False, False
        for i, c in enumerate(t or ""):
            if start is not None and quoted:
                quoted, skip = (True, False) if skip else (c != '"', c == "\\")
                continue
            if c == '"' and start is not None:
                quoted = True
            elif c == "{":
                start = i if start is None else start
                depth += 1
            elif c == "}" and start is not None:
                depth -= 1
                if not depth:
                    return t[start : i + 1]
        return None

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(find)

    return df.withColumn(into, run(F.col(text)))


_annotators: dict[str, Callable[[list[dict]], list[dict]]] = {}
_summarizers: dict[str, Callable[[list[str]], str]] = {}


def first_words(units: list[dict]) -> list[dict]:
    """Deterministic stand-in provider: the first twelve words as the intent, confidence by length."""
    return [{"intent": " ".join((u.get("content") or "").split()[:12]), "confidence": min(1.0, len(u.get("content") or "") / 200)} for u in units]


_annotators["first_words"] = first_words
_summarizers["longest"] = lambda texts: max(texts, key=lambda t: (len(t), t), default="")


def register_annotator(name: str, f: Callable[[list[dict]], list[dict]]) -> None:
    _annotators[name] = f


def register_summarizer(name: str, f: Callable[[list[str]], str]) -> None:
    _summarizers[name] = f


def annotate(units: DataFrame, provider: str = "first_words", workers: int = 4, chunk: int = 64, retries: int = 2, fallback: str | None = None) -> DataFrame:
    """Units with intent, confidence and error: chunks go to the provider from a bounded pool of threads in each task.

    A chunk that fails is tried again `retries` times, then by the fallback provider; if all fail its rows keep the
    error and have no intent. Every row comes back, in order.
    """
    ways = [_annotators[provider]] * (retries + 1) + ([_annotators[fallback]] if fallback else [])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)

    def one(rows: list[dict]) -> list[dict]:
        error = None
        for way in ways:
            try:
                got = way(rows)
                if len(got) == len(rows):
                    return [{"intent": g.get("intent"), "confidence": g.get("confidence"), "error": None} for g in got]
                error = f"{len(got)} answers to {len(rows)} requests"
            except Exception as problem:  # noqa: BLE001  a provider may raise anything; the row tells what
                error = str(problem)
        return [{"intent": None, "confidence": None, "error": error}] * len(rows)

    def run(batches):
        with ThreadPoolExecutor(workers) as pool:
            for df in batches:
                rows = df.to_dict("records")
                found = [x for part in pool.map(one, [rows[k : k + chunk] for k in range(0, len(rows), chunk)]) for x in part]
                for c in ("intent", "confidence", "error"):
                    df[c] = pd.Series([x[c] for x in found], index=df.index, dtype="float64" if c == "confidence" else "object")
                yield df

    return units.mapInPandas(run, f"{schema}, intent string, confidence double, error string")


def summarize(records: DataFrame, group: str, text: str, provider: str = "longest") -> DataFrame:
    """(group, summary, n) by a provider over all texts of a group, which has to fit a task: files and modules do."""
    f = _summarizers[provider]

    @pandas_udf("string")
    def run(s: pd.Series) -> str:
        return f([x for x in s.tolist() if x is not None])

    return records.groupBy(group).agg(run(F.col(text)).alias("summary")).join(records.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)
