"""Source trees: scan with ignore rules, extension registry, and a row generator for symbols and edges.

Parsing covers definitions, calls, imports and test names of the registered languages by pattern; other
parsers are plugged in with `register`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlab.functions import exprs as X

MAX_BYTES = 2 * 1024 * 1024
EXTENSIONS = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx"}
_DEF = {
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?P<k>fn|struct|enum|trait|mod|const|type)\s+(?P<n>\w+)",
    "python": r"^\s*(?:async\s+)?(?P<k>def|class)\s+(?P<n>\w+)",
}
_DEF["typescript"] = _DEF["tsx"] = _DEF["javascript"] = _DEF["jsx"] = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?P<k>function|class|interface|type|enum)\s+(?P<n>\w+)"
_IMPORT = {"rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"}
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_KINDS = {"fn": "function", "def": "function", "function": "function"}
Row = tuple[str, str, str, str, str, int]
_parsers: dict[str, Callable[[str, str], Iterator[Row]]] = {}


def register(language: str, parse: Callable[[str, str], Iterator[Row]]) -> None:
    """Add or replace a parser: (path, text) -> rows (row, kind, name, target, language, line)."""
    _parsers[language] = parse


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, text) of the files of known extension that no ignore rule covers and that fit the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.filter((F.col("length") <= MAX_BYTES) & ~X.is_ignored(F.col("path"), X.IGNORED_PARTS))
    names = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    out = files.withColumn("language", F.try_element_at(names, F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))))
    return out.filter("language IS NOT NULL").select("path", "language", F.decode("content", "UTF-8").alias("text"))


def _parse(language: str, path: str, text: str) -> Iterator[Row]:
    if language in _parsers:
        yield from _parsers[language](path, text)
        return
    inside = f"file::{path}"
    for no, line in enumerate((text or "").split("\n"), 1):
        m = re.match(_DEF.get(language, r"$^"), line)
        if m:
            inside = m["n"]
            yield "symbol", _KINDS.get(m["k"], m["k"]), inside, "", language, no
            if re.match(r"test_|.*_test$|it_", inside):
                yield "test", "test", inside, inside, language, no
        i = re.match(_IMPORT.get(language, r"$^"), line)
        if i:
            yield "edge", "depends_on", f"file::{path}", next(g for g in i.groups() if g), language, no
        rest = line[m.end() :] if m else line
        for c in _CALL.findall(rest):
            if c not in {"if", "for", "while", "match", "return", "switch"}:
                yield "edge", "calls", inside, c, language, no


def extract(files: DataFrame) -> DataFrame:
    """(path, row, kind, name, target, language, line): symbols, edges and tests of every file, sorted within it and without repeats."""

    def run(batches):
        for df in batches:
            rows = [(p, *r) for p, lang, t in zip(df["path"], df["language"], df["text"], strict=True) for r in sorted(set(_parse(lang, p, t)))]
            yield pd.DataFrame(rows, columns=["path", "row", "kind", "name", "target", "language", "line"])

    return files.select("path", "language", "text").mapInPandas(run, "path string, row string, kind string, name string, target string, language string, line int")


def count_loc(files: DataFrame) -> DataFrame:
    """(path, loc, todo): lines that are neither blank nor comment, block comments included; marker counts."""

    def run(batches):
        for df in batches:
            out = []
            for text in df["text"]:
                n, block = 0, False
                for line in (text or "").split("\n"):
                    t = line.strip()
                    if block:
                        block = "*/" not in t
                    elif t.startswith("/*"):
                        block = "*/" not in t
                    elif t and not t.startswith(("//", "#")):
                        n += 1
                out.append(n)
            yield pd.DataFrame({"path": df["path"], "loc": out, "todo": [sum((t or "").count(m) for m in ("TODO", "FIXME")) for t in df["text"]]})

    return files.select("path", "text").mapInPandas(run, "path string, loc int, todo int")
