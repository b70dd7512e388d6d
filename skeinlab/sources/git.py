"""Tables from a git repository: commits with their files, and blame. git runs on the driver; its output becomes rows."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

COMMITS = "commit string, at long, author string, file string"
BLAME = "file string, line int, commit string, author string, at long, content string"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], check=True, capture_output=True).stdout.decode("utf-8", "replace")


def commits(spark: SparkSession, repo: str, limit: int | None = None) -> DataFrame:
    """One row for each commit and file it changes against its first parent, newest commit first; at is in milliseconds."""
    out, rows, head = _git(repo, "log", "--first-parent", "-m", "--no-renames", "--name-only", "--format=%x01%H%x02%ct%x02%an", *([f"-n{limit}"] if limit else [])), [], None
    for line in out.splitlines():
        if line.startswith("\x01"):
            commit, at, author = line[1:].split("\x02")
            head = (commit, int(at) * 1000, author)
        elif line:
            rows.append((*head, line))
    return spark.createDataFrame(rows, COMMITS)


def blame(spark: SparkSession, repo: str, path: str) -> DataFrame:
    """Last commit, author and time of each line of a file."""
    rows, commit, info = [], "", {}
    facts: dict[str, dict[str, str]] = {}
    for line in _git(repo, "blame", "--porcelain", "--", path).split("\n"):
        if line.startswith("\t"):
            rows.append((path, len(rows) + 1, commit, info.get("author"), int(info.get("author-time", 0)) * 1000, line[1:]))
        else:
            word, _, rest = line.partition(" ")
            if len(word) == 40 and not word.strip("0123456789abcdef"):
                commit, info = word, facts.setdefault(word, {})
            elif word:
                info[word] = rest
    return spark.createDataFrame(rows, BLAME)


def changed_paths(repo: str, old: str, new: str) -> list[str]:
    """Paths that differ between two refs, sorted."""
    return sorted(x for x in _git(repo, "diff", "--name-only", "--no-renames", old, new).splitlines() if x)
