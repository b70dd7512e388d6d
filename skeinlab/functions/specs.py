"""Small grammars read on the driver: windows, look-backs, periods."""

from __future__ import annotations

import re


def window_spec(value: str) -> tuple[str, str | int]:
    """`since:<commit>`, `<n>d` or `<n> commits`; anything else is a commit."""
    v = value.strip()
    if v.lower().startswith("since:"):
        return "since", v[6:].strip()
    if m := re.fullmatch(r"(\d+)\s*d(?:ays?)?", v, re.I):
        return "days", int(m[1])
    if m := re.fullmatch(r"(\d+)(?:\s*commits?)?", v, re.I):
        return "commits", int(m[1])
    return "since", v


def lookback_spec(value: str | None, default: int = 20) -> tuple[str, str | int]:
    return window_spec(value) if value and value.strip() else ("commits", default)


def window_days(window: str | None) -> int | None:
    """7d, 30d, 90d or all (None); anything else counts as 7."""
    v = (window or "").strip().lower()
    return None if v == "all" else {"30d": 30, "90d": 90}.get(v, 7)


def head_change(branch_before: str, branch_after: str, head_before: str, head_after: str, parents: int) -> str | None:
    if branch_before != branch_after:
        return "branch_switch"
    if head_before == head_after:
        return None
    return "merge" if parents > 1 else "pull"


# Periods and their seconds.
PERIODS = {"1h": 3_600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000}


def period(since: str | None) -> tuple[str, int]:
    """(label, seconds) of a period; anything unknown is a day."""
    label = (since or "24h").strip().lower()
    return (label, PERIODS[label]) if label in PERIODS else ("24h", PERIODS["24h"])
