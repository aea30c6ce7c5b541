"""What a regular expression demands of every text it fits: runs of plain characters, and short keys of them."""

from __future__ import annotations

import re

#: The parts of an expression. What none of them takes is a plain character.
PARTS = re.compile(
    r"(?P<unclear>\\[QEuxpPkcNX0]|\(\?[a-zA-Z]|\(\?-|\|)"  # may make what follows mean something else, or be one of several ways
    r"|(?P<plain>\\[^a-zA-Z0-9]|[^\\()\[\].^$*+?{}|])"
    r"|(?P<less>[*?]|\{0*(,\d*)?\})[?+]?"
    r"|(?P<again>\+|\{\d+(,\d*)?\})[?+]?"
    r"|(?P<open>\()|(?P<close>\))|(?P<set>\[)|(?P<other>\\[a-zA-Z]|\\\d+|[.^$])",
    re.DOTALL,
)
#: Characters of a key at most.
KEY = 3


def _after_set(pattern: str, at: int) -> int:
    """The place after a class of characters that starts at a bracket; -1 where it isn't closed or holds another."""
    at += 2 if pattern.startswith("^", at + 1) else 1
    first = True
    while at < len(pattern):
        if pattern[at] == "]" and not first:
            return at + 1
        if pattern[at] in "[&":
            return -1
        at, first = at + (2 if pattern[at] == "\\" else 1), False
    return -1


def required_runs(pattern: str) -> list[str]:
    """Runs of characters that occur in every text an expression fits. Groups and classes count as anything; where a part
    of the expression is unclear, nothing is demanded."""
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        part = PARTS.match(pattern, at)
        if part is None or part["unclear"] and (part["unclear"] != "|" or not depth):
            return []
        at = part.end()
        if part["set"]:
            at = _after_set(pattern, part.start())
            if at < 0:
                return []
        if part["plain"] and not depth:
            run += part["plain"][-1]
            continue
        if part["less"]:
            run = run[:-1]
        runs.append(run)
        run = ""
        depth += bool(part["open"]) - bool(part["close"])
        if depth < 0:
            return []
    return [r for r in (*runs, run) if r] if not depth else []


def keys(pattern: str | None) -> list[str]:
    """Pieces of KEY characters of the runs, or the longest runs where all are shorter; one empty key where nothing is demanded."""
    runs = required_runs(pattern or "")
    size = min(KEY, max(map(len, runs), default=0))
    return sorted({r[i : i + size] for r in runs for i in range(len(r) - size + 1)}) if size else [""]
