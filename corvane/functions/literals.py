"""What a text must hold for a regular expression to match in it: plain strings, which are found far faster than the expression."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4_096)
def needed(pattern: str) -> tuple[str, ...] | None:
    """Strings of which each match holds at least one; None if none is known. The shortest is as long as can be."""
    try:
        return _needed(list(re._parser.parse(pattern)))
    except re.error:  # what Java's expressions alone have
        return None


def _needed(items: list) -> tuple[str, ...] | None:
    found, run = [], ""
    for op, av in [*items, (None, None)]:
        if str(op) == "LITERAL" and av < 128:
            run += chr(av)
            continue
        if run:
            found.append((run,))
            run = ""
        inner = None
        if str(op) == "SUBPATTERN":
            inner = _needed(list(av[3]))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and av[0] > 0:
            inner = _needed(list(av[2]))
        elif str(op) == "BRANCH":
            each = [_needed(list(b)) for b in av[1]]
            inner = None if None in each else tuple(sorted({x for e in each for x in e}))
        if inner:
            found.append(inner)
    return max(found, key=lambda xs: (min(map(len, xs)), -len(xs)), default=None)


def matches(low: Column, pattern: str, text: Column | None = None) -> Column:
    """Whether a pattern matches in a lower-cased text; with ``text`` in that one, whatever the case. The expression only runs where its strings are."""
    found = (low if text is None else text).rlike(pattern if text is None else f"(?i){pattern}")
    strings = needed(pattern)
    if not strings:
        return found
    held = F.lit(False)
    for s in strings:
        held = held | F.contains(low, F.lit(s if text is None else s.lower()))
    return held & found
