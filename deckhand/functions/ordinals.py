"""Which ordinals a caller means: a number, a list, "3", "1,5,10", ":10", "5:20", "25:", with or without brackets.

Ordinals count from 1 and both ends of a range belong to it.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(spec: Any, total: int) -> list[int]:
    """The ordinals in ascending order, each once. An end beyond the last is cut there; what else lies outside is an error."""
    if spec is None:
        return list(range(1, total + 1))
    if isinstance(spec, bool) or not isinstance(spec, (int, str, list, tuple)):
        raise ValueError(f"not an ordinal, a list or a range: {spec!r}")
    if isinstance(spec, int):
        found = [spec]
    elif isinstance(spec, (list, tuple)):
        if any(isinstance(x, bool) or not isinstance(x, int) for x in spec):
            raise ValueError(f"a list may hold whole numbers only: {spec!r}")
        found = list(spec)
    else:
        inner = re.sub(r"^\[(.*)\]$", r"\1", spec.strip()).strip()
        if m := re.fullmatch(r"\s*(\d*)\s*:\s*(\d*)\s*", inner):
            lo, hi = int(m[1] or 1), int(m[2] or total)
            if lo < 1 or lo > total or hi < lo:
                raise ValueError(f"no such range among {total}: {spec!r}")
            return list(range(lo, min(hi, total) + 1))
        if not re.fullmatch(r"\s*-?\d+\s*(,\s*-?\d+\s*)*", inner):
            raise ValueError(f"not an ordinal, a list or a range: {spec!r}")
        found = [int(x) for x in inner.split(",")]
    if outside := [x for x in found if not 1 <= x <= total]:
        raise ValueError(f"outside 1 to {total}: {outside}")
    return sorted(set(found))


def predicate(c: Column, spec: Any) -> Column:
    """The same as a condition, for data whose totals differ; ordinals that a file doesn't have simply don't match."""
    if spec is None:
        return F.lit(True)
    if isinstance(spec, str) and ":" in spec:
        inner = re.sub(r"^\[(.*)\]$", r"\1", spec.strip())
        if not (m := re.fullmatch(r"\s*(\d*)\s*:\s*(\d*)\s*", inner)) or (m[1] and m[2] and int(m[1]) > int(m[2])):
            raise ValueError(f"not a range: {spec!r}")
        return (c >= int(m[1] or 1)) & (c <= int(m[2]) if m[2] else F.lit(True))
    return c.isin(parse(spec, 1 << 31) if not isinstance(spec, (list, tuple)) else parse(list(spec), 1 << 31))


def lenient(c: Column, total: Column) -> Column:
    """Of an array of ordinals those that exist, ascending."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: (x >= 1) & (x <= total))))
