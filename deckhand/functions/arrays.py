"""Array expressions: values bound once, and stretches of equal keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once; a lambda that names an expression would work it out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def stretches(found: Column, key: Callable[[Column], Column]) -> Column:
    """An array as an array of its stretches with equal keys, in time that grows with the array. Keys aren't null."""

    def split(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, i: i + 1), lambda i: (i == 1) | (key(F.get(a, i - 1)) != key(F.get(a, i - 2))))
        return let(starts, lambda s: F.transform(s, lambda at, j: F.slice(a, at, F.coalesce(F.get(s, j + 1), F.size(a) + 1) - at)))

    return let(found, split)
