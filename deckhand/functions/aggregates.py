"""Aggregations of a group's values. Nulls don't count, and a group without values gives null for all of them.

Whatever depends on order takes an explicit order column, never the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckhand.functions.predicates import numeric, text

#: The names of all operations.
OPERATIONS = ("count", "list", "unique", "concat", "sum", "average", "min", "max", "first", "last", "most_common", "least_common")
#: These need the number of times that each value occurs, which is counted before the group is formed.
BY_FREQUENCY = ("most_common", "least_common")


def aggregate(c: Column, kind: str, operation: str, seq: Column, separator: str = ", ") -> Column:
    """All operations but those by frequency, as one column to aggregate."""
    some = F.count(c) > 0
    number = numeric(c, kind)
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(seq.alias("s"), x.alias("v"))))), lambda p: p["v"])
    found = {
        "count": lambda: F.count(c),
        "list": lambda: ordered(c),
        "unique": lambda: F.array_sort(F.collect_set(c.cast("string"))),
        "concat": lambda: F.array_join(ordered(F.when(F.trim(text(c)) != "", c.cast("string"))), separator),
        "sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)),
        "average": lambda: F.coalesce(F.avg(number), F.lit(0.0)),
        "min": lambda: F.min(number),
        "max": lambda: F.max(number),
        "first": lambda: F.min_by(c, F.when(c.isNotNull(), seq)),
        "last": lambda: F.max_by(c, F.when(c.isNotNull(), seq)),
    }[operation]()
    return F.when(some, found)


def by_frequency(value: Column, operation: str, rank: Column) -> Column:
    """Of values that are counted already the most or least common one. rank: a struct of its number and the negative
    of its first place, so that of equals the most common one is the first seen, and the least common one the last to
    have been first seen; null for values that don't take part."""
    return (F.max_by if operation == "most_common" else F.min_by)(value, rank)
