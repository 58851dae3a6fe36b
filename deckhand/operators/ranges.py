"""Points joined with the ranges that hold them, by bins instead of by comparing all with all.

A range of whole numbers goes to the level whose bins are as wide as it or wider, so it touches two bins at most,
however long it is. A point looks into its bin on each level that has ranges, which are a dozen at most. So ranges may
nest, overlap and differ in length without a row for every number that they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a level are so many times as wide as those of the level below, given as bits; and the highest level.
STEP, TOP = 4, 15


def level_of(start: Column, end: Column) -> Column:
    """The lowest level whose bins are at least as wide as a range."""
    size = end - start + 1
    return sum((F.when(size > (1 << STEP * k), 1).otherwise(0) for k in range(TOP)), F.lit(0))


def bin_of(n: Column, level: Column | int) -> Column:
    """The number of a number's bin; right for negative numbers too, as the shift keeps the sign."""
    shift = F.lit(STEP) * level if isinstance(level, Column) else F.lit(STEP * level)
    return F.call_function("shiftright", n.cast("long"), shift.cast("int"))


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Rows of points with the rows of ranges that hold them, both ends included; ``left`` keeps points without one.

    on: columns in which both agree (none are needed); a null in them, in a point or at an end matches nothing, and neither does a
    range that ends before it starts. All other columns of both must have names of their own. Repeated rows each match.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    if clash := [c for c in ranges.columns if c in points.columns and c not in on]:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    held = ranges.where(F.col(start) <= F.col(end)).withColumn("_level", level_of(F.col(start).cast("long"), F.col(end).cast("long")))
    # A row for each level, of which there are sixteen at most.
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())
    first, last = bin_of(F.col(start), F.col("_level")), bin_of(F.col(end), F.col("_level"))
    filed = held.withColumn("_bin", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    looked = F.array(*(F.struct(F.lit(k).alias("level"), bin_of(F.col(point), k).alias("bin")) for k in levels)) if levels else F.array().cast("array<struct<level:int,bin:bigint>>")
    probes = points.withColumn("_look", F.explode(looked)).select("*", F.col("_look.level").alias("_level"), F.col("_look.bin").alias("_bin")).drop("_look")
    found = probes.join(filed, [*on, "_level", "_bin"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_level", "_bin")
    if how == "inner":
        return found
    # Points that are equal in all columns match alike, so those without a range are told by their values.
    same = [F.col(f"p.`{c}`").eqNullSafe(F.col(f"f.`{c}`")) for c in points.columns]
    condition = same[0]
    for c in same[1:]:
        condition &= c
    alone = points.alias("p").join(found.select(*points.columns).alias("f"), condition, "left_anti")
    return found.select(*points.columns, *(c for c in ranges.columns if c not in on)).unionByName(alone, allowMissingColumns=True)
