"""Effective formatting of runs: what a run doesn't state comes from its paragraph, its shape's list style, the deck's.

The levels, nearest first: the run; the paragraph's default run properties; the shape's style for the paragraph's list level,
then for all levels; the presentation's for that level, then for all. Each property is resolved by itself, so a run may
take its size from the deck and its colour from its shape. What no level states takes a fixed value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckhand.operators.formatting import DEFAULT_SIZES

LOOK = ("size", "bold", "italic", "underline", "color")
PARAGRAPH = ("bullet", "mark", "indent")
#: Where a property came from, by the order of levels.
SOURCES = ("run", "paragraph", "shape_level", "shape", "deck_level", "deck")


def at_level(styles: Column, level: Column) -> Column:
    """The style for a list level; of several the first; null if there is none."""
    return F.get(F.filter(styles, lambda s: s["lvl"] == level), F.lit(0))


def effective(paragraphs: DataFrame) -> DataFrame:
    """A row a run with its effective size, flags, colour, bullet, mark, indent and level, and where its size came from.

    ``paragraphs`` is a table as ``styles.paragraphs`` makes it. One pass, no join and no shuffle: every level that
    counts is in the paragraph's row. A paragraph without runs has no rows.
    """
    level = {"shape_level": ("shape_styles", F.col("lvl")), "shape": ("shape_styles", F.lit(-1)), "deck_level": ("deck_styles", F.col("lvl")), "deck": ("deck_styles", F.lit(-1))}
    found = paragraphs.select("*", *(at_level(F.col(c), k).alias(f"_{name}") for name, (c, k) in level.items()))
    above = [F.col(f"_{name}") for name in level]
    each = found.select("*", F.posexplode("runs").alias("run", "r"))
    nearest = lambda name: [F.col("r")[name], F.col("look")[name], *(s[name] for s in above)]
    size = F.coalesce(*(F.when(F.col("ph_type") == k, F.lit(v)) for k, v in DEFAULT_SIZES.items()), F.lit(18.0))
    values = {name: F.coalesce(*nearest(name)) for name in LOOK} | {name: F.coalesce(name, *(s[name] for s in above)) for name in ("bullet", "indent")}
    # A bullet's mark goes with the level that states the bullet, not with the nearest mark.
    marked = [(F.col("bullet"), F.col("mark")), *((s["bullet"], s["mark"]) for s in above)]
    mark = F.coalesce(*(F.when(b.isNotNull(), F.struct(m.alias("mark"))) for b, m in marked))["mark"]
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for name, c in zip(SOURCES, nearest("size"))), F.lit("default"))
    return each.select(
        "file", "slide_number", "shape", "ph_type", "para", "run", F.coalesce(F.col("r")["text"], F.lit("")).alias("text"), "lvl",
        F.coalesce(values["size"], size).alias("size"), source.alias("size_from"), *(F.coalesce(values[c], F.lit(False)).alias(c) for c in ("bold", "italic", "underline")),
        values["color"].alias("color"), F.coalesce(values["bullet"], F.lit("none")).alias("bullet"), mark.alias("mark"), F.coalesce(values["indent"], F.lit(0)).cast("long").alias("indent"),
    )


def bullets(runs: DataFrame) -> DataFrame:
    """A row a paragraph that shows a bullet, with its text: file, slide_number, shape, para, lvl, bullet, mark, text_content."""
    key = ["file", "slide_number", "shape", "para", "lvl", "bullet", "mark"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "")
    return runs.where("bullet <> 'none'").groupBy(*key).agg(text.alias("text_content")).where(F.trim("text_content") != "")
