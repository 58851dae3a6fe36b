"""Slides as HTML, and queries that return it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckhand.functions.predicates import text
from deckhand.operators import slides, tables

TITLES = ("title", "ctrTitle", "subTitle")
#: The forms of a simple query's results, and which text it gives.
OUTPUT_FORMATS, OUTPUT_TYPES = ("simple", "formatted"), ("preview_text_3boxes", "full_text")


def headed(c: Column, tag: str) -> Column:
    """Escaped text in a heading; empty if there is none."""
    return F.when(text(c) != "", F.concat(F.lit(f"<{tag}>"), tables.escaped(c), F.lit(f"</{tag}>"))).otherwise(F.lit(""))


def boxes(shapes: Column, rels: Column, most: int | None, longest: int) -> Column:
    """The first shapes with text that aren't titles, each as a block of formatted text of bounded length."""
    plain = F.filter(shapes, lambda s: ~F.coalesce(s["ph_type"].isin(list(TITLES)), F.lit(False)))
    found = F.filter(F.transform(plain, lambda s: tables.html_runs(s["paras"], rels)), lambda h: h != "")
    found = found if most is None else F.slice(found, 1, most)
    return F.array_join(F.transform(found, lambda h: F.concat(F.lit('<div style="white-space: pre-wrap;">'), slides.shortened(h, longest), F.lit("</div>"))), "")


def preview(boxes_shown: int | None = 3, longest: int = 200) -> Column:
    """Title, subtitle and the first boxes of a slide of the view ``slides``."""
    return F.concat(headed(F.col("title"), "h2"), headed(F.col("subtitle"), "h3"), boxes(F.col("shapes"), F.col("rels"), boxes_shown, longest))


def full() -> Column:
    return preview(None, 1000)


def query_simple(view: DataFrame, criteria: dict | None = None, return_fields: list[str] | None = None, output_format: str = "simple", output_type: str = "preview_text_3boxes", limit: int | None = None) -> DataFrame:
    """Slides that meet the criteria with simple fields: titles (in headings if formatted), text, and the tables as HTML."""
    names = list(return_fields or ("slide_number", "title", "text"))
    if output_format not in OUTPUT_FORMATS or output_type not in OUTPUT_TYPES:
        raise ValueError(f"unknown form {output_format} or text {output_type}; known are {', '.join(OUTPUT_FORMATS + OUTPUT_TYPES)}")
    if bad := [n for n in names if n not in slides.SIMPLE_FIELDS]:
        raise ValueError(f"unknown fields: {', '.join(bad)}; known are {', '.join(slides.SIMPLE_FIELDS)}")
    formatted = output_format == "formatted"
    found = view.where(slides.slide_condition(criteria or {}))
    plain = slides.preview(F.col("text_elements"), F.col("title"), *((None, 500) if output_type == "full_text" else ()))
    columns = {
        "title": headed(F.col("title"), "h2") if formatted else F.col("title"), "subtitle": headed(F.col("subtitle"), "h3") if formatted else F.col("subtitle"),
        "text": (full() if output_type == "full_text" else preview()) if formatted else plain,
    }
    out = found.select("file", "slide_number", *(columns[n].alias(n) for n in names if n in columns))
    if "extracted_tables" in names:
        shown = tables.extract(found, "html" if formatted else "simple_html")
        listed = shown.groupBy("file", "slide_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_index", "html"))), lambda x: x["html"]).alias("extracted_tables"))
        out = out.join(listed, ["file", "slide_number"], "left")
    out = out.orderBy("file", "slide_number")
    return out.limit(limit) if limit else out


def query_summary(view: DataFrame, criteria: dict | None = None, limit: int | None = None) -> DataFrame:
    """One row a file: its slides, those that meet the criteria (before any limit) and are returned, and the tables in them by slide."""
    meets = F.coalesce(slides.slide_condition(criteria or {}), F.lit(False))
    count = F.coalesce(F.size("tables"), F.lit(0))
    by_slide = F.map_from_entries(F.array_sort(F.collect_list(F.when(meets & (count > 0), F.struct("slide_number", count.alias("n"))))))
    out = view.groupBy("file").agg(F.count("*").alias("total_slides"), F.count_if(meets).alias("slides_matching_criteria"), by_slide.alias("tables_in_slides"))
    returned = F.col("slides_matching_criteria") if not limit else F.least("slides_matching_criteria", F.lit(limit).cast("long"))
    return out.withColumn("results_returned", returned)
