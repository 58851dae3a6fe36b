"""Whole presentations in one pass: a slide's findings become a small struct, and a file's structs one ordered array.

Everything that an analysis says of a file follows from that array by higher-order functions, so packages are read and
grouped once, however much is asked for. A struct holds no texts but a shortened title and samples, so an array
grows with the number of slides only. For tables with groups that no file bounds, ``analysis`` has the same findings
as aggregations that spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckhand.functions.arrays import let, stretches
from deckhand.operators import analysis, formatting
from deckhand.operators.analysis import has
from deckhand.operators.slides import shortened

#: How much of a title an example shows, and how much of a text a sample shows.
EXAMPLE, PREFIXED, SAMPLE = 50, 30, 100
PATTERN = "struct<pattern_type:string,pattern_name:string,occurrences:bigint,slides:array<int>,examples:array<string>,confidence:double>"


def total(deck: Column, value: Callable[[Column], Column], zero: float | int = 0.0) -> Column:
    return F.aggregate(deck, F.lit(zero), lambda a, s: a + value(s))


def counted(deck: Column, when: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(deck, when)).cast("long")


def of_type(kinds: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda s: s["slide_type"].isin(*kinds)


def format_total(name: str) -> Callable[[Column], Column]:
    return lambda s: s["formats"][name]


def decks(df: DataFrame, samples: int = 3, elements: int = 2, extra: tuple[str, ...] = ()) -> DataFrame:
    """file, deck: the findings on each slide in order, for rows as ``analysis`` takes them."""
    rows = analysis.slide_scores(analysis.classified(df))
    shown = F.transform(F.slice("texts", 1, elements), lambda t: shortened(t, SAMPLE)).alias("texts")
    struct = F.struct(
        "slide_number", F.left("title", F.lit(EXAMPLE)).alias("title"), F.when(has(F.col("title")), True).otherwise(False).alias("titled"),
        F.trim("title").rlike(r"^\d+\.").alias("numbered"), F.trim("title").endswith("?").alias("asked"), F.when(has(F.col("title")), analysis.title_prefix(F.col("title"))).alias("prefix"),
        (analysis.bullets(F.array_join("texts", " ")) >= 3).alias("bulleted"), shown, F.coalesce(F.length("notes"), F.lit(0)).alias("notes"),
        has(F.col("notes")).alias("has_notes"), "objects", "minutes", "complexity", "readability", "slide_type", "confidence", "characteristics", "content_summary", "counts", *extra,
    )
    return rows.groupBy("file").agg(F.array_sort(F.collect_list(struct)).alias("deck")).withColumn("samples", F.lit(samples))


def insights(found: DataFrame) -> DataFrame:
    """The same columns as ``analysis.insights`` of a table of decks."""
    deck = F.col("deck")
    n = F.size(deck).cast("long")
    start = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("length"), F.lit(0).alias("found"))

    def step(a: Column, s: Column) -> Column:
        length = F.when(a["kind"].eqNullSafe(s["slide_type"]), a["length"] + 1).otherwise(1)
        # A run counts when it gets longer than five, so once.
        new = F.when((length == 6) & (s["slide_type"] != "content_slide"), 1).otherwise(0)
        return F.struct(s["slide_type"].alias("kind"), length.alias("length"), (a["found"] + new).alias("found"))

    types = stretches(F.array_sort(F.transform(deck, lambda s: s["slide_type"])), lambda x: x)
    made = found.select(
        *found.columns, n.alias("slides"), F.map_from_entries(F.transform(types, lambda g: F.struct(F.get(g, F.lit(0)), F.size(g).cast("long")))).alias("slide_types"),
        total(deck, lambda s: s["minutes"]).alias("_m"), (total(deck, lambda s: s["complexity"]) / n).alias("_c"), (total(deck, lambda s: s["readability"]) / n).alias("_r"),
        (total(deck, lambda s: s["objects"], 0) / n).alias("avg_objects"), F.array_min(F.transform(deck, lambda s: s["objects"])).alias("_min"), F.array_max(F.transform(deck, lambda s: s["objects"])).alias("_max"),
        counted(deck, lambda s: ~s["titled"]).alias("untitled"), counted(deck, lambda s: s["has_notes"]).alias("notes_count"), total(deck, lambda s: s["notes"], 0).cast("long").alias("notes_length"),
        *(counted(deck, of_type(kinds)).alias(name) for name, kinds in analysis.COUNTED.items()),
        F.transform(F.filter(deck, lambda s: s["objects"] > 8), lambda s: s["slide_number"]).alias("_crowded"), F.aggregate(deck, start, step, lambda a: a["found"]).cast("long").alias("_runs"),
    )
    return analysis.judged(made.select("*", F.size("slide_types").cast("long").alias("_kinds"), F.array_max(F.map_values("slide_types")).alias("_most")), found.columns[1:])


def patterns(deck: Column) -> Column:
    """An array of the patterns of a deck, sorted, as ``analysis.patterns`` has them in rows."""

    def made(kind: str, name: str, sure: float, slides: Column, count: Column, examples: Column) -> Column:
        return F.struct(F.lit(kind).alias("pattern_type"), F.lit(name).alias("pattern_name"), count.cast("long").alias("occurrences"), slides.alias("slides"), examples.alias("examples"), F.lit(sure).alias("confidence")).cast(PATTERN)

    def one(when: Callable[[Column], Column], kind: str, name: str, least: int, sure: float, example: Callable[[Column], Column]) -> Column:
        return let(F.filter(deck, when), lambda own: F.when(F.size(own) >= least, made(kind, name, sure, F.transform(own, lambda s: s["slide_number"]), F.size(own), F.transform(F.slice(own, 1, 3), example))))

    single = F.array(
        one(lambda s: s["titled"] & s["numbered"], "title_structure", "numbered_titles", 3, 0.9, lambda s: s["title"]),
        one(lambda s: s["titled"] & s["asked"], "title_structure", "question_titles", 2, 0.8, lambda s: s["title"]),
        one(lambda s: s["bulleted"], "content_structure", "consistent_bullets", 5, 0.8, lambda s: F.lit("bullets")),
    )
    begun = F.array_sort(F.transform(F.filter(deck, lambda s: s["prefix"].isNotNull()), lambda s: F.struct(s["prefix"].alias("prefix"), s["slide_number"].alias("slide_number"), F.left(s["title"], F.lit(PREFIXED)).alias("title"))))
    label = lambda s: F.concat(F.lit("Prefix: '"), s["prefix"], F.lit("' - "), s["title"])
    prefixed = F.transform(F.filter(stretches(begun, lambda x: x["prefix"]), lambda g: F.size(g) >= 3), lambda g: made("title_structure", "common_prefix", 0.7, F.transform(g, lambda s: s["slide_number"]), F.size(g), F.transform(F.slice(g, 1, 3), label)))
    after = F.zip_with(deck, F.slice(deck, F.lit(2), F.greatest(F.size(deck), F.lit(1))), lambda a, b: F.concat(a["slide_type"], F.lit(" -> "), b["slide_type"]))
    pairs = F.filter(stretches(F.array_sort(F.filter(after, lambda x: x.isNotNull())), lambda x: x), lambda g: F.size(g) >= 3)
    sequences = F.transform(pairs, lambda g: made("layout_sequence", "repeated_sequence", 0.8, F.array().cast("array<int>"), F.size(g), F.slice(g, 1, 1)))
    return F.array_sort(F.concat(F.array_compact(single), prefixed, sequences))


def overview(df: DataFrame, depth: str = "basic", with_samples: bool = True) -> DataFrame:
    """One row a file: counts, duration, slide types and classifications; from ``detailed`` on its patterns; judgements only if ``comprehensive``."""
    if depth not in analysis.DEPTHS:
        raise ValueError(f"unknown depth: {depth}; known are {', '.join(analysis.DEPTHS)}")
    out = insights(decks(df, 3 if depth != "basic" else 0))
    deck = F.col("deck")
    more = [F.transform(deck, lambda s: F.struct(s["slide_number"].alias("slide_number"), s["slide_type"].alias("slide_type"), s["confidence"].alias("confidence"), s["characteristics"].alias("characteristics"))).alias("classifications")]
    if depth != "basic":
        more.append(patterns(deck).alias("patterns"))
    if with_samples:
        titles = F.filter(F.transform(F.slice(deck, 1, 5), lambda s: s["title"]), lambda t: t.isNotNull())
        more += [titles.alias("sample_titles"), F.flatten(F.transform(F.slice(deck, F.lit(1), F.col("samples")), lambda s: s["texts"])).alias("sample_texts")]
    out = out.select("*", *more).drop("deck", "samples")
    return out if depth == "comprehensive" else out.drop(*analysis.JUDGEMENTS)


def analyse(slides: DataFrame, depth: str = "detailed", text: bool = True, formats: bool = True, structure: bool = True) -> DataFrame:
    """One row a file of the view ``slides`` with the parts of an analysis that are asked for, each a column.

    structure: structure (total_slides, slide_types, sections, content_flow, structural_issues) and slide_classifications.
    text: content_patterns (none if basic) and insights (readability_score, content_density, recommendations), sample_titles
    and sample_texts. formats: formatting_analysis, the totals of the file's text elements. insights also has
    visual_balance and consistency_issues if structure and formatting are asked for too.
    """
    if depth not in analysis.DEPTHS:
        raise ValueError(f"unknown depth: {depth}; known are {', '.join(analysis.DEPTHS)}")
    totals = [formatting.totals(F.col("shapes"), F.col("tables")).alias("formats")] if formats else []
    rows = slides.select("file", "slide_number", "title", "subtitle", "notes", F.col("object_counts").alias("counts"), F.col("text_elements.text").alias("texts"), "section", *totals)
    found = insights(decks(rows, 3 if depth != "basic" else 0, extra=("section", "formats") if formats else ("section",)))
    deck, out = F.col("deck"), []
    if structure:
        flow = F.transform(deck, lambda s: s["slide_type"])
        names = F.array_distinct(F.filter(F.transform(deck, lambda s: s["section"]), lambda x: x.isNotNull()))
        out.append(F.struct(F.col("slides").alias("total_slides"), "slide_types", names.alias("sections"), flow.alias("content_flow"), F.col("issues").alias("structural_issues")).alias("structure"))
        kept = ("slide_number", "slide_type", "confidence", "characteristics", "content_summary", "counts")
        out.append(F.transform(deck, lambda s: F.struct(*(s[c].alias(c) for c in kept))).alias("slide_classifications"))
    if text:
        out.append((patterns(deck) if depth != "basic" else F.array().cast(f"array<{PATTERN}>")).alias("content_patterns"))
        judged = ["readability_score", "content_density", "recommendations"] + ["visual_balance", "consistency_issues"] * (formats and structure)
        out.append(F.struct(*judged).alias("insights"))
        out += [F.filter(F.transform(F.slice(deck, 1, 5), lambda s: s["title"]), lambda t: t.isNotNull()).alias("sample_titles"), F.flatten(F.transform(F.slice(deck, F.lit(1), F.col("samples")), lambda s: s["texts"])).alias("sample_texts")]
    if formats:
        out.append(F.struct(*(total(deck, format_total(c), 0).cast("long").alias(c) for c in formatting.TOTALS)).alias("formatting_analysis"))
    return found.select("file", *out)
