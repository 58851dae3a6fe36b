"""Analysis of presentations: kinds of slides, scores, patterns and issues.

The functions need columns file, slide_number, title, subtitle, notes, counts (a struct of the object
kinds) and texts (an array of strings); views over other tables can supply the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckhand.functions.predicates import text
from deckhand.operators.slides import KINDS, shortened, total_objects


def view(slides: DataFrame) -> DataFrame:
    return slides.select("file", "slide_number", "title", "subtitle", "notes", F.col("object_counts").alias("counts"), F.col("text_elements.text").alias("texts"))


def has(c: Column) -> Column:
    return text(c) != ""


def bullets(s: Column) -> Column:
    return sum((F.length(s) - F.length(F.replace(s, F.lit(m), F.lit(""))) for m in "•-*"), F.lit(0))


def classified(df: DataFrame) -> DataFrame:
    """slide_type, confidence and characteristics by an ordered list of rules; what rules that come close notice stays noted."""
    n = lambda k: F.coalesce(F.col(f"counts.{k}"), F.lit(0))
    total, boxes = total_objects(F.col("counts")), F.size("texts")
    content = F.array_join("texts", " ")
    kinds = sum(((n(k) > 0).cast("int") for k in KINDS), F.lit(0))
    only_title = has(F.col("title")) & ~has(F.col("subtitle")) & (n("shapes") <= 2) & (total <= 3)
    divider = has(F.col("title")) & has(F.col("subtitle")) & (total <= 4)
    dominant = [("tables", 0.5, "table"), ("charts", 0.4, "chart"), ("images", 0.4, "image")]
    bulleted = (boxes > 0) & ((bullets(content) >= 3) | (boxes >= 3))
    rules = [("title_slide", 0.9, only_title, ["minimal_content", "title_only"]), ("section_header", 0.8, divider, ["title_and_subtitle", "section_divider"])]
    rules += [(f"{name}_slide", 0.8 if name == "image" else 0.9, (n(k) > 0) & (n(k) >= total * share), [f"{name}_dominant"]) for k, share, name in dominant]
    rules += [
        ("bullet_slide", 0.7, bulleted, ["bullet_points", F.concat(boxes.cast("string"), F.lit("_text_elements"))]),
        ("blank_slide", 1.0, total == 0, ["no_content"]),
        ("mixed_content", 0.6, kinds >= 3, ["mixed_content", F.concat(kinds.cast("string"), F.lit("_content_types"))]),
    ]
    kind, sure = F.lit("content_slide"), F.lit(0.5)
    own = F.array(F.lit("standard_content"), F.when(has(F.col("title")), "has_title"))
    for name, confidence, when, notes in reversed(rules):
        kind, sure = F.when(when, name).otherwise(kind), F.when(when, confidence).otherwise(sure)
        own = F.when(when, F.array(*(F.lit(x) if isinstance(x, str) else x for x in notes))).otherwise(own)
    # A rule's count is noted if no rule before it took the slide.
    order = [r[0] for r in rules]
    place = sum((F.when(F.col("slide_type") == t, k).otherwise(0) for k, t in enumerate(order)), F.lit(0)) + F.when(F.col("slide_type") == "content_slide", len(order)).otherwise(0)
    noted = F.array(*(F.when((n(k) > 0) & (F.col("_place") >= 2 + j), F.concat(n(k).cast("string"), F.lit(f"_{k}"))) for j, (k, _, _) in enumerate(dominant)))
    out = df.withColumns({"slide_type": kind, "confidence": sure, "_own": own}).withColumn("_place", place)
    return out.withColumn("characteristics", F.array_compact(F.concat(noted, "_own"))).withColumn("content_summary", content_summary()).drop("_own", "_place")


def content_summary() -> Column:
    first = F.get("texts", F.lit(0))
    parts = [
        F.when(has(F.col("title")), F.concat(F.lit("Title: "), F.left("title", F.lit(50)))),
        F.when(has(first), F.when(F.length(first) > 100, F.concat(F.left(first, F.lit(100)), F.lit("..."))).otherwise(first)),
        *(F.when(F.col(f"counts.{k}") > 0, F.concat(F.col(f"counts.{k}").cast("string"), F.lit(f" {k}"))) for k in ("tables", "charts", "images")),
    ]
    return F.concat_ws(" | ", *parts)


def slide_scores(df: DataFrame) -> DataFrame:
    """Minutes, complexity and readability of each slide."""
    n = lambda k: F.coalesce(F.col(f"counts.{k}"), F.lit(0))
    total, size = total_objects(F.col("counts")), F.aggregate("texts", F.lit(0), lambda a, t: a + F.length(t))
    minutes = 1.0 + 0.5 * n("tables") + 0.5 * n("charts") + F.when(size > 200, 0.5).otherwise(0.0) + F.when(F.length(text(F.col("notes"))) > 100, 0.3).otherwise(0.0)
    capped = lambda x, most: F.least(x / most, F.lit(1.0))
    complexity = (capped(total, 5.0) + capped(size, 500.0) + capped(n("tables"), 2.0) + capped(n("charts"), 2.0)) / 4
    long = F.when(size <= 200, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (size - 200) / 500))
    many = F.when(F.size("texts") <= 5, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.size("texts") - 5) / 10))
    readability = (long + many + F.when(has(F.col("title")), 1.0).otherwise(0.5)) / 3
    return df.withColumns({"objects": total, "minutes": minutes, "complexity": complexity, "readability": readability})


#: Types of slides that judgements count together.
COUNTED = {"_titles": ("title_slide",), "_blanks": ("blank_slide",), "_visuals": ("table_slide", "chart_slide", "image_slide"), "_bullets": ("bullet_slide",)}


def insights(df: DataFrame) -> DataFrame:
    """One row a file: duration, scores, density, balance, notes, issues and recommendations."""
    rows = slide_scores(classified(df))
    per_file = rows.groupBy("file").agg(
        F.count("*").alias("slides"), F.sum("minutes").alias("_m"), F.avg("complexity").alias("_c"), F.avg("readability").alias("_r"), F.avg("objects").alias("avg_objects"),
        F.min("objects").alias("_min"), F.max("objects").alias("_max"), F.count_if(~has(F.col("title"))).alias("untitled"),
        F.count_if(has(F.col("notes"))).alias("notes_count"), F.coalesce(F.sum(F.length("notes")), F.lit(0)).alias("notes_length"),
        *(F.count_if(F.col("slide_type").isin(*kinds)).alias(name) for name, kinds in COUNTED.items()),
        F.array_sort(F.collect_list(F.when(F.col("objects") > 8, F.col("slide_number")))).alias("_crowded"),
    )
    kinds = rows.groupBy("file", "slide_type").agg(F.count("*").alias("n")).groupBy("file").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slide_type", "n")))).alias("slide_types"), F.count("*").alias("_kinds"), F.max("n").alias("_most"))
    repeated = runs(rows).where("length > 5 AND slide_type <> 'content_slide'").groupBy("file").agg(F.count("*").alias("_runs"))
    return judged(per_file.join(kinds, "file").join(repeated, "file", "left"))


def rounded(c: Column, digits: int = 1) -> Column:
    """A double rounded as SQL does it, by rounding so many times its value to a whole number: 7.949999999999999, which a mean of 7.95 may become, is 8.0."""
    return F.round(c * 10**digits) / 10**digits


def judged(x: DataFrame, also: list[str] | tuple = ()) -> DataFrame:
    """Scores, issues and advice from a file's counts, beside other columns."""
    share = F.col("_most") / F.col("slides")
    note = lambda when, what: F.when(when, F.lit(what) if isinstance(what, str) else what)
    issues = F.array_compact(F.array(
        note(F.col("_titles") == 0, "no title slide"), note(F.coalesce("_runs", F.lit(0)) > 0, "long run of one slide type"), note(F.col("_blanks") > 0, F.concat(F.col("_blanks").cast("string"), F.lit(" blank slides"))),
        note(F.col("slides") < 3, "very short presentation"), note(F.col("slides") > 50, "very long presentation")))
    consistency = F.array_compact(F.array(
        note((F.col("untitled") > 0) & (F.col("slides") - F.col("untitled") > F.col("untitled")), F.concat(F.col("untitled").cast("string"), F.lit(" slides without titles"))),
        note((F.col("_max") > 5 * F.col("_min")) & (F.col("_max") > 10), "large variation of content between slides")))
    readable, complex_, n = F.col("_r") * 10, F.col("_c") * 10, F.col("slides")
    crowded, inconsistent, faulty = F.size("_crowded") > 3, F.size(consistency) > 0, F.size(issues) > 0
    advice = F.array_compact(F.array(
        note(F.col("_titles") == 0, "begin with a title slide"), note(n > 30, "split into shorter presentations"),
        note(crowded, F.concat(F.lit("simplify crowded slides: "), F.array_join(F.transform("_crowded", lambda k: k.cast("string")), ", "))),
        note(inconsistent, "settle inconsistencies"), note(F.col("_bullets") > n * 0.6, "show more and list less")))
    strengths = F.array_compact(F.array(
        note(n.between(5, 20), "fitting length"), note(F.col("_kinds") >= 4, "varied slides"), note(F.col("_visuals") > n * 0.3, "much to see"), note(~faulty, "sound structure")))
    areas = F.array_compact(F.array(
        note(F.col("_bullets") > n * 0.7, "too many lists"), note(F.col("_visuals") < n * 0.2, "too little to see"), note(faulty, "structure"), note(inconsistent, "consistency")))
    return x.select(
        "file", "slides", rounded(F.col("_m")).alias("estimated_minutes"), rounded(F.col("_m") * 0.8).alias("least_minutes"), rounded(F.col("_m") * 1.2).alias("most_minutes"),
        F.when(F.col("_m") > 0, rounded(F.col("slides") / F.col("_m"), 2)).otherwise(0.0).alias("slides_per_minute"), rounded(complex_).alias("complexity_score"), rounded(readable).alias("readability_score"),
        F.when(F.col("avg_objects") <= 3, "low").when(F.col("avg_objects") <= 6, "medium").otherwise("high").alias("content_density"),
        F.when((F.col("_kinds") >= 4) & (share <= 0.7), "well_balanced").when((F.col("_kinds") >= 3) & (share <= 0.8), "balanced").when(share >= 0.9, "monotonous").otherwise("somewhat_balanced").alias("visual_balance"),
        "slide_types", "notes_count", "notes_length", F.when(F.col("notes_count") > 0, F.col("notes_length") / F.col("notes_count")).alias("notes_average"),
        issues.alias("issues"), consistency.alias("consistency_issues"), advice.alias("recommendations"), strengths.alias("strengths"), areas.alias("improvement_areas"), *also,
    )


def runs(df: DataFrame, key: list[str] | None = None, order: str = "slide_number", kind: str = "slide_type") -> DataFrame:
    """Maximal runs of equal kinds, the last one included: kind, first, length."""
    key = key or ["file"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - F.row_number().over(Window.partitionBy(*key, kind).orderBy(order))
    return df.withColumn("_island", place).groupBy(*key, kind, "_island").agg(F.min(order).alias("first"), F.count("*").alias("length")).drop("_island")


def bigrams(df: DataFrame, key: list[str], order: str, kind: str, least: int = 3) -> DataFrame:
    """Pairs of kinds that follow one another so often at least."""
    after = F.lead(kind).over(Window.partitionBy(*key).orderBy(order))
    pairs = df.select(*key, F.concat(F.col(kind), F.lit(" -> "), after).alias("sequence")).where("sequence IS NOT NULL")
    return pairs.groupBy(*key, "sequence").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)


def title_prefix(title: Column) -> Column:
    words = F.split(F.trim(title), r"(?U)\s+")
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))


def patterns(df: DataFrame) -> DataFrame:
    """file, pattern_type, pattern_name, occurrences, slides, examples, confidence.

    A slide goes out as a row for each pattern that it may be of, so slides are read once.
    """
    title = F.col("title")
    # Texts stay behind: only what patterns show goes on.
    shown = classified(df).select(
        "file", "slide_number", "slide_type", F.left("title", F.lit(50)).alias("start"), F.left("title", F.lit(30)).alias("brief"), has(title).alias("titled"), F.trim("title").rlike(r"^\d+\.").alias("numbered"),
        F.trim("title").endswith("?").alias("asked"), F.when(has(title), title_prefix(title)).alias("prefix"), (bullets(F.array_join("texts", " ")) >= 3).alias("bulleted"),
    )
    after = F.lead("slide_type").over(Window.partitionBy("file").orderBy("slide_number"))
    shown = shown.withColumn("sequence", F.concat("slide_type", F.lit(" -> "), after))
    entry = lambda when, kind, name, least, sure, of, example: F.when(when, F.struct(F.lit(kind).alias("pattern_type"), F.lit(name).alias("pattern_name"), F.lit(least).alias("least"), F.lit(sure).alias("confidence"), of.cast("string").alias("of"), example.alias("example")))
    label = F.concat(F.lit("Prefix: '"), "prefix", F.lit("' - "), "brief")
    entries = F.array_compact(F.array(
        entry(F.col("titled") & F.col("numbered"), "title_structure", "numbered_titles", 3, 0.9, F.lit(None), F.col("start")),
        entry(F.col("titled") & F.col("asked"), "title_structure", "question_titles", 2, 0.8, F.lit(None), F.col("start")),
        entry(F.col("prefix").isNotNull(), "title_structure", "common_prefix", 3, 0.7, F.col("prefix"), label),
        entry(F.col("bulleted"), "content_structure", "consistent_bullets", 5, 0.8, F.lit(None), F.lit("bullets")),
        entry(F.col("sequence").isNotNull(), "layout_sequence", "repeated_sequence", 3, 0.8, F.col("sequence"), F.col("sequence"))))
    rows = shown.select("file", "slide_number", F.explode(entries).alias("e")).select("file", "slide_number", "e.*")
    found = rows.groupBy("file", "pattern_type", "pattern_name", "of", "least", "confidence").agg(
        F.count("*").alias("occurrences"), F.array_sort(F.collect_list(F.struct("slide_number", "example"))).alias("own")
    )
    sequence = F.col("pattern_type") == "layout_sequence"
    slides = F.when(sequence, F.array().cast("array<int>")).otherwise(F.filter(F.transform("own", lambda x: x["slide_number"]), lambda n: n.isNotNull()))
    examples = F.when(sequence, F.array("of")).otherwise(F.slice(F.transform("own", lambda x: x["example"]), 1, 3))
    return found.where(F.col("occurrences") >= F.col("least")).select("file", "pattern_type", "pattern_name", "occurrences", slides.alias("slides"), examples.alias("examples"), "confidence")


def sample(df: DataFrame, titles: int = 5, slides: int = 3, elements: int = 2) -> DataFrame:
    """The first titles and text elements of each file."""
    w = Window.partitionBy("file").orderBy("slide_number")
    ranked = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(titles, slides))
    return ranked.select("file", "slide_number", F.when(F.col("_k") <= titles, F.col("title")).alias("title"), F.when(F.col("_k") <= slides, F.transform(F.slice("texts", 1, elements), lambda t: shortened(t, 100))).alias("texts"))


#: How much an overview holds.
DEPTHS = ("basic", "detailed", "comprehensive")
JUDGEMENTS = ("readability_score", "content_density", "visual_balance", "consistency_issues", "recommendations", "strengths", "improvement_areas")


def overview(df: DataFrame, depth: str = "basic", with_samples: bool = True) -> DataFrame:
    """One row a file, read once (see ``decks.overview``)."""
    from deckhand.operators import decks

    return decks.overview(df, depth, with_samples)


def with_formatting(overviews: DataFrame, summaries: DataFrame) -> DataFrame:
    """An overview with the formatting summary of the same file in a struct; null if it has no text."""
    kept = [c for c in summaries.columns if c != "file"]
    return overviews.join(summaries.select("file", F.struct(*kept).alias("formatting")), "file", "left")
