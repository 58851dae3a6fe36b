"""Formatting of text: segments with exact offsets, summaries and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckhand.functions.arrays import let, stretches
from deckhand.functions.predicates import combined, matches, text
from deckhand.sources.ooxml import PARAS

#: The kinds of formatting and of groupings.
TYPES = ("bold", "italic", "underlined", "highlighted", "strikethrough", "hyperlinks", "font_sizes", "font_colors")
GROUPINGS = ("by_slide", "by_formatting_type", "by_content_type", "by_color", "by_font_size", "none")
#: Font sizes, in points, of text that states none: titles, subtitles, others.
DEFAULT_SIZES = {"title": 44.0, "ctrTitle": 44.0, "subTitle": 24.0}


def running_offset(length: Column, key: list[str], order: list[str]) -> Column:
    """Where a piece starts in the text that all pieces of a key make in order."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(before), F.lit(0))


def pieces(shapes: Column, tables: Column) -> Column:
    """Shapes, then table cells of a slide as one array, so that a slide is read once for both: container, a, b, c (their place), ph_type, paras."""
    text = lambda x: x.cast("string").alias("ph_type")
    place = lambda kind, a, b, c: (F.lit(kind).alias("container"), a.alias("a"), b.alias("b"), c.alias("c"))
    of_shapes = F.transform(shapes, lambda s, k: F.struct(*place("shape", k, F.lit(0), F.lit(0)), text(s["ph_type"]), s["paras"].alias("paras")))
    of_row = lambda r, a, b: F.transform(r, lambda x, c: F.struct(*place("table", a, b, c), text(F.lit(None)), x["paras"].alias("paras")))
    of_cells = F.flatten(F.transform(tables, lambda t, a: F.flatten(F.transform(t["rows"], lambda r, b: of_row(r, a, b)))))
    return F.concat(*(F.coalesce(x, F.array().cast(f"array<struct<container:string,a:int,b:int,c:int,ph_type:string,paras:{PARAS}>>")) for x in (of_shapes, of_cells)))


def runs(slides: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One row a run of shapes, then of table cells, with its formatting and its offset in the slide's text.

    The slide's complete text is all runs in order; a paragraph, shape or cell after the first starts after
    one space, which counts. also: "url" adds the target of a run's link by the slide's own relations, null if none explains it.
    """
    if bad := set(also) - {"url"}:
        raise ValueError(f"unknown columns: {', '.join(sorted(bad))}")
    own = ["file", "slide_number", *(["rels"] if also else [])]
    every = slides.select(*own, F.explode(pieces(F.col("shapes"), F.col("tables"))).alias("piece")).select(*own, "piece.*")
    every = every.select(*own, "container", "a", "b", "c", "ph_type", F.posexplode("paras").alias("para", "p")).select("*", F.posexplode("p").alias("run", "r"))
    order = ["container", "a", "b", "c", "para", "run"]
    flat = every.select(
        "file", "slide_number", *order, "ph_type", F.coalesce("r.text", F.lit("")).alias("text"), F.col("r.size").alias("size"), F.col("r.color").alias("color"),
        *(F.coalesce(f"r.{c}", F.lit(False)).alias(c) for c in ("bold", "italic", "underline", "strike")), F.col("r.highlight").alias("highlight"), F.col("r.rid").alias("rid"),
        *([F.get(F.filter("rels", lambda l: (l["type"] == "hyperlink") & (l["rid"] == F.col("r.rid"))), F.lit(0))["target"].alias("url")] if also else []),
    )
    first = F.row_number().over(Window.partitionBy("file", "slide_number").orderBy(*order)) == 1
    flat = flat.withColumn("gap", F.when((F.col("run") == 0) & ~first, 1).otherwise(0))
    start = running_offset(F.length("text") + F.col("gap"), ["file", "slide_number"], order) + F.col("gap")
    return flat.withColumn("start", start).drop("gap")


def run_has(kind: str) -> Column:
    """Whether a run has a kind of formatting."""
    found = {
        "bold": F.col("bold"), "italic": F.col("italic"), "underlined": F.col("underline"), "strikethrough": F.col("strike"),
        "highlighted": F.col("highlight").isNotNull(), "hyperlinks": F.col("rid").isNotNull(), "font_sizes": F.col("size").isNotNull(), "font_colors": F.col("color").isNotNull(),
    }
    if kind not in found:
        raise ValueError(f"unknown kind of formatting: {kind}; known are {', '.join(TYPES)}")
    return found[kind]


def segments(slides: DataFrame, kind: str) -> DataFrame:
    """Runs with a kind of formatting: text, start, end, and the size, color or link that they have."""
    found = runs(slides, ("url",) if kind == "hyperlinks" else ()).where(run_has(kind) & (F.col("text") != ""))
    if kind == "hyperlinks":
        info = F.coalesce("url", "rid")
    else:
        info = {"font_sizes": F.col("size").cast("string"), "font_colors": F.col("color"), "highlighted": F.col("highlight")}.get(kind, F.lit(None).cast("string"))
    return found.select("file", "slide_number", "text", "start", (F.col("start") + F.length("text")).alias("end"), info.alias("info"))


def extraction_summary(slides: DataFrame, kind: str) -> DataFrame:
    hits = segments(slides, kind).groupBy("file").agg(F.countDistinct("slide_number").alias("slides_with_formatting"), F.count("*").alias("total_segments"))
    return slides.groupBy("file").agg(F.count("*").alias("slides_analyzed")).join(hits, "file", "left").na.fill(0)


def paragraphs(found: Column) -> Column:
    """Text of an array of para, run, text in order: runs directly after one another, paragraphs with text joined by a space."""
    lines = F.transform(stretches(found, lambda x: x["para"]), lambda g: F.array_join(F.transform(g, lambda x: x["text"]), ""))
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), " ")


#: What the totals of text elements count.
TOTALS = ("total_elements", "formatted_elements", "bold_count", "italic_count", "underline_count", "strikethrough_count", "highlight_count", "colored_elements", "hyperlink_elements")


def totals(shapes: Column, tables: Column) -> Column:
    """A slide's totals of its text elements, without a row for each run."""
    nothing = lambda c: F.coalesce(c, F.array().cast(f"array<{PARAS}>"))
    cells = F.flatten(F.transform(tables, lambda t: F.flatten(t["rows"])))
    every = F.concat(nothing(F.transform(shapes, lambda s: s["paras"])), nothing(F.transform(cells, lambda c: c["paras"])))

    def element(paras: Column) -> Column:
        return let(F.flatten(paras), lambda r: of_runs(paras, r))

    def of_runs(paras: Column, r: Column) -> Column:
        shown = F.exists(paras, lambda p: F.trim(F.array_join(F.transform(p, lambda x: x["text"]), "")) != "")
        flagged = lambda c: F.size(F.filter(r, lambda x: x[c] & (F.coalesce(x["text"], F.lit("")) != ""))).alias(c)
        given = lambda c: F.size(F.filter(r, lambda x: x[c].isNotNull())).alias(c)
        return F.struct(shown.alias("shown"), *map(flagged, ("bold", "italic", "underline", "strike")), *map(given, ("highlight", "color", "rid")))

    kept = F.filter(F.transform(every, element), lambda e: e["shown"] | (e["rid"] > 0))
    counts = {"bold_count": "bold", "italic_count": "italic", "underline_count": "underline", "strikethrough_count": "strike", "highlight_count": "highlight"}
    number = lambda own, when: F.size(F.filter(own, when)).cast("int")
    added = lambda own, c: F.aggregate(own, F.lit(0), lambda a, e: a + e[c])
    return let(kept, lambda own: F.struct(
        F.size(own).alias("total_elements"), number(own, lambda e: sum((e[c] for c in ("bold", "italic", "underline", "strike", "highlight", "color", "rid")), F.lit(0)) > 0).alias("formatted_elements"),
        *(added(own, c).alias(name) for name, c in counts.items()),
        number(own, lambda e: e["color"] > 0).alias("colored_elements"), number(own, lambda e: e["rid"] > 0).alias("hyperlink_elements")))


def elements(slides: DataFrame) -> DataFrame:
    """One row a text element with its formatting: counts of flagged runs, and distinct sizes, colors and links."""
    flagged = lambda c: F.count_if(F.col(c) & (F.col("text") != ""))
    size = F.coalesce(*(F.when(F.col("ph_type") == k, F.lit(v)) for k, v in DEFAULT_SIZES.items()), F.lit(18.0))
    content = F.when(F.col("container") == "table", "tables").when(F.col("ph_type").isin("title", "ctrTitle", "subTitle"), "titles").otherwise("text_boxes")
    rows = runs(slides).withColumn("content_type", content)
    key = ["file", "slide_number", "container", "a", "b", "c"]
    out = rows.groupBy(*key, "content_type").agg(
        paragraphs(F.array_sort(F.collect_list(F.struct("para", "run", "text")))).alias("text_content"),
        flagged("bold").alias("bold_count"), flagged("italic").alias("italic_count"), flagged("underline").alias("underline_count"), flagged("strike").alias("strikethrough_count"),
        F.count_if(F.col("highlight").isNotNull()).alias("highlight_count"),
        F.array_sort(F.collect_set(F.coalesce("size", size))).alias("font_sizes"), F.array_sort(F.collect_set("color")).alias("font_colors"), F.array_sort(F.collect_set("rid")).alias("hyperlinks"),
    )
    some = (F.col("bold_count") + F.col("italic_count") + F.col("underline_count") + F.col("strikethrough_count") + F.col("highlight_count") > 0) | (F.size("font_colors") > 0) | (F.size("hyperlinks") > 0)
    return out.where((F.trim("text_content") != "") | (F.size("hyperlinks") > 0)).withColumn("has_formatting", some)


def average_size(sizes: Column) -> Column:
    return F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes))


FLAGS = {
    "bold": "bold_count > 0", "italic": "italic_count > 0", "underline": "underline_count > 0", "highlight": "highlight_count > 0",
    "strikethrough": "strikethrough_count > 0", "color": "size(font_colors) > 0", "hyperlink": "size(hyperlinks) > 0",
}


def filtered(df: DataFrame, formatting_types: list[str] | None = None, content_types: list[str] | None = None, text_contains: str | None = None, text_patterns: list[str] | None = None,
             slide_numbers: list[int] | None = None, min_font_size: float | None = None, max_font_size: float | None = None, colors: list[str] | None = None) -> DataFrame:
    """Elements that meet all filters; of a list any entry will do; an element without sizes passes the size range."""
    parts = []
    if slide_numbers:
        parts.append(F.col("slide_number").isin(slide_numbers))
    if content_types and "all" not in content_types:
        parts.append(F.col("content_type").isin(content_types))
    if formatting_types and "all" not in formatting_types:
        parts.append(combined([F.size("font_sizes") > 0 if t == "font_size" else F.expr(FLAGS[t]) for t in formatting_types], "OR"))
    if text_contains:
        parts.append(F.lower("text_content").contains(text_contains.lower()))
    if text_patterns:
        parts.append(combined([matches(F.col("text_content"), p) for p in text_patterns], "OR"))
    size = average_size(F.col("font_sizes"))
    if min_font_size is not None:
        parts.append(size.isNull() | (size >= min_font_size))
    if max_font_size is not None:
        parts.append(size.isNull() | (size <= max_font_size))
    if colors:
        parts.append(F.arrays_overlap("font_colors", F.array(*map(F.lit, colors))))
    return df.where(combined(parts))


#: What elements are counted by in a summary, and the columns of the counts.
DISTRIBUTIONS = {"slide": "slide_distribution", "content_type": "content_type_distribution", "size": "font_size_distribution", "color": "color_distribution"}
FLAGGED = ("bold_count", "italic_count", "underline_count", "strikethrough_count", "highlight_count")


def summary(df: DataFrame) -> DataFrame:
    """One row a file: totals of its elements, and how many there are by slide, content type, size and color.

    An element goes out as a row for each thing that it counts for and one for the totals, so elements are read once.
    """
    fact = lambda by, key, size=None, color=None: F.struct(F.lit(by).alias("by"), key.cast("string").alias("k"), (F.lit(None) if size is None else size).cast("double").alias("size"), (F.lit(None) if color is None else color).cast("string").alias("color"))
    facts = F.concat(
        F.array(fact("all", F.lit(None)), fact("slide", F.col("slide_number")), fact("content_type", F.col("content_type"))),
        F.transform("font_sizes", lambda x: fact("size", x, size=x)), F.transform("font_colors", lambda x: fact("color", x, color=x)),
    )
    some = {"formatted_elements": F.col("has_formatting"), "colored_elements": F.size("font_colors") > 0, "hyperlink_elements": F.size("hyperlinks") > 0}
    rows = df.select("file", F.explode(facts).alias("f"), *FLAGGED, *(c.alias(n) for n, c in some.items())).select("file", "f.*", *FLAGGED, *some)
    counts = rows.groupBy("file", "by", "k", "size", "color").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in FLAGGED), *(F.count_if(c).alias(c) for c in some))
    whole, listed = F.col("by") == "all", lambda by: F.array_sort(F.collect_list(F.when((F.col("by") == by) & F.col("k").isNotNull(), F.struct("k", "n"))))
    total = lambda c: F.sum(F.when(whole, F.col(c))).alias(c)
    out = counts.groupBy("file").agg(
        F.sum(F.when(whole, F.col("n"))).alias("total_elements"), total("formatted_elements"), *map(total, FLAGGED), total("colored_elements"), total("hyperlink_elements"),
        F.array_sort(F.collect_list("size")).alias("font_sizes"), F.array_sort(F.collect_list("color")).alias("font_colors"), *(listed(by).alias(name) for by, name in DISTRIBUTIONS.items()),
    )
    return out.withColumns({name: F.when(F.size(name) > 0, F.map_from_entries(name)) for name in DISTRIBUTIONS.values()})


def histogram(df: DataFrame, by: str) -> DataFrame:
    """How many elements each slide, content type, color or size has; an element counts for each of its colors or sizes."""
    column = {"slide": F.col("slide_number"), "content_type": F.col("content_type"), "color": F.explode("font_colors"), "size": F.explode("font_sizes")}[by]
    return df.select("file", column.alias(by)).groupBy("file", by).agg(F.count("*").alias("n"))


def groups(df: DataFrame, grouping: str) -> DataFrame:
    """Elements with the group or groups they are in."""
    keys = {
        "by_slide": F.array(F.concat(F.lit("slide_"), F.col("slide_number").cast("string"))),
        "by_content_type": F.array("content_type"),
        "by_formatting_type": F.filter(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in FLAGS.items())), lambda x: x.isNotNull()),
        "by_color": F.when(F.size("font_colors") > 0, F.col("font_colors")).otherwise(F.array(F.lit("no_color"))),
        "by_font_size": F.array(F.coalesce(F.concat(F.lit("size_"), average_size(F.col("font_sizes")).cast("int").cast("string")), F.lit("no_size_info"))),
        "none": F.array(F.lit("all")),
    }
    if grouping not in keys:
        raise ValueError(f"unknown grouping: {grouping}; known are {', '.join(GROUPINGS)}")
    return df.select("*", F.explode(keys[grouping]).alias("group_key"))


def marked_up(paras: Column) -> Column:
    """Runs with b, i, u, s and mark, later ones outermost."""

    def run(r: Column) -> Column:
        out = F.coalesce(r["text"], F.lit(""))
        for flag, tag in ((r["bold"], "b"), (r["italic"], "i"), (r["underline"], "u"), (r["strike"], "s"), (r["highlight"].isNotNull(), "mark")):
            out = F.when(flag, F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
        return out

    return F.array_join(F.transform(paras, lambda p: F.array_join(F.transform(p, run), "")), " ")


def blank(c: Column) -> Column:
    return F.trim(text(c)) == ""
