"""Registered queries over decks that hold the rarer cases: formatted, filled and spanning cells, blank headers, several
tables a slide, groups, media, every layout and kind of slide, numbered and asking titles, notes that no slide names,
threaded comments and colors of the scheme.

Eight conversations make a deck and a turn makes a slide, of a kind that follows from its place; SQL on the
conversations says what each operator must return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckhand.operators import analysis, formatting, slides, tables
from deckhand.plans.package_queries import tasks
from deckhand.sources import ooxml, storage, writer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Slides with their kind k, and what goes with a kind.
V = """SELECT *, CASE k WHEN 1 THEN n || '. Numbered' WHEN 2 THEN 'What is ' || role || '?' WHEN 3 THEN 'Tables of ' || n WHEN 4 THEN 'Charts of ' || n WHEN 5 THEN 'Pictures of ' || n
      WHEN 6 THEN 'Two sides' WHEN 7 THEN 'Grouped ' || n WHEN 9 THEN 'Noted ' || role END AS title
    FROM (SELECT 'varied-' || deck || '.pptx' AS file, n, (deck + n) % 10 AS k, role, length(text) AS size FROM
      (SELECT conv_id // 8 AS deck, role, text, row_number() OVER (PARTITION BY conv_id // 8 ORDER BY conv_id, turn, role, text) AS n FROM conversations))"""
KINDS = f"""SELECT v.*, CASE WHEN v.k = 3 AND size % 2 = 1 THEN 1 ELSE w.charts END AS charts, CASE WHEN v.k = 5 THEN 1 + size % 2 ELSE 0 END AS media, w.* EXCLUDE (k, charts, slide_type, confidence, noticed),
      CASE WHEN v.k = 3 AND size % 2 = 1 THEN 'mixed_content' ELSE slide_type END AS slide_type, CASE WHEN v.k = 3 AND size % 2 = 1 THEN 0.6 ELSE confidence END AS confidence,
      CASE WHEN v.k = 3 AND size % 2 = 1 THEN '2_tables,1_charts,mixed_content,4_content_types' ELSE noticed END AS noticed
    FROM ({V}) v JOIN (VALUES (0, 0, 0, 0, 0, 0, 0, 0, 'blank', 'blank_slide', 1.0, 'no_content'), (1, 1, 1, 0, 0, 0, 0, 0, 'titleOnly', 'title_slide', 0.9, 'minimal_content,title_only'),
      (2, 2, 2, 0, 0, 0, 0, 0, 'titleOnly', 'section_header', 0.8, 'title_and_subtitle,section_divider'), (3, 1, 1, 0, 2, 0, 0, 0, 'titleOnly', 'table_slide', 0.9, '2_tables,table_dominant'),
      (4, 1, 1, 0, 0, 2, 0, 0, 'titleOnly', 'chart_slide', 0.9, '2_charts,chart_dominant'), (5, 1, 1, 3, 0, 0, 0, 0, 'titleOnly', 'image_slide', 0.8, '3_images,image_dominant'),
      (6, 3, 3, 0, 0, 0, 0, 0, 'twoContent', 'bullet_slide', 0.7, 'bullet_points,3_text_elements'), (7, 1, 1, 0, 0, 0, 2, 1, 'titleOnly', 'mixed_content', 0.6, 'mixed_content,4_content_types'),
      (8, 1, 1, 0, 0, 0, 0, 0, 'contentOnly', 'content_slide', 0.5, 'standard_content'), (9, 2, 2, 0, 0, 0, 0, 0, 'titleAndContent', 'content_slide', 0.5, 'standard_content,has_title'))
      w(k, shapes, text_boxes, images, tables, charts, connectors, groups, layout_type, slide_type, confidence, noticed) ON v.k = w.k"""
#: Cells, compacted: table, row, place, header, and what a cell holds; words with @ stand for what depends on the slide.
CELLS = f"""SELECT file, n, size, t, t * CASE WHEN size % 2 = 1 THEN 2 ELSE 1 END AS frame, r, c, header, row_span, col_span, fill, mark,
      CASE v WHEN '@role' THEN role WHEN '@size' THEN size::VARCHAR WHEN '@mark' THEN role || ' <&> "' || n || '''' WHEN '@rest' THEN (size % 7)::VARCHAR ELSE v END AS value,
      v = '@role' AND t = 0 AND size % 2 = 0 AS bold, v = '@size' AND size % 3 = 0 AS italic, v = '@mark' AS underline, v = '@mark' AND size % 2 = 1 AS strike,
      CASE WHEN v = '@size' AND size % 5 < 2 THEN '#FF0000' WHEN v = 'wide' THEN 'accent2' END AS color
    FROM ({V}), (VALUES (0, 0, 0, 'item', 'item', 1, 1, NULL, NULL), (0, 0, 1, 'Column 2', '', 1, 1, NULL, NULL), (0, 0, 2, 'note', 'note', 1, 1, NULL, NULL), (0, 1, 0, 'item', '@role', 1, 1, NULL, NULL),
      (0, 1, 1, 'Column 2', '@size', 1, 1, NULL, NULL), (0, 1, 2, 'note', '@mark', 1, 1, NULL, NULL), (0, 2, 0, 'item', 'tall', 2, 1, '#00FF00', NULL), (0, 2, 1, 'Column 2', 'marked', 1, 1, NULL, '#FFFF00'),
      (0, 2, 2, 'note', '', 1, 1, NULL, NULL), (0, 3, 0, 'item', '', 1, 1, NULL, NULL), (0, 3, 1, 'Column 2', 'wide', 1, 2, 'accent1', NULL), (1, 0, 0, 'role', 'role', 1, 1, NULL, NULL),
      (1, 0, 1, 'size', 'size', 1, 1, NULL, NULL), (1, 1, 0, 'role', '@role', 1, 1, NULL, NULL), (1, 1, 1, 'size', '@rest', 1, 1, NULL, NULL)) w(t, r, c, header, v, row_span, col_span, fill, mark) WHERE k = 3"""


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def varied_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slides of the decks, in the writer's form."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    deck = F.floor(F.col("conv_id") / 8)
    n = F.row_number().over(Window.partitionBy(deck).orderBy("conv_id", "turn", "role", "text"))
    rows = rows.select(deck.alias("deck"), n.alias("n"), "role", F.length("text").alias("size")).withColumn("k", (F.col("deck") + F.col("n")) % 10)
    k, size, role, n = F.col("k"), F.col("size"), F.col("role"), F.col("n").cast("string")
    no, off = F.lit(None).cast("string"), F.lit(False)

    def run(text, bold=off, italic=off, underline=off, strike=off, color=no, highlight=no):
        return F.struct(text.alias("text"), bold.alias("bold"), italic.alias("italic"), underline.alias("underline"), strike.alias("strike"), F.lit(None).cast("int").alias("size"), color.alias("color"), highlight.alias("highlight"), no.alias("url"))

    def cell(text, fill=no, row_span=1, col_span=1, covered=False, **look):
        own = run(text if not isinstance(text, str) else F.lit(text), **look)
        return F.struct(own.alias("run"), fill.alias("fill"), F.lit(row_span).alias("row_span"), F.lit(col_span).alias("col_span"), F.lit(covered).alias("covered"))

    mark = F.concat(role, F.lit(' <&> "'), n, F.lit("'"))
    first = F.array(
        F.array(cell("item"), cell(""), cell("note")),
        F.array(cell(role, bold=size % 2 == 0), cell(size.cast("string"), italic=size % 3 == 0, color=F.when(size % 5 < 2, "FF0000")), cell(mark, underline=F.lit(True), strike=size % 2 == 1)),
        F.array(cell("tall", F.lit("00FF00"), 2), cell("marked", highlight=F.lit("FFFF00")), cell("")),
        F.array(cell("", covered=True), cell("wide", F.lit("accent1"), 1, 2, color=F.lit("accent2"))),
    )
    second = F.array(F.array(cell("role"), cell("size")), F.array(cell(role), cell((size % 7).cast("string"))))
    titles = {1: F.concat(n, F.lit(". Numbered")), 2: F.concat(F.lit("What is "), role, F.lit("?")), 3: F.concat(F.lit("Tables of "), n), 4: F.concat(F.lit("Charts of "), n),
              5: F.concat(F.lit("Pictures of "), n), 6: F.lit("Two sides"), 7: F.concat(F.lit("Grouped "), n), 9: F.concat(F.lit("Noted "), role)}
    title = F.coalesce(*(F.when(k == i, t) for i, t in titles.items()))
    bodies = F.when(k == 6, F.array(run(F.lit("left")), run(F.lit("right")))).when(k == 8, F.array(run(F.lit("only body")))).when(k == 9, F.array(run(F.concat(role, F.lit(" accent")), color=F.lit("accent3"))))
    return rows.select(
        F.concat(F.lit("varied-"), F.col("deck").cast("string"), F.lit(".pptx")).alias("file"), F.col("n").alias("slide_number"), title.alias("title"), F.when(k == 2, F.concat(F.lit("part "), n)).alias("subtitle"),
        bodies.alias("bodies"), F.when(k == 3, F.array(first, second)).alias("tables"), ((k == 3) & (size % 2 == 1)).alias("parted"), F.when(k == 5, 3).alias("pictures"), F.when(k == 5, 1 + size % 2).alias("videos"),
        F.when(k == 4, 2).alias("charts"), F.when(k == 7, 2).alias("connectors"), F.when(k == 7, F.array(F.concat(F.lit("inner "), role))).alias("grouped"), F.when(k == 9, F.concat(F.lit("said by "), role)).alias("notes"),
        F.when((k == 9) & (size % 3 == 1), F.col("n")).when((k == 9) & (size % 3 == 2), F.col("n") + 1).alias("notes_of"), F.when(k == 8, F.concat(role, F.lit(" & co"))).alias("threaded"),
    )


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slides.slides(ooxml.parsed(writer.varied_of(varied_slides(spark, sf_dir), tasks(spark, sf_dir))))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(view(spark, sf_dir))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


AT = "file, n AS slide_number, t::BIGINT AS table_index"
OBJECTS = ", ".join(f"{c}::BIGINT AS {c}" for c in slides.KINDS)


@query("varied_cells", f"""SELECT {AT}, frame::BIGINT AS frame, r::BIGINT AS row, c::BIGINT AS logical_col, header, value, row_span::BIGINT AS row_span, col_span::BIGINT AS col_span, bold, italic, underline,
    strike AS strikethrough, mark IS NOT NULL AS highlight, coalesce(color, '') AS colors, fill FROM ({CELLS})""")  # fmt: skip
def varied_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir).drop("rels", "phys_col", "border", "paras").withColumn("colors", F.array_join("colors", ","))
    return longs(found, "slide_number", "table_index", "frame", "row", "logical_col", "row_span", "col_span")


@query("varied_row_col_formatted", f"""SELECT {AT}, r::BIGINT AS row, c::BIGINT AS col, CASE WHEN strike THEN '~~' ELSE '' END || CASE WHEN underline THEN '<u>' ELSE '' END || CASE WHEN italic THEN '*' ELSE '' END || CASE WHEN bold THEN '**' ELSE '' END
    || value || CASE WHEN bold THEN '**' ELSE '' END || CASE WHEN italic THEN '*' ELSE '' END || CASE WHEN underline THEN '</u>' ELSE '' END || CASE WHEN strike THEN '~~' ELSE '' END AS value FROM ({CELLS})""")  # fmt: skip
def varied_row_col_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(tables.extract(view(spark, sf_dir), "row_col_formattedvalue"), "slide_number", "table_index", "row", "col")


ESCAPED = "replace(replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
MARKED = f"""CASE WHEN mark IS NOT NULL THEN '<span style="background-color:' || mark || '">' ELSE '' END || CASE WHEN color IS NOT NULL THEN '<span style="color:' || color || '">' ELSE '' END || CASE WHEN strike THEN '<s>' ELSE '' END || CASE WHEN underline THEN '<u>' ELSE '' END
    || CASE WHEN italic THEN '<em>' ELSE '' END || CASE WHEN bold THEN '<strong>' ELSE '' END || {ESCAPED} || CASE WHEN bold THEN '</strong>' ELSE '' END || CASE WHEN italic THEN '</em>' ELSE '' END
    || CASE WHEN underline THEN '</u>' ELSE '' END || CASE WHEN strike THEN '</s>' ELSE '' END || CASE WHEN color IS NOT NULL THEN '</span>' ELSE '' END || CASE WHEN mark IS NOT NULL THEN '</span>' ELSE '' END"""


def html_sql(inner: str) -> str:
    tag = "CASE WHEN r = 0 THEN 'th' ELSE 'td' END"
    cell = f"""'<' || {tag} || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END || CASE WHEN row_span > 1 THEN ' rowspan="' || row_span || '"' ELSE '' END
      || CASE WHEN fill IS NOT NULL THEN ' style="background-color:' || fill || '"' ELSE '' END || '>' || {inner} || '</' || {tag} || '>'"""
    return f"""WITH w AS (SELECT file, n, t, r, string_agg({cell}, '' ORDER BY c) AS tr FROM ({CELLS}) GROUP BY ALL)
    SELECT {AT}, '<table>' || string_agg('<tr>' || tr || '</tr>', '' ORDER BY r) || '</table>' AS html FROM w GROUP BY file, n, t"""


for _name, _format, _inner in (("varied_simple_html", "simple_html", ESCAPED), ("varied_table_html", "html", MARKED)):
    query(_name, html_sql(_inner))(lambda spark, sf_dir, form=_format: longs(tables.extract(view(spark, sf_dir), form), "slide_number", "table_index"))


@query("varied_structured", f"""SELECT {AT}, string_agg(header, ',' ORDER BY c) FILTER (r = 0) AS headers, (max(r) + 1)::BIGINT AS rows, count(DISTINCT c) AS columns, count(*) AS cells, count(*) FILTER (trim(value) <> '') AS non_empty_cells,
    bool_or(bold OR italic OR mark IS NOT NULL) AS has_formatting, string_agg(value || ':' || bold || ':' || italic || ':' || underline || ':' || strike || ':' || row_span || ':' || col_span || ':' || coalesce(color, ''), '|' ORDER BY r, c) AS held FROM ({CELLS}) GROUP BY file, n, t""")  # fmt: skip
def varied_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.concat_ws(":", c["value"], *(c[x].cast("string") for x in ("bold", "italic", "underline", "strikethrough", "row_span", "col_span")), F.array_join(c["colors"], ","))
    found = tables.extract(view(spark, sf_dir)).withColumns({"headers": F.array_join("headers", ","), "held": F.array_join(F.transform("cells", shown), "|")})
    return longs(found.withColumn("cells", F.size("cells")), "slide_number", "table_index", "rows", "cells")


@query("varied_tables_by_slide", f"SELECT file, n AS slide_number, 2::BIGINT AS tables, 'item,Column 2,note;role,size' AS headers, '4;2' AS rows, 'item,,note,' || role || ';role,size,' || role || ',' || (size % 7) AS held FROM ({V}) WHERE k = 3")
def varied_tables_by_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = lambda f: F.array_join(F.transform("tables", f), ";")
    found = tables.extract(view(spark, sf_dir), "grouped_by_slide").select(
        "file", "slide_number", F.size("tables").alias("count"), each(lambda t: F.array_join(t["headers"], ",")).alias("headers"), each(lambda t: t["rows"].cast("string")).alias("rows"),
        each(lambda t: F.array_join(F.transform(F.slice(t["cells"], 1, 4), lambda c: c["value"]), ",")).alias("held"),
    )
    return longs(found.withColumnRenamed("count", "tables"), "slide_number", "tables")


@query("varied_flat", f"""SELECT {AT}, r::BIGINT AS row, max(value) FILTER (header = 'item') AS item, max(value) FILTER (header = 'Column 2') AS second, bool_or(bold) FILTER (header = 'item') AS item_bold, bool_or(italic) FILTER (header = 'Column 2') AS second_italic,
    bool_or(mark IS NOT NULL) FILTER (header = 'Column 2') AS second_highlight, max(color) FILTER (header = 'Column 2') AS second_color FROM ({CELLS}) WHERE r > 0 GROUP BY file, n, t, r""")  # fmt: skip
def varied_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.flat(cells(spark, sf_dir), ["item", "Column 2"])
    named = [F.col(f"Column 2{c}").alias(f"second{c}") for c in ("", "_italic", "_highlight", "_color")]
    return longs(found.select("file", "slide_number", "table_index", "row", "item", "item_bold", *named), "slide_number", "table_index", "row")


@query("varied_flat_rows", f"SELECT {AT}, r::BIGINT AS row, header, value, bold, italic, mark IS NOT NULL AS highlight, color FROM ({CELLS}) WHERE r > 0")
def varied_flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the maps of rows, with its formatting."""
    rows = tables.extract(view(spark, sf_dir), "flat").select("file", "slide_number", "table_index", "row", "formatting", F.explode("values").alias("header", "value"))
    look = F.element_at("formatting", F.col("header"))
    return longs(rows.select("file", "slide_number", "table_index", "row", "header", "value", *(look[c].alias(c) for c in ("bold", "italic", "highlight", "color"))), "slide_number", "table_index", "row")


@query("varied_totals", f"""SELECT count(DISTINCT (file, n, t)) AS total_tables, count(DISTINCT (file, n, t, r)) AS total_rows, count(DISTINCT (file, n)) AS slides_with_tables, count(*) FILTER (bold) AS bold_cells, count(*) FILTER (italic) AS italic_cells,
    count(*) FILTER (mark IS NOT NULL) AS highlight_cells FROM ({CELLS})""")  # fmt: skip
def varied_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.totals(cells(spark, sf_dir))


@query("varied_objects", f"SELECT file, n AS slide_number, layout_type, {OBJECTS} FROM ({KINDS})")
def varied_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of all five kinds, and all eight kinds of objects."""
    return longs(view(spark, sf_dir).select("file", "slide_number", "layout_type", "object_counts.*"), "slide_number", *slides.KINDS)


@query("varied_classified", f"SELECT file, n AS slide_number, slide_type, confidence::DOUBLE AS confidence, noticed AS characteristics FROM ({KINDS})")
def varied_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of all nine types."""
    found = analysis.classified(analysis.view(view(spark, sf_dir)))
    return longs(found.select("file", "slide_number", "slide_type", F.col("confidence").cast("double").alias("confidence"), F.array_join("characteristics", ",").alias("characteristics")), "slide_number")


@query("varied_patterns", f"""WITH v AS ({KINDS}), p AS (SELECT file, n, title, string_split(title, ' ') AS w FROM v WHERE title IS NOT NULL),
    s AS (SELECT file, slide_type || ' -> ' || lead(slide_type) OVER (PARTITION BY file ORDER BY n) AS sequence FROM v),
    f AS (SELECT file, 'title_structure' AS pattern_type, 'numbered_titles' AS pattern_name, list(n ORDER BY n) AS places, list(left(title, 50) ORDER BY n) AS told, count(*) AS occurrences, 0.9 AS confidence FROM v WHERE k = 1 GROUP BY file HAVING count(*) >= 3
      UNION ALL SELECT file, 'title_structure', 'question_titles', list(n ORDER BY n), list(left(title, 50) ORDER BY n), count(*), 0.8 FROM v WHERE k = 2 GROUP BY file HAVING count(*) >= 2
      UNION ALL SELECT file, 'title_structure', 'common_prefix', list(n ORDER BY n), list('Prefix: ''' || w[1] || ' ' || w[2] || ''' - ' || left(title, 30) ORDER BY n), count(*), 0.7 FROM p WHERE len(w) >= 2 GROUP BY file, w[1], w[2] HAVING count(*) >= 3
      UNION ALL SELECT file, 'layout_sequence', 'repeated_sequence', [], [sequence], count(*), 0.8 FROM s WHERE sequence IS NOT NULL GROUP BY file, sequence HAVING count(*) >= 3)
    SELECT file, pattern_type, pattern_name, occurrences, array_to_string(places, ',') AS slides, array_to_string(told[1:3], ';') AS examples, confidence::DOUBLE AS confidence FROM f""")  # fmt: skip
def varied_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered titles, questions, prefixes and sequences, with the slides that have them."""
    found = analysis.patterns(analysis.view(view(spark, sf_dir)))
    listed = F.array_join(F.transform("slides", lambda x: x.cast("string")), ",")
    return found.select("file", "pattern_type", "pattern_name", "occurrences", listed.alias("slides"), F.array_join("examples", ";").alias("examples"), F.col("confidence").cast("double").alias("confidence"))


@query("varied_insights", f"""WITH v AS ({KINDS}), f AS (SELECT file, count(*) AS slides, count(*) FILTER (slide_type = 'title_slide') AS titles, count(*) FILTER (slide_type = 'blank_slide') AS blanks, count(*) FILTER (slide_type = 'bullet_slide') AS bullets,
      count(*) FILTER (title IS NULL) AS untitled, count(*) FILTER (k = 9 AND size % 3 < 2) AS notes_count FROM v GROUP BY file),
    y AS (SELECT file, string_agg(slide_type || ':' || c, ',' ORDER BY slide_type) AS slide_types FROM (SELECT file, slide_type, count(*) AS c FROM v GROUP BY ALL) GROUP BY file)
    SELECT file, slides, slide_types, notes_count, concat_ws(';', CASE WHEN titles = 0 THEN 'no title slide' END, CASE WHEN blanks > 0 THEN blanks || ' blank slides' END, CASE WHEN slides < 3 THEN 'very short presentation' END,
      CASE WHEN slides > 50 THEN 'very long presentation' END) AS issues, concat_ws(';', CASE WHEN titles = 0 THEN 'begin with a title slide' END, CASE WHEN slides > 30 THEN 'split into shorter presentations' END,
      CASE WHEN untitled > 0 AND slides - untitled > untitled THEN 'settle inconsistencies' END, CASE WHEN bullets > slides * 0.6 THEN 'show more and list less' END) AS recommendations FROM f JOIN y USING (file)""")  # fmt: skip
def varied_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.insights(storage.written(analysis.view(view(spark, sf_dir)), "rows"))
    types = F.array_join(F.transform(F.map_entries("slide_types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return found.select("file", "slides", types.alias("slide_types"), "notes_count", *(F.array_join(c, ";").alias(c) for c in ("issues", "recommendations")))


@query("varied_notes", f"SELECT file, n AS slide_number, 'said by ' || role AS content FROM ({V}) WHERE k = 9 AND size % 3 < 2")
def varied_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that no slide names, by their number, unless they say that they are of another slide."""
    return longs(slides.notes(view(spark, sf_dir)), "slide_number")


@query("varied_comments", f"SELECT file, n AS slide_number, '{{' || n || '}}' AS idx, '{{A}}' AS author_id, '2021-01-01T00:00:00' AS dt, role || ' & co' AS text FROM ({V}) WHERE k = 8")
def varied_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threaded comments."""
    return longs(slides.comments(view(spark, sf_dir)).select("file", "slide_number", "idx", "author_id", "dt", "text"), "slide_number")


@query("varied_colors", f"SELECT file, n AS slide_number, value AS text, color AS info FROM ({CELLS}) WHERE color IS NOT NULL UNION ALL SELECT file, n, role || ' accent', 'accent3' FROM ({V}) WHERE k = 9")
def varied_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colors by value and by their name in the scheme."""
    return longs(formatting.segments(view(spark, sf_dir), "font_colors").select("file", "slide_number", "text", "info"), "slide_number")


@query("varied_text_elements", f"""SELECT file, n AS slide_number, 'title' AS ph_type, title AS text FROM ({V}) WHERE title IS NOT NULL UNION ALL SELECT file, n, 'subTitle', 'part ' || n FROM ({V}) WHERE k = 2
    UNION ALL SELECT file, n, 'body', unnest(CASE k WHEN 6 THEN ['left', 'right'] WHEN 8 THEN ['only body'] ELSE [role || ' accent'] END) FROM ({V}) WHERE k IN (6, 8, 9) UNION ALL SELECT file, n, NULL, 'inner ' || role FROM ({V}) WHERE k = 7""")  # fmt: skip
def varied_text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of placeholders and of shapes in groups."""
    return longs(view(spark, sf_dir).select("file", "slide_number", F.explode("text_elements").alias("e")).select("file", "slide_number", "e.ph_type", "e.text"), "slide_number")
