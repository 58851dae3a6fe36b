"""Registered queries over packages: every conversation is written as a package, read back and queried.

A conversation is a deck and a turn a slide, whose contents follow from the turn by plain rules (see
``deck_slides``), so that SQL on the conversations says what each operator must return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckhand.operators import analysis, decks, formatting, inheritance, ranges, rendering, slides, tables
from deckhand.plans import pipeline
from deckhand.sources import archive, graph, ooxml, pull, storage, styles, writer
from deckhand.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The deck of every conversation, a row a slide; n counts from 1.
S = """SELECT *, 'deck-' || conv_id || '.pptx' AS file, CASE WHEN role <> 'system' THEN role || ' ' || n END AS title, CASE WHEN n = 1 THEN 'conversation ' || conv_id END AS subtitle,
    CASE WHEN n = 1 THEN 'Title Slide' ELSE 'Content' END AS layout_name, array_to_string(list_filter(norm, lambda x: x <> ''), ' ') AS body,
    length(text) % 3 = 0 AS tabled, CASE WHEN role = 'assistant' AND n % 2 = 0 THEN 1 ELSE 0 END AS images, CASE WHEN n = 4 THEN 1 ELSE 0 END AS charts, CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END AS connectors,
    CASE WHEN n % 2 = 1 THEN norm[1] END AS notes, CASE WHEN n <= 2 THEN 'Opening' ELSE 'Main' END AS section,
    CASE WHEN role <> 'system' AND n > 1 THEN 'titleAndContent' ELSE 'contentOnly' END AS layout_type
  FROM (SELECT *, list_transform(lines, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS norm FROM
    (SELECT conv_id, role, text, string_split(text, chr(10)) AS lines, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total
     FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)))"""
COUNTED = f"""SELECT *, 1 + (title IS NOT NULL)::INT + (subtitle IS NOT NULL)::INT AS shapes, (body <> '')::INT + (title IS NOT NULL)::INT + (subtitle IS NOT NULL)::INT AS text_boxes, tabled::INT AS tables FROM ({S})"""
#: Text elements in order.
ELEMENTS = f"""SELECT file, n, 0 AS k, CASE WHEN n = 1 THEN 'ctrTitle' ELSE 'title' END AS ph_type, title AS text FROM ({S}) WHERE title IS NOT NULL
    UNION ALL SELECT file, n, 1, 'subTitle', subtitle FROM ({S}) WHERE subtitle IS NOT NULL UNION ALL SELECT file, n, 2, 'body', body FROM ({S}) WHERE body <> ''"""
#: Cells as text with their place and header.
CELLS = f"""SELECT file, n, 0 AS row, 0 AS col, 'line' AS header, 'line' AS value, 1 AS span FROM ({S}) WHERE tabled UNION ALL SELECT file, n, 0, 1, 'size', 'size', 1 FROM ({S}) WHERE tabled
    UNION ALL SELECT file, n, i::INT, c::INT, CASE WHEN c = 0 THEN 'line' ELSE 'size' END, CASE WHEN c = 0 THEN (i - 1)::VARCHAR ELSE length(lines[i])::VARCHAR END, 1 FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM ({S}) WHERE tabled), (VALUES (0), (1)) v(c)
    UNION ALL SELECT file, n, len(lines)::INT + 1, 0, 'line', 'end', 2 FROM ({S}) WHERE tabled AND length(text) % 2 = 0"""
#: Runs in order with what they have.
RUNS = f"""WITH r AS (SELECT file, n, conv_id, role, 0 AS o, 0 AS i, title AS text, 'title' AS kind FROM ({S}) WHERE title IS NOT NULL
    UNION ALL SELECT file, n, conv_id, role, 1, 0, subtitle, 'title' FROM ({S}) WHERE subtitle IS NOT NULL
    UNION ALL SELECT file, n, conv_id, role, 2, i::INT, lines[i], 'body' FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM ({S}))
    UNION ALL SELECT file, n, 0, '', 3, row * 2 + col, value, 'cell' FROM ({CELLS}))
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY file, n ORDER BY o, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r"""
#: Which runs have a kind of formatting, and what goes with it.
KINDS = {
    "bold": ("kind = 'body' AND i = 1 AND role = 'user'", "NULL::VARCHAR"), "italic": ("kind = 'body' AND i = 1 AND role = 'assistant'", "NULL::VARCHAR"),
    "strikethrough": ("kind = 'body' AND i = 1 AND role = 'system'", "NULL::VARCHAR"), "underlined": ("kind = 'body' AND i = 3", "NULL::VARCHAR"),
    "highlighted": ("kind = 'body' AND i = 4", "'#FFFF00'"), "font_sizes": ("kind = 'body' AND i = 2", "'24.0'"), "font_colors": ("kind = 'body' AND i = 2", "'#FF0000'"),
    "hyperlinks": ("kind = 'body' AND i = 3", "'https://example.com/' || conv_id"),
}
#: Elements with their formatting.
FORMATTED = f"""SELECT file, n, o, any_value(kind) AS kind, CASE WHEN any_value(kind) = 'title' THEN 'titles' WHEN any_value(kind) = 'cell' THEN 'tables' ELSE 'text_boxes' END AS content_type,
    array_to_string(list_filter(list(text ORDER BY i), lambda x: trim(x) <> ''), ' ') AS text_content,
    count(*) FILTER ({KINDS['bold'][0]} AND text <> '') AS bold, count(*) FILTER ({KINDS['italic'][0]} AND text <> '') AS italic, count(*) FILTER ({KINDS['underlined'][0]} AND text <> '') AS underline,
    count(*) FILTER ({KINDS['strikethrough'][0]} AND text <> '') AS strike, count(*) FILTER ({KINDS['highlighted'][0]}) AS highlight,
    count(*) FILTER ({KINDS['font_colors'][0]}) > 0 AS colored, count(*) FILTER ({KINDS['hyperlinks'][0]}) > 0 AS linked,
    list_sort(list(DISTINCT CASE WHEN kind = 'body' AND i = 2 THEN 24.0 WHEN kind = 'title' AND o = 0 THEN 44.0 WHEN kind = 'title' THEN 24.0 ELSE 18.0 END::DOUBLE)) AS sizes
  FROM (SELECT *, CASE WHEN kind = 'cell' THEN i ELSE 0 END AS cell FROM ({RUNS})) GROUP BY file, n, o, cell"""
HELD = f"SELECT *, bold + italic + underline + strike + highlight > 0 OR colored OR linked AS has_formatting FROM ({FORMATTED}) WHERE trim(text_content) <> '' OR linked"


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def deck_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slides of every conversation's deck, in the writer's form."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumns({"n": n, "lines": F.split("text", "\n")})
    when = lambda c, v: F.when(c, v)
    role, k, size = F.col("role"), F.col("n"), F.length("text")

    def run(line: Column, i: Column) -> Column:
        no = F.lit(None).cast("string")
        return F.array(F.struct(
            line.alias("text"), ((i == 0) & (role == "user")).alias("bold"), ((i == 0) & (role == "assistant")).alias("italic"), (i == 2).alias("underline"), ((i == 0) & (role == "system")).alias("strike"),
            when(i == 1, F.lit(2400)).alias("size"), when(i == 1, F.lit("FF0000")).otherwise(no).alias("color"), when(i == 3, F.lit("FFFF00")).otherwise(no).alias("highlight"),
            when(i == 2, F.concat(F.lit("https://example.com/"), F.col("conv_id").cast("string"))).alias("url"),
        ))

    cell = lambda t, span=1: F.struct(t.cast("string").alias("text"), F.lit(span).alias("span"))
    head = F.array(F.array(cell(F.lit("line")), cell(F.lit("size"))))
    each = F.transform("lines", lambda line, i: F.array(cell(i), cell(F.length(line))))
    end = F.when(size % 2 == 0, F.array(F.array(cell(F.lit("end"), 2)))).otherwise(F.expr("filter(array(array(struct('' AS text, 1 AS span))), x -> false)"))
    return rows.select(
        F.concat(F.lit("deck-"), F.col("conv_id").cast("string"), F.lit(".pptx")).alias("file"), k.alias("slide_number"),
        when(k == 1, F.lit("Title Slide")).otherwise("Content").alias("layout_name"), when(role != "system", F.concat_ws(" ", role, k.cast("string"))).alias("title"),
        when(k == 1, F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))).alias("subtitle"), F.transform("lines", run).alias("body"),
        when(size % 3 == 0, F.concat(head, each, end)).alias("cells"), when((role == "assistant") & (k % 2 == 0), 1).otherwise(0).alias("pictures"), when(k == 4, 1).otherwise(0).alias("charts"),
        when(k % 3 == 0, 2).otherwise(0).alias("connectors"), when(k % 2 == 1, F.get("lines", F.lit(0))).alias("notes"), when(k == 2, role).alias("comment"),
        when(k <= 2, F.lit("Opening")).otherwise("Main").alias("section"),
    )


#: Slides that a task writes as packages and parses.
TASK_SLIDES = 1000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the slides are dealt to: as many as the session runs at a time, and in proportion to the table beyond that."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/conversations.parquet").count() // TASK_SLIDES))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writer.packages_of(deck_slides(spark, sf_dir), tasks(spark, sf_dir))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.parsed(files(spark, sf_dir))


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decks parsed once and written, for queries that read them more than once."""
    return storage.written(packages(spark, sf_dir), "bronze")


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slides.slides(packages(spark, sf_dir))


def written_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slides.slides(bronze(spark, sf_dir))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Packages and their parts.
PARTS = f"""SELECT file, unnest(['[Content_Types].xml', '_rels/.rels', 'ppt/presentation.xml', 'ppt/_rels/presentation.xml.rels', 'ppt/slideLayouts/slideLayout1.xml']) AS name FROM ({S}) WHERE n = 1
    UNION ALL SELECT file, unnest(['ppt/slides/slide' || (total - n + 1) || '.xml', 'ppt/slides/_rels/slide' || (total - n + 1) || '.xml.rels']) FROM ({S})
    UNION ALL SELECT file, unnest(['ppt/notesSlides/notesSlide' || n || '.xml', 'ppt/notesSlides/_rels/notesSlide' || n || '.xml.rels']) FROM ({S}) WHERE n % 2 = 1
    UNION ALL SELECT file, 'ppt/comments/comment' || (total - n + 1) || '.xml' FROM ({S}) WHERE n = 2"""


@query("pkg_parts", f"SELECT file, name, regexp_matches(name, '\\.(xml|rels)$') AS is_xml FROM ({PARTS})")
def pkg_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.parts_of(files(spark, sf_dir)).select("file", "name", "is_xml")


def folder(spark: SparkSession, sf_dir: str) -> str:
    """The decks as files of a new folder in the shared one."""
    path = storage.new_dir(spark, "decks")
    archive.write_packages(files(spark, sf_dir), path).write.format("noop").mode("overwrite").save()
    return path


def file_name() -> Column:
    return F.element_at(F.split("file", "/"), -1).alias("file")


@query("pkg_source_parts", f"SELECT file, name, regexp_matches(name, '\\.(xml|rels)$') AS is_xml, row_number() OVER (PARTITION BY file ORDER BY name) AS place FROM ({PARTS})")
def pkg_source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of archives that lie in a folder, by the data source."""
    found = archive.scan(spark, folder(spark, sf_dir))
    return found.select(file_name(), "name", "is_xml", F.row_number().over(Window.partitionBy("file").orderBy("name")).cast("long").alias("place"))


@query("pkg_source_lookup", f"SELECT file, '<Types/>' AS text, true AS read_in_part FROM ({S}) WHERE n = 1")
def pkg_source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part of each archive, of which nothing else is read but the directory."""
    found = archive.scan(spark, folder(spark, sf_dir), content=True).where(F.col("name") == "[Content_Types].xml")
    return found.select(file_name(), F.col("content").cast("string").alias("text"), (F.col("bytes_read") < F.col("length")).alias("read_in_part"))


@query("pkg_slide_parts", f"SELECT file, name, row_number() OVER (PARTITION BY file ORDER BY n) - 1 AS place FROM (SELECT file, n, 'ppt/slides/slide' || (total - n + 1) || '.xml' AS name FROM ({S}))")
def pkg_slide_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides in archive order, which is that of the presentation here and not that of their numbers."""
    found = ooxml.parts_like(ooxml.parts_of(files(spark, sf_dir)), "slides")
    return found.select("file", "name", (F.row_number().over(Window.partitionBy("file").orderBy("ordinal")) - 1).cast("long").alias("place"))


@query("pkg_numbered_parts", f"SELECT file, total - n + 1 AS number, row_number() OVER (PARTITION BY file ORDER BY n DESC) AS place FROM ({S})")
def pkg_numbered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.numbered(ooxml.parts_of(files(spark, sf_dir)), "file", "name", r"^ppt/slides/slide(\d+)\.xml$"), "number", "place").select("file", "number", "place")


@query("pkg_layouts_and_notes", f"SELECT file, name FROM ({PARTS}) WHERE name LIKE 'ppt/slideLayouts/%' OR (name LIKE 'ppt/notesSlides/notes%')")
def pkg_layouts_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = storage.written(ooxml.parts_of(files(spark, sf_dir)), "parts")
    return ooxml.parts_like(found, "layouts").union(ooxml.parts_like(found, "notes")).select("file", "name")


@query("pkg_census", f"""SELECT file, count(*) AS parts, count(*) FILTER (name LIKE 'ppt/slides/slide%') AS slides, count(*) FILTER (name LIKE 'ppt/notesSlides/notes%') AS notes, 1::BIGINT AS layouts,
    true AS has_presentation FROM ({PARTS}) GROUP BY file""")  # fmt: skip
def pkg_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.census(ooxml.parts_of(files(spark, sf_dir))).select("file", "parts", "slides", "notes", "layouts", "has_presentation")


@query("pkg_missing_parts", "SELECT DISTINCT 'deck-' || conv_id || '.pptx' AS file, p AS name FROM conversations, (VALUES ('ppt/presentation.xml', 7), ('_rels/.rels', 5)) v(p, m) WHERE conv_id % m = 0")
def pkg_missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are taken out of every fifth and seventh package."""
    conv = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    gone = ((F.col("name") == "ppt/presentation.xml") & (conv % 7 == 0)) | ((F.col("name") == "_rels/.rels") & (conv % 5 == 0))
    return ooxml.required(storage.written(ooxml.parts_of(files(spark, sf_dir)).where(~gone), "parts")).select("file", "name")


@query("pkg_part_content", f"SELECT file, '<Types/>' AS text FROM ({S}) WHERE n = 1")
def pkg_part_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.part(ooxml.parts_of(files(spark, sf_dir), content=True), "[Content_Types].xml").select("file", F.col("content").cast("string").alias("text"))


@query("pkg_xml_elements", f"SELECT file, n - 1 AS at, (255 + n)::VARCHAR AS id, 'rId' || (n - 1) AS rid FROM ({S})")
def pkg_xml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ooxml.part(ooxml.parts_of(files(spark, sf_dir), content=True), "ppt/presentation.xml")
    return ooxml.elements(found, ".//p:sldId").select("file", F.col("at").cast("long").alias("at"), F.col("attributes")["id"].alias("id"), F.col("attributes")["r:id"].alias("rid"))


@query("pkg_xml_text", f"SELECT file, 'ppt/slides/slide' || (total - n + 1) || '.xml' AS name, title AS text FROM ({S}) WHERE title IS NOT NULL")
def pkg_xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ooxml.xml_parts(ooxml.parts_like(ooxml.parts_of(files(spark, sf_dir), content=True), "slides"))
    return ooxml.elements(found, ".//p:sp", first=True).where("text NOT LIKE 'conversation %'").select("file", "name", "text").where("text RLIKE '^(user|assistant) [0-9]+$'")


@query("pkg_file_metadata", f"SELECT file, file AS name, '.pptx' AS extension, TIMESTAMP '2020-01-01 00:00:00' AS modified FROM ({S}) WHERE n = 1")
def pkg_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.metadata(files(spark, sf_dir)).select("file", "name", "extension", "modified")


@query("pkg_rejects", """SELECT DISTINCT 'deck-' || conv_id || CASE WHEN conv_id % 5 = 1 THEN '.ppt' ELSE '.pptx' END AS file, 'invalid_file' AS error_type,
    CASE conv_id % 5 WHEN 0 THEN 'not a ZIP archive' WHEN 1 THEN 'wrong extension' ELSE 'empty file' END AS error FROM conversations WHERE conv_id % 5 < 3""")  # fmt: skip
def pkg_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five files one is damaged, one has another name and one is empty."""
    kind = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 5
    made = files(spark, sf_dir).withColumns({
        "content": F.when(kind == 0, F.lit("not a package").cast("binary")).otherwise(F.col("content")), "length": F.when(kind == 2, F.lit(0).cast("long")).otherwise(F.col("length")),
        "path": F.when(kind == 1, F.regexp_replace("path", "pptx$", "ppt")).otherwise(F.col("path")),
    })
    return ooxml.rejects(ooxml.parsed(made)).select("file", "error_type", "error")


# Presentations and slides.
@query("pkg_presentations", f"""SELECT file, count(*) AS slide_count, 1::BIGINT AS slide_masters, false AS has_notes_master, 10.0::DOUBLE AS width_in, 25.4::DOUBLE AS width_cm, 540.0::DOUBLE AS height_points, 1.33::DOUBLE AS ratio,
    count(DISTINCT section) AS sections FROM ({S}) GROUP BY file""")  # fmt: skip
def pkg_presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slides.presentations(packages(spark, sf_dir)).withColumn("sections", F.size("sections"))
    found = found.select("file", "slide_count", "slide_masters", "has_notes_master", "width_in", F.col("slide_size.width_cm").alias("width_cm"), F.col("slide_size.height_points").alias("height_points"), F.col("slide_size.aspect_ratio").alias("ratio"), "sections")
    return longs(found, "slide_count", "slide_masters", "sections")


@query("pkg_slides", f"SELECT file, n AS slide_number, total - n + 1 AS part_number, (255 + n)::VARCHAR AS slide_id, title, subtitle, layout_name, layout_type, section, notes FROM ({S})")
def pkg_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir).select("file", "slide_number", "part_number", "slide_id", "title", "subtitle", "layout_name", "layout_type", "section", "notes")
    return longs(found, "slide_number", "part_number")


@query("pkg_slide_order", f"SELECT file, n AS slide_number, 'ppt/slides/slide' || (total - n + 1) || '.xml' AS part FROM ({S})")
def pkg_slide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.order(packages(spark, sf_dir)), "slide_number").select("file", "slide_number", "part")


@query("pkg_sections", f"SELECT file, section, CASE WHEN section = 'Opening' THEN 0 ELSE 1 END::BIGINT AS section_ord, (255 + n)::VARCHAR AS slide_id, n AS slide_number FROM ({S})")
def pkg_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.sections(packages(spark, sf_dir)), "section_ord", "slide_number").select("file", "section", "section_ord", "slide_id", "slide_number")


COUNTS = ["shapes", "text_boxes", "images", "tables", "charts", "connectors"]


@query("pkg_object_counts", f"SELECT file, n AS slide_number, {', '.join(f'{c}::BIGINT AS {c}' for c in COUNTS)}, ({' + '.join(COUNTS)})::BIGINT AS objects FROM ({COUNTED})")
def pkg_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir).select("file", "slide_number", *(F.col(f"object_counts.{c}").alias(c) for c in COUNTS), slides.total_objects(F.col("object_counts")).alias("objects"))
    return longs(found, "slide_number", *COUNTS, "objects")


@query("pkg_computed_counts", f"SELECT file, n AS slide_number, ((title IS NOT NULL)::INT + (subtitle IS NOT NULL)::INT + (body <> '')::INT)::BIGINT AS text_boxes, tabled::INT::BIGINT AS tables FROM ({S})")
def pkg_computed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = slides.with_counts(view(spark, sf_dir).drop("object_counts"))
    return longs(made.select("file", "slide_number", F.col("object_counts.text_boxes").alias("text_boxes"), F.col("object_counts.tables").alias("tables")), "slide_number", "text_boxes", "tables")


@query("pkg_text_elements", f"SELECT file, n AS slide_number, ph_type, text FROM ({ELEMENTS})")
def pkg_text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = view(spark, sf_dir).select("file", F.col("slide_number").cast("long").alias("slide_number"), F.explode("text_elements").alias("e"))
    return each.select("file", "slide_number", "e.ph_type", "e.text")


@query("pkg_notes", f"SELECT file, n AS slide_number, notes AS content FROM ({S}) WHERE trim(coalesce(notes, '')) <> ''")
def pkg_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.notes(view(spark, sf_dir)), "slide_number")


@query("pkg_comments", f"SELECT file, n AS slide_number, role AS text, n - 1 AS x, total - n + 1 AS y FROM ({S}) WHERE n = 2")
def pkg_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.comments(view(spark, sf_dir)).select("file", "slide_number", "text", "x", "y"), "slide_number")


@query("pkg_links", f"SELECT file, n AS slide_number, lines[3] AS text, 'https://example.com/' || conv_id AS url, 'external' AS link_type FROM ({S}) WHERE len(lines) >= 3")
def pkg_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.links(view(spark, sf_dir)).drop("shape"), "slide_number")


# Searches.
def search(name: str, criteria: dict, where: str) -> None:
    @query(name, f"SELECT file, n AS slide_number, title FROM ({COUNTED}) WHERE {where}")
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return longs(slides.query_slides(view(spark, sf_dir), criteria, ["title"]), "slide_number")


search("pkg_search_sections", {"section": ["main", "none"]}, "section = 'Main'")
search("pkg_search_content", {"content": {"has_tables": True, "has_charts": False, "object_count_min": 5, "object_count_max": 7}}, f"tabled AND charts = 0 AND {' + '.join(COUNTS)} BETWEEN 5 AND 7")
search("pkg_search_images", {"content": {"has_images": True, "object_count": {"max": 9}}}, f"images > 0 AND {' + '.join(COUNTS)} <= 9")
search("pkg_search_text", {"content": {"contains_text": "An"}}, "contains(lower(coalesce(title, '')), 'an') OR contains(lower(body), 'an') OR contains(lower(coalesce(subtitle, '')), 'an')")
search("pkg_search_layout", {"layout": {"type": "titleand", "name": "CONT"}}, "contains(lower(layout_type), 'titleand') AND contains(lower(layout_name), 'cont')")
search("pkg_search_titles", {"title": {"one_of": ["^user [24]$", "Assistant 3", "("]}}, "regexp_matches(coalesce(title, ''), '^user [24]$', 'i') OR regexp_matches(coalesce(title, ''), 'assistant 3', 'i')")
search("pkg_search_all", {"slide_numbers": "[1:3]", "title": {"starts_with": "USER"}, "notes": {"is_empty": False, "regex": "^[a-m]"}, "section": "opening"},
       "n BETWEEN 1 AND 3 AND starts_with(coalesce(title, ''), 'user') AND trim(coalesce(notes, '')) <> '' AND regexp_matches(notes, '^[a-m]', 'i') AND section = 'Opening'")


@query("pkg_search_limit", f"SELECT file, n AS slide_number FROM ({S}) ORDER BY file, n LIMIT 25")
def pkg_search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.query_slides(view(spark, sf_dir), {}, ["slide_number"], 25), "slide_number")


@query("pkg_search_fields", f"""SELECT file, n AS slide_number, concat_ws(' | ', title, CASE WHEN length(subtitle) > 100 THEN left(subtitle, 97) || '...' ELSE subtitle END, CASE WHEN body = '' THEN NULL WHEN length(body) > 100 THEN left(body, 97) || '...' ELSE body END) AS preview_text_3boxes,
    concat_ws(' | ', title, subtitle, CASE WHEN body = '' THEN NULL WHEN length(body) > 500 THEN left(body, 497) || '...' ELSE body END) AS full_text, section FROM ({S})""")  # fmt: skip
def pkg_search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.query_slides(view(spark, sf_dir), {}, ["preview_text_3boxes", "full_text", "section"]), "slide_number")


@query("pkg_table_info", f"SELECT file, n AS slide_number, 0::BIGINT AS table_index, (1 + len(lines) + (length(text) % 2 = 0)::INT)::BIGINT AS rows, 2::BIGINT AS columns, 'line,size' AS headers FROM ({S}) WHERE tabled")
def pkg_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slides.query_slides(view(spark, sf_dir), {}, ["table_info"]).select("file", "slide_number", F.explode("table_info").alias("t"))
    return longs(found.select("file", "slide_number", "t.table_index", "t.rows", "t.columns", F.array_join("t.headers", ",").alias("headers")), "slide_number", "table_index", "rows", "columns")


@query("pkg_full_content", f"SELECT s.file, s.n AS slide_number, s.title, s.notes, count(e.text) AS elements, s.layout_type FROM ({S}) s LEFT JOIN ({ELEMENTS}) e ON e.file = s.file AND e.n = s.n GROUP BY ALL")
def pkg_full_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slides.query_slides(view(spark, sf_dir), {}, ["full_content"]).select("file", "slide_number", "full_content.*")
    return longs(found.select("file", "slide_number", "title", "notes", F.size("text_elements").alias("elements"), "layout_type"), "slide_number", "elements")


@query("pkg_attributes", f"""SELECT file, n AS slide_number, title, layout_type, images::BIGINT AS images, charts::BIGINT AS charts, section, 720.0::DOUBLE AS width_points, concat_ws(' ', title, subtitle, nullif(body, '')) AS content_plain,
    (1 + (title IS NOT NULL)::INT + (subtitle IS NOT NULL)::INT)::BIGINT AS placeholders FROM ({S})""")  # fmt: skip
def pkg_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slides.attributes(view(spark, sf_dir), ["title", "layout", "images", "charts", "sections", "size", "text", "placeholders"])
    found = found.withColumns({"placeholders": F.size("placeholders"), "width_points": F.col("slide_size.width_points")})
    return longs(found, "slide_number", "images", "charts", "placeholders").select("file", "slide_number", "title", "layout_type", "images", "charts", "section", "width_points", "content_plain", "placeholders")


@query("pkg_attribute_summary", f"SELECT file, count(*) AS total_slides, sum(images)::BIGINT AS images, sum(connectors)::BIGINT AS connectors, sum(text_boxes)::BIGINT AS total_text_elements, sum(tables)::BIGINT AS total_tables FROM ({COUNTED}) GROUP BY file")
def pkg_attribute_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slides.attribute_summary(view(spark, sf_dir), ["object_counts", "text", "tables"])
    return found.select("file", "total_slides", "total_objects.images", "total_objects.connectors", "total_text_elements", "total_tables")


@query("pkg_content", f"SELECT file, count(*) AS slide_count, count(*) AS slides, count(*) FILTER (trim(coalesce(notes, '')) <> '') AS notes, string_agg(coalesce(title, '-'), ',' ORDER BY n) AS titles FROM ({S}) GROUP BY file")
def pkg_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slides.content(bronze(spark, sf_dir))
    titles = F.array_join(F.transform("slides", lambda s: F.coalesce(s["title"], F.lit("-"))), ",").alias("titles")
    return longs(found.select("file", "slide_count", F.size("slides").alias("slides"), F.size("notes").alias("notes"), titles), "slide_count", "slides", "notes")


@query("pkg_slide_info", f"SELECT file, n AS slide_number, title, section FROM ({S}) WHERE file = 'deck-1.pptx' AND n = 2")
def pkg_slide_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(slides.slide_info(view(spark, sf_dir), "deck-1.pptx", 2).select("file", "slide_number", "title", "section"), "slide_number")


# HTML.
def body_html(most: int) -> str:
    run = """'<strong>' || x || '</strong>' WHEN i = 1 AND role = 'assistant' THEN '<em>' || x || '</em>' WHEN i = 1 THEN '<s>' || x || '</s>' WHEN i = 2 THEN '<span style="color:#FF0000">' || x || '</span>'
        WHEN i = 3 THEN '<a href="https://example.com/' || conv_id || '"><u>' || x || '</u></a>' WHEN i = 4 THEN '<span style="background-color:#FFFF00">' || x || '</span>' ELSE x END"""
    escaped = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
    lines = f"list_transform(list_transform(lines, lambda x: {escaped}), lambda x, i: CASE WHEN i = 1 AND role = 'user' THEN {run})"
    whole = f"array_to_string({lines}, '<br>')"
    return f"""coalesce('<h2>' || title || '</h2>', '') || coalesce('<h3>' || subtitle || '</h3>', '') || '<div style="white-space: pre-wrap;">' || CASE WHEN length({whole}) > {most} THEN left({whole}, {most - 3}) || '...' ELSE {whole} END || '</div>'"""


@query("pkg_html_preview", f"SELECT file, n AS slide_number, {body_html(200)} AS html FROM ({S})")
def pkg_html_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(view(spark, sf_dir).select("file", "slide_number", rendering.preview().alias("html")), "slide_number")


@query("pkg_html_full", f"SELECT file, n AS slide_number, {body_html(1000)} AS html FROM ({S})")
def pkg_html_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(view(spark, sf_dir).select("file", "slide_number", rendering.full().alias("html")), "slide_number")


@query("pkg_query_simple", f"SELECT file, n AS slide_number, coalesce('<h2>' || title || '</h2>', '') AS title, coalesce('<h3>' || subtitle || '</h3>', '') AS subtitle, {body_html(200)} AS text, tabled::INT::BIGINT AS shown FROM ({S}) WHERE section = 'Opening'")
def pkg_query_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rendering.query_simple(written_view(spark, sf_dir), {"section": "Opening"}, ["title", "subtitle", "text", "extracted_tables"], "formatted")
    shown = F.coalesce(F.size("extracted_tables"), F.lit(0)).cast("long").alias("shown")
    return longs(found, "slide_number").select("file", "slide_number", "title", "subtitle", "text", F.when(shown > 0, shown).otherwise(0).cast("long").alias("shown"))


@query("pkg_query_summary", f"""SELECT file, count(*) AS total_slides, count(*) FILTER (n <= 3) AS slides_matching_criteria, least(count(*) FILTER (n <= 3), 2) AS results_returned,
    string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (n <= 3 AND tabled) AS tabled FROM ({S}) GROUP BY file""")  # fmt: skip
def pkg_query_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rendering.query_summary(view(spark, sf_dir), {"slide_numbers": ":3"}, 2)
    listed = F.array_join(F.transform(F.map_keys("tables_in_slides"), lambda k: k.cast("string")), ",")
    return found.select("file", "total_slides", "slides_matching_criteria", "results_returned", F.when(listed != "", listed).alias("tabled"))


# Tables.
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(view(spark, sf_dir))


@query("pkg_cells", f"SELECT file, n AS slide_number, row::BIGINT AS row, col::BIGINT AS logical_col, header, value, span::BIGINT AS col_span FROM ({CELLS})")
def pkg_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(cells(spark, sf_dir).select("file", "slide_number", "row", "logical_col", "header", "value", "col_span"), "slide_number", "row", "logical_col", "col_span")


@query("pkg_table_structured", f"SELECT file, n AS slide_number, 'line,size' AS headers, (max(row) + 1)::BIGINT AS rows, 2::BIGINT AS columns, count(*) AS cells, count(*) AS non_empty_cells, false AS has_formatting, string_agg(value, ',' ORDER BY row, col) AS vals FROM ({CELLS}) GROUP BY file, n")
def pkg_table_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.extract(view(spark, sf_dir)).withColumns({"headers": F.array_join("headers", ","), "vals": F.array_join(F.col("cells.value"), ","), "cells": F.size("cells")})
    return longs(found.select("file", "slide_number", "headers", "rows", "columns", "cells", "non_empty_cells", "has_formatting", "vals"), "slide_number", "rows", "cells")


@query("pkg_tables_by_slide", f"SELECT file, n AS slide_number, 1::BIGINT AS tables FROM ({S}) WHERE tabled")
def pkg_tables_by_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(tables.extract(view(spark, sf_dir), "grouped_by_slide").select("file", "slide_number", F.size("tables").alias("tables")), "slide_number", "tables")


@query("pkg_table_flat", f"SELECT file, n AS slide_number, row::BIGINT AS row, max(value) FILTER (col = 0) AS line, max(value) FILTER (col = 1) AS size, CASE WHEN count(*) FILTER (col = 1) > 0 THEN false END AS size_bold FROM ({CELLS}) WHERE row > 0 GROUP BY ALL")
def pkg_table_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(tables.flat(cells(spark, sf_dir), ["line", "size"]).select("file", "slide_number", "row", "line", "size", "size_bold"), "slide_number", "row")


@query("pkg_table_flat_rows", f"SELECT file, n AS slide_number, row::BIGINT AS row, max(value) FILTER (col = 0) AS line, max(value) FILTER (col = 1) AS size FROM ({CELLS}) WHERE row > 0 GROUP BY ALL")
def pkg_table_flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.extract(view(spark, sf_dir), "flat")
    return longs(found.select("file", "slide_number", "row", F.col("values")["line"].alias("line"), F.try_element_at("values", F.lit("size")).alias("size")), "slide_number", "row")


@query("pkg_row_col_value", f"SELECT file, n AS slide_number, row::BIGINT AS row, col::BIGINT AS col, value FROM ({CELLS})")
def pkg_row_col_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(tables.extract(view(spark, sf_dir), "row_col_value").drop("table_index"), "slide_number", "row", "col")


@query("pkg_row_col_formatted", f"SELECT file, n AS slide_number, row::BIGINT AS row, col::BIGINT AS col, value FROM ({CELLS})")
def pkg_row_col_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(tables.extract(view(spark, sf_dir), "row_col_formattedvalue").drop("table_index"), "slide_number", "row", "col")


TABLE_HTML = f"""WITH r AS (SELECT file, n, row, string_agg('<' || CASE WHEN row = 0 THEN 'th' ELSE 'td' END || CASE WHEN span > 1 THEN ' colspan="2"' ELSE '' END || '>' || value || '</' || CASE WHEN row = 0 THEN 'th' ELSE 'td' END || '>', '' ORDER BY col) AS tr FROM ({CELLS}) GROUP BY ALL)
    SELECT file, n AS slide_number, '<table>' || string_agg('<tr>' || tr || '</tr>', '' ORDER BY row) || '</table>' AS html FROM r GROUP BY file, n"""
for _name, _format in (("pkg_simple_html", "simple_html"), ("pkg_table_html", "html")):
    query(_name, TABLE_HTML)(lambda spark, sf_dir, form=_format: longs(tables.extract(view(spark, sf_dir), form).drop("table_index"), "slide_number"))


@query("pkg_table_criteria", f"SELECT file, n AS slide_number FROM ({CELLS}) GROUP BY file, n HAVING max(row) + 1 BETWEEN 3 AND 6")
def pkg_table_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.extract(view(spark, sf_dir), criteria={"min_rows": 3, "max_rows": 6, "min_columns": 2, "header_contains": ["LIN"], "header_patterns": ["^si.e$"]})
    return longs(found.select("file", "slide_number"), "slide_number")


@query("pkg_column_selection", f"SELECT file, n AS slide_number, CASE WHEN max(row) FILTER (col = 1) > 0 THEN 'size,line' END AS headers FROM ({CELLS}) GROUP BY file, n")
def pkg_column_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.extract(view(spark, sf_dir), columns={"specific": ["SIZE"], "patterns": ["^l"], "exclude": ["none"], "all_columns": False})
    return longs(found.select("file", "slide_number", F.array_join("headers", ",").alias("headers")), "slide_number")


@query("pkg_table_totals", f"SELECT count(DISTINCT (file, n)) AS total_tables, count(DISTINCT (file, n, row)) AS total_rows, count(DISTINCT (file, n)) AS slides_with_tables, 0::BIGINT AS bold_cells FROM ({CELLS})")
def pkg_table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.totals(cells(spark, sf_dir)).select("total_tables", "total_rows", "slides_with_tables", "bold_cells")


# Conditions on columns of slides and tables.
@query("pkg_is_empty", f"SELECT file, n AS slide_number FROM ({S}) WHERE trim(coalesce(title, '')) = ''")
def pkg_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(pipeline.run(view(spark, sf_dir), {"filters": [{"field": "title", "condition": "is_empty"}]}, "slide_number").select("file", "slide_number"), "slide_number")


@query("pkg_not_empty", f"SELECT file, n AS slide_number FROM ({S}) WHERE trim(coalesce(subtitle, '')) <> '' OR tabled")
def pkg_not_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"filter_logic": "OR", "filters": [{"field": "subtitle", "condition": "not_empty"}, {"field": "tables", "condition": "not_empty"}]}
    return longs(pipeline.run(view(spark, sf_dir), spec, "slide_number").select("file", "slide_number"), "slide_number")


@query("pkg_numeric_text", f"SELECT file, n AS slide_number, value FROM ({CELLS}) WHERE try_cast(value AS DOUBLE) >= 20")
def pkg_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers among other text."""
    spec = {"filters": [{"field": "value", "condition": "greater_equal", "value": "20"}]}
    return longs(pipeline.run(cells(spark, sf_dir), spec, "row").select("file", "slide_number", "value"), "slide_number")


@query("pkg_has_formatting", f"SELECT file, n AS slide_number, r FROM (SELECT file, n, unnest(range(1, len(lines) + 1)) AS r, role FROM ({S})) WHERE (r = 1 AND role = 'user') OR r IN (2, 3, 4)")
def pkg_has_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of bodies that are bold, underlined, highlighted or coloured."""
    runs = view(spark, sf_dir).select("file", "slide_number", F.explode("shapes").alias("s")).where("s.ph_type = 'body'").select("file", "slide_number", F.posexplode("s.paras").alias("r", "p"))
    runs = runs.select("file", "slide_number", (F.col("r") + 1).alias("r"), F.col("p")[0].alias("f")).withColumn("f", F.struct("f.bold", "f.underline", "f.highlight", "f.color"))
    return longs(pipeline.run(runs, {"filters": [{"field": "f", "condition": "has_formatting"}]}, "r").select("file", "slide_number", "r"), "slide_number", "r")


# Formatting.
@query("pkg_runs", f"SELECT file, n AS slide_number, text, start, CASE WHEN kind = 'cell' THEN 'table' ELSE 'shape' END AS container FROM ({RUNS})")
def pkg_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(formatting.runs(view(spark, sf_dir)).select("file", "slide_number", "text", "start", "container"), "slide_number", "start")


for _kind, (_where, _info) in KINDS.items():
    query(f"pkg_segments_{_kind}", f"SELECT file, n AS slide_number, text, start, start + length(text) AS \"end\", {_info} AS info FROM ({RUNS}) WHERE {_where} AND text <> ''")(
        lambda spark, sf_dir, kind=_kind: longs(formatting.segments(view(spark, sf_dir), kind), "slide_number", "start", "end")
    )


@query("pkg_extraction_summary", f"""SELECT s.file, any_value(s.total) AS slides_analyzed, count(DISTINCT CASE WHEN h.n IS NOT NULL THEN h.n END) AS slides_with_formatting, count(h.n) AS total_segments
    FROM (SELECT DISTINCT file, total FROM ({S})) s LEFT JOIN (SELECT file, n FROM ({RUNS}) WHERE {KINDS['underlined'][0]} AND text <> '') h USING (file) GROUP BY s.file""")  # fmt: skip
def pkg_extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.extraction_summary(written_view(spark, sf_dir), "underlined")


@query("pkg_elements", f"""SELECT file, n AS slide_number, content_type, text_content, bold AS bold_count, italic AS italic_count, underline AS underline_count, strike AS strikethrough_count, highlight AS highlight_count,
    array_to_string(sizes, ',') AS font_sizes, colored, linked, has_formatting FROM ({HELD})""")  # fmt: skip
def pkg_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting.elements(view(spark, sf_dir)).withColumns({"font_sizes": F.array_join(F.col("font_sizes").cast("array<string>"), ","), "colored": F.size("font_colors") > 0, "linked": F.size("hyperlinks") > 0})
    return longs(found.drop("container", "a", "b", "c", "font_colors", "hyperlinks"), "slide_number")


@query("pkg_elements_filtered", f"SELECT file, n AS slide_number, text_content FROM ({HELD}) WHERE (bold > 0 OR linked) AND content_type = 'text_boxes' AND list_avg(sizes) BETWEEN 18 AND 21 AND contains(lower(text_content), 'an')")
def pkg_elements_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting.filtered(formatting.elements(view(spark, sf_dir)), ["bold", "hyperlink"], ["text_boxes"], "AN", min_font_size=18, max_font_size=21)
    return longs(found.select("file", "slide_number", "text_content"), "slide_number")


@query("pkg_elements_by_color", f"SELECT file, n AS slide_number, content_type FROM ({HELD}) WHERE colored AND regexp_matches(text_content, '^[a-k]', 'i')")
def pkg_elements_by_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting.filtered(formatting.elements(view(spark, sf_dir)), colors=["#FF0000"], text_patterns=["^[a-k]"])
    return longs(found.select("file", "slide_number", "content_type"), "slide_number")


HISTOGRAM = "(SELECT file, string_agg(k || '=' || c, ',' ORDER BY k) AS {1} FROM (SELECT file, {0} AS k, count(*) AS c FROM {2} GROUP BY ALL) GROUP BY file)"


@query("pkg_formatting_summary", f"""WITH h AS ({HELD}), t AS (SELECT file, count(*) AS total_elements, count(*) FILTER (has_formatting) AS formatted_elements, sum(bold)::BIGINT AS bold_count, sum(highlight)::BIGINT AS highlight_count,
      count(*) FILTER (colored) AS colored_elements, count(*) FILTER (linked) AS hyperlink_elements FROM h GROUP BY file)
    SELECT * FROM t LEFT JOIN {HISTOGRAM.format("n::VARCHAR", "by_slide", "h")} USING (file) LEFT JOIN {HISTOGRAM.format("content_type", "by_content", "h")} USING (file)
      LEFT JOIN {HISTOGRAM.format("s::VARCHAR", "by_size", "(SELECT file, unnest(sizes) AS s FROM h)")} USING (file) LEFT JOIN {HISTOGRAM.format("'#FF0000'", "by_color", "(SELECT file FROM h WHERE colored)")} USING (file)""")  # fmt: skip
def pkg_formatting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting.summary(formatting.elements(view(spark, sf_dir)))
    listed = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    names = {"slide_distribution": "by_slide", "content_type_distribution": "by_content", "font_size_distribution": "by_size", "color_distribution": "by_color"}
    return found.select("file", "total_elements", "formatted_elements", "bold_count", "highlight_count", "colored_elements", "hyperlink_elements", *(listed(c).alias(n) for c, n in names.items()))


GROUPS = {
    "by_slide": "['slide_' || n]", "by_content_type": "[content_type]", "by_color": "[CASE WHEN colored THEN '#FF0000' ELSE 'no_color' END]", "by_font_size": "['size_' || floor(list_avg(sizes))::INT]", "none": "['all']",
    "by_formatting_type": """list_filter([CASE WHEN bold > 0 THEN 'bold' END, CASE WHEN italic > 0 THEN 'italic' END, CASE WHEN underline > 0 THEN 'underline' END, CASE WHEN highlight > 0 THEN 'highlight' END,
        CASE WHEN strike > 0 THEN 'strikethrough' END, CASE WHEN colored THEN 'color' END, CASE WHEN linked THEN 'hyperlink' END], lambda x: x IS NOT NULL)""",
}
for _grouping, _keys in GROUPS.items():
    query(f"pkg_groups_{_grouping}", f"SELECT file, group_key, count(*) AS n FROM (SELECT file, unnest({_keys}) AS group_key FROM ({HELD})) GROUP BY ALL")(
        lambda spark, sf_dir, g=_grouping: formatting.groups(formatting.elements(view(spark, sf_dir)), g).groupBy("file", "group_key").agg(F.count("*").alias("n"))
    )


@query("pkg_marked_up", f"""SELECT file, n AS slide_number, array_to_string(list_transform(lines, lambda x, i: CASE WHEN i = 1 AND role = 'user' THEN '<b>' || x || '</b>' WHEN i = 1 AND role = 'assistant' THEN '<i>' || x || '</i>'
    WHEN i = 1 THEN '<s>' || x || '</s>' WHEN i = 3 THEN '<u>' || x || '</u>' WHEN i = 4 THEN '<mark>' || x || '</mark>' ELSE x END), ' ') AS marked FROM ({S})""")  # fmt: skip
def pkg_marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.filter("shapes", lambda s: s["ph_type"] == "body")[0]["paras"]
    return longs(view(spark, sf_dir).select("file", "slide_number", formatting.marked_up(body).alias("marked")), "slide_number")


# Analysis.
SLIDES = f"SELECT *, {' + '.join(COUNTS)} AS objects, list_filter([title, subtitle, nullif(body, '')], lambda x: x IS NOT NULL) AS texts FROM ({COUNTED})"
TYPED = f"""SELECT *, CASE WHEN title IS NOT NULL AND subtitle IS NULL AND shapes <= 2 AND objects <= 3 THEN 'title_slide' WHEN title IS NOT NULL AND subtitle IS NOT NULL AND objects <= 4 THEN 'section_header'
    WHEN tables > 0 AND tables >= objects * 0.5 THEN 'table_slide' WHEN charts > 0 AND charts >= objects * 0.4 THEN 'chart_slide' WHEN images > 0 AND images >= objects * 0.4 THEN 'image_slide'
    WHEN len(texts) > 0 AND (len(texts) >= 3 OR length(t) - length(replace(replace(replace(t, '•', ''), '-', ''), '*', '')) >= 3) THEN 'bullet_slide' WHEN objects = 0 THEN 'blank_slide'
    WHEN (shapes > 0)::INT + (text_boxes > 0)::INT + (images > 0)::INT + (tables > 0)::INT + (charts > 0)::INT + (connectors > 0)::INT >= 3 THEN 'mixed_content' ELSE 'content_slide' END AS slide_type
  FROM (SELECT *, array_to_string(texts, ' ') AS t, list_sum(list_transform(texts, lambda x: length(x)))::DOUBLE AS size FROM ({SLIDES}))"""
SCORED = f"""SELECT *, 1 + 0.5 * tables + 0.5 * charts + CASE WHEN size > 200 THEN 0.5 ELSE 0 END + CASE WHEN length(coalesce(notes, '')) > 100 THEN 0.3 ELSE 0 END::DOUBLE AS minutes,
    (least(objects / 5, 1) + least(size / 500, 1) + least(tables / 2, 1) + least(charts / 2, 1)) / 4 AS complexity,
    (CASE WHEN size <= 200 THEN 1 ELSE greatest(0, 1 - (size - 200) / 500) END + CASE WHEN len(texts) <= 5 THEN 1 ELSE greatest(0, 1 - (len(texts) - 5) / 10) END + CASE WHEN title IS NOT NULL THEN 1 ELSE 0.5 END) / 3 AS readability FROM ({TYPED})"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.view(view(spark, sf_dir))


@query("pkg_classified", f"""SELECT file, n AS slide_number, slide_type, concat_ws(' | ', 'Title: ' || left(title, 50), CASE WHEN len(texts) > 0 THEN CASE WHEN length(texts[1]) > 100 THEN left(texts[1], 100) || '...' ELSE texts[1] END END,
    CASE WHEN tables > 0 THEN tables || ' tables' END, CASE WHEN charts > 0 THEN charts || ' charts' END, CASE WHEN images > 0 THEN images || ' images' END) AS content_summary FROM ({TYPED})""")  # fmt: skip
def pkg_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(analysis.classified(rows(spark, sf_dir)).select("file", "slide_number", "slide_type", "content_summary"), "slide_number")


@query("pkg_insights", f"""WITH s AS ({SCORED}), k AS (SELECT file, slide_type, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT file, count(*) AS kinds, max(c) AS most FROM k GROUP BY file),
    l AS (SELECT DISTINCT file, true AS long FROM (SELECT file, slide_type, n - row_number() OVER (PARTITION BY file, slide_type ORDER BY n) AS g FROM s WHERE slide_type <> 'content_slide') GROUP BY file, slide_type, g HAVING count(*) > 5),
    f AS (SELECT file, count(*) AS slides, sum(minutes) AS minutes, avg(objects) AS mean, max(objects) AS hi, min(objects) AS lo, count(*) FILTER (title IS NULL) AS untitled, count(*) FILTER (coalesce(notes, '') <> '') AS notes_count,
      count(*) FILTER (slide_type = 'title_slide') AS titles, count(*) FILTER (slide_type IN ('table_slide', 'chart_slide', 'image_slide')) AS visuals, count(*) FILTER (slide_type = 'bullet_slide') AS bullets FROM s GROUP BY file)
    SELECT file, slides, round(minutes, 1) AS estimated_minutes, CASE WHEN mean <= 3 THEN 'low' WHEN mean <= 6 THEN 'medium' ELSE 'high' END AS content_density,
      CASE WHEN kinds >= 4 AND most / slides <= 0.7 THEN 'well_balanced' WHEN kinds >= 3 AND most / slides <= 0.8 THEN 'balanced' WHEN most / slides >= 0.9 THEN 'monotonous' ELSE 'somewhat_balanced' END AS visual_balance, notes_count,
      concat_ws(';', CASE WHEN titles = 0 THEN 'no title slide' END, CASE WHEN long THEN 'long run of one slide type' END, CASE WHEN slides < 3 THEN 'very short presentation' END) AS issues,
      concat_ws(';', CASE WHEN untitled > 0 AND slides - untitled > untitled THEN untitled || ' slides without titles' END, CASE WHEN hi > 5 * lo AND hi > 10 THEN 'large variation of content between slides' END) AS consistency_issues,
      concat_ws(';', CASE WHEN slides BETWEEN 5 AND 20 THEN 'fitting length' END, CASE WHEN kinds >= 4 THEN 'varied slides' END, CASE WHEN visuals > slides * 0.3 THEN 'much to see' END, CASE WHEN titles > 0 AND slides >= 3 AND long IS NULL THEN 'sound structure' END) AS strengths,
      concat_ws(';', CASE WHEN bullets > slides * 0.7 THEN 'too many lists' END, CASE WHEN visuals < slides * 0.2 THEN 'too little to see' END, CASE WHEN titles = 0 OR slides < 3 OR long THEN 'structure' END,
        CASE WHEN (untitled > 0 AND slides - untitled > untitled) OR (hi > 5 * lo AND hi > 10) THEN 'consistency' END) AS improvement_areas
    FROM f JOIN m USING (file) LEFT JOIN l USING (file)""")  # fmt: skip
def pkg_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("issues", "consistency_issues", "strengths", "improvement_areas")
    found = analysis.insights(storage.written(rows(spark, sf_dir), "rows"))
    return found.select("file", "slides", F.col("estimated_minutes").cast("double").alias("estimated_minutes"), "content_density", "visual_balance", "notes_count", *(F.array_join(c, ";").alias(c) for c in lists))


@query("pkg_slide_scores", f"SELECT file, n AS slide_number, round(complexity, 6)::DOUBLE AS complexity, round(readability, 6)::DOUBLE AS readability, minutes::DOUBLE AS minutes FROM ({SCORED})")
def pkg_slide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.slide_scores(rows(spark, sf_dir))
    return found.select("file", F.col("slide_number").cast("long").alias("slide_number"), F.round(F.col("complexity").cast("double"), 6).alias("complexity"), F.round(F.col("readability").cast("double"), 6).alias("readability"), F.col("minutes").cast("double").alias("minutes"))


@query("pkg_bigrams", f"""WITH p AS (SELECT file, slide_type || ' -> ' || lead(slide_type) OVER (PARTITION BY file ORDER BY n) AS sequence FROM ({TYPED}))
    SELECT file, sequence, count(*) AS occurrences FROM p WHERE sequence IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def pkg_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.bigrams(analysis.classified(rows(spark, sf_dir)), ["file"], "slide_number", "slide_type", 2)


@query("pkg_patterns", f"""WITH b AS (SELECT file, n FROM (SELECT *, array_to_string(list_filter([title, subtitle, nullif(body, '')], lambda x: x IS NOT NULL), ' ') AS t FROM ({S})) WHERE length(t) - length(replace(replace(replace(t, '•', ''), '-', ''), '*', '')) >= 3),
    p AS (SELECT file, slide_type || ' -> ' || lead(slide_type) OVER (PARTITION BY file ORDER BY n) AS sequence FROM ({TYPED}))
    SELECT file, 'content_structure' AS pattern_type, 'consistent_bullets' AS pattern_name, count(*) AS occurrences FROM b GROUP BY file HAVING count(*) >= 5
    UNION ALL SELECT file, 'layout_sequence', 'repeated_sequence', count(*) FROM p WHERE sequence IS NOT NULL GROUP BY file, sequence HAVING count(*) >= 3""")  # fmt: skip
def pkg_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.patterns(rows(spark, sf_dir)).select("file", "pattern_type", "pattern_name", "occurrences")


@query("pkg_sample", f"SELECT file, n AS slide_number, CASE WHEN n <= 5 THEN title END AS title, CASE WHEN n <= 3 THEN len(texts[1:2]) END AS texts FROM ({SLIDES}) WHERE n <= 5")
def pkg_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.sample(rows(spark, sf_dir))
    return longs(found.select("file", "slide_number", "title", F.when(F.col("texts").isNotNull(), F.size("texts")).alias("texts")), "slide_number", "texts")


@query("pkg_overview", f"SELECT file, count(*) AS slides, count(*) AS classified, string_agg(title, ',' ORDER BY n) FILTER (n <= 5) AS sample_titles FROM ({TYPED}) GROUP BY file")
def pkg_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.overview(rows(spark, sf_dir), "detailed")
    titles = F.array_join("sample_titles", ",")
    return longs(found.select("file", "slides", F.size("classifications").alias("classified"), F.when(titles != "", titles).alias("sample_titles")), "classified")


#: The whole analysis of every deck, as nested lists.
ANALYSED = f"""WITH s AS ({SCORED}), k AS (SELECT file, slide_type, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT file, count(*) AS kinds, max(c) AS most, list(slide_type || ':' || c ORDER BY slide_type) AS slide_types FROM k GROUP BY file),
    l AS (SELECT DISTINCT file, true AS long FROM (SELECT file, slide_type, n - row_number() OVER (PARTITION BY file, slide_type ORDER BY n) AS g FROM s WHERE slide_type <> 'content_slide') GROUP BY file, slide_type, g HAVING count(*) > 5),
    f AS (SELECT file, count(*) AS slides, sum(minutes) AS minutes, avg(complexity) AS cx, avg(readability) AS rd, avg(objects) AS mean, max(objects) AS hi, min(objects) AS lo, count(*) FILTER (title IS NULL) AS untitled, count(*) FILTER (coalesce(notes, '') <> '') AS notes_count, coalesce(sum(length(notes)), 0)::BIGINT AS notes_length,
      count(*) FILTER (slide_type = 'title_slide') AS titles, count(*) FILTER (slide_type = 'blank_slide') AS blanks, count(*) FILTER (slide_type IN ('table_slide', 'chart_slide', 'image_slide')) AS visuals, count(*) FILTER (slide_type = 'bullet_slide') AS bullets,
      list(n ORDER BY n) FILTER (objects > 8) AS crowded, list(slide_type ORDER BY n) AS content_flow, list_distinct(list(section)) AS sections, list(title ORDER BY n) FILTER (n <= 5 AND title IS NOT NULL) AS sample_titles,
      flatten(list(list_transform(texts[1:2], lambda t: CASE WHEN length(t) > 100 THEN left(t, 97) || '...' ELSE t END) ORDER BY n) FILTER (n <= 3)) AS sample_texts FROM s GROUP BY file),
    b AS (SELECT file, n FROM s WHERE length(t) - length(replace(replace(replace(t, '•', ''), '-', ''), '*', '')) >= 3),
    q AS (SELECT file, slide_type || ' -> ' || lead(slide_type) OVER (PARTITION BY file ORDER BY n) AS sequence FROM s),
    p AS (SELECT file, 'content_structure' AS kind, 'consistent_bullets' AS name, count(*) AS c, list(n ORDER BY n) AS places, ['bullets', 'bullets', 'bullets'] AS examples FROM b GROUP BY file HAVING count(*) >= 5
      UNION ALL SELECT file, 'layout_sequence', 'repeated_sequence', count(*), [], [sequence] FROM q WHERE sequence IS NOT NULL GROUP BY file, sequence HAVING count(*) >= 3),
    o AS (SELECT file, list(concat_ws('/', kind, name, c, array_to_string(places, '.'), array_to_string(examples, '.')) ORDER BY kind, name, c, places, examples) AS patterns FROM p GROUP BY file)
    SELECT f.*, kinds, most, slide_types, long, coalesce(patterns, []) AS patterns, untitled > 0 AND slides - untitled > untitled AS untitled_some, hi > 5 * lo AND hi > 10 AS varied FROM f JOIN m USING (file) LEFT JOIN l USING (file) LEFT JOIN o USING (file)"""
LISTED = {
    "issues": "concat_ws(';', CASE WHEN titles = 0 THEN 'no title slide' END, CASE WHEN long THEN 'long run of one slide type' END, CASE WHEN blanks > 0 THEN blanks || ' blank slides' END, CASE WHEN slides < 3 THEN 'very short presentation' END, CASE WHEN slides > 50 THEN 'very long presentation' END)",
    "consistency_issues": "concat_ws(';', CASE WHEN untitled_some THEN untitled || ' slides without titles' END, CASE WHEN varied THEN 'large variation of content between slides' END)",
    "recommendations": "concat_ws(';', CASE WHEN titles = 0 THEN 'begin with a title slide' END, CASE WHEN slides > 30 THEN 'split into shorter presentations' END, CASE WHEN len(crowded) > 3 THEN 'simplify crowded slides: ' || array_to_string(crowded, ', ') END, CASE WHEN untitled_some OR varied THEN 'settle inconsistencies' END, CASE WHEN bullets > slides * 0.6 THEN 'show more and list less' END)",
}
DENSITY = "CASE WHEN mean <= 3 THEN 'low' WHEN mean <= 6 THEN 'medium' ELSE 'high' END"
BALANCE = "CASE WHEN kinds >= 4 AND most / slides <= 0.7 THEN 'well_balanced' WHEN kinds >= 3 AND most / slides <= 0.8 THEN 'balanced' WHEN most / slides >= 0.9 THEN 'monotonous' ELSE 'somewhat_balanced' END"


def listed_patterns(c: str) -> Column:
    dotted = lambda x: F.array_join(F.transform(x, lambda k: k.cast("string")), ".")
    return F.transform(c, lambda p: F.concat_ws("/", p["pattern_type"], p["pattern_name"], p["occurrences"].cast("string"), dotted(p["slides"]), dotted(p["examples"])))


def listed_types(c: str) -> Column:
    return F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))


@query("pkg_whole_overview", f"""SELECT file, slides, round(minutes, 1)::DOUBLE AS estimated_minutes, round(minutes * 0.8, 1)::DOUBLE AS least_minutes, round(minutes * 1.2, 1)::DOUBLE AS most_minutes, round(cx * 10, 1)::DOUBLE AS complexity_score, round(rd * 10, 1)::DOUBLE AS readability_score,
    {DENSITY} AS content_density, {BALANCE} AS visual_balance, slide_types, notes_count, notes_length, {", ".join(f"{v} AS {k}" for k, v in LISTED.items())}, content_flow AS classified, patterns, coalesce(sample_titles, []) AS sample_titles, coalesce(sample_texts, []) AS sample_texts FROM ({ANALYSED})""")  # fmt: skip
def pkg_whole_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of an overview, from packages that are read and grouped once."""
    found = analysis.overview(rows(spark, sf_dir), "comprehensive")
    doubles = ("estimated_minutes", "least_minutes", "most_minutes", "complexity_score", "readability_score")
    return found.select(
        "file", "slides", *(F.col(c).cast("double").alias(c) for c in doubles), "content_density", "visual_balance", listed_types("slide_types").alias("slide_types"), "notes_count", "notes_length",
        *(F.array_join(c, ";").alias(c) for c in LISTED), F.col("classifications.slide_type").alias("classified"), listed_patterns("patterns").alias("patterns"), "sample_titles", "sample_texts",
    )


FORMATS = f"SELECT file, count(*) AS total_elements, count(*) FILTER (has_formatting) AS formatted_elements, sum(bold)::BIGINT AS bold_count, sum(italic)::BIGINT AS italic_count, sum(highlight)::BIGINT AS highlight_count, count(*) FILTER (colored) AS colored_elements, count(*) FILTER (linked) AS hyperlink_elements FROM ({HELD}) GROUP BY file"


@query("pkg_analysis", f"""SELECT file, slides AS total_slides, slide_types, list_sort(sections) AS sections, content_flow, {LISTED["issues"]} AS structural_issues, patterns, round(rd * 10, 1)::DOUBLE AS readability_score, {DENSITY} AS content_density, {BALANCE} AS visual_balance,
    {LISTED["consistency_issues"]} AS consistency_issues, {LISTED["recommendations"]} AS recommendations, total_elements, formatted_elements, bold_count, italic_count, highlight_count, colored_elements, hyperlink_elements
    FROM ({ANALYSED}) JOIN ({FORMATS}) USING (file)""")  # fmt: skip
def pkg_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, formatting and structure of every deck at once."""
    found = decks.analyse(view(spark, sf_dir), "detailed")
    shown = ("total_elements", "formatted_elements", "bold_count", "italic_count", "highlight_count", "colored_elements", "hyperlink_elements")
    return found.select(
        "file", "structure.total_slides", listed_types("structure.slide_types").alias("slide_types"), F.array_sort("structure.sections").alias("sections"), "structure.content_flow", F.array_join("structure.structural_issues", ";").alias("structural_issues"),
        listed_patterns("content_patterns").alias("patterns"), F.col("insights.readability_score").cast("double").alias("readability_score"), "insights.content_density", "insights.visual_balance",
        F.array_join("insights.consistency_issues", ";").alias("consistency_issues"), F.array_join("insights.recommendations", ";").alias("recommendations"), *(f"formatting_analysis.{c}" for c in shown),
    )


@query("pkg_overview_formatting", f"SELECT s.file, s.total AS slides, h.c AS total_elements, h.b AS bold_count FROM (SELECT DISTINCT file, total FROM ({S})) s LEFT JOIN (SELECT file, count(*) AS c, sum(bold)::BIGINT AS b FROM ({HELD}) GROUP BY file) h USING (file)")
def pkg_overview_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written_view(spark, sf_dir)
    joined = analysis.with_formatting(analysis.overview(analysis.view(found), "basic", False), formatting.summary(formatting.elements(found)))
    return joined.select("file", "slides", "formatting.total_elements", "formatting.bold_count")


# Inherited formatting: decks that state defaults at every level, each for some of the slides.
STYLED = """SELECT file, conv_id, n, i, x, (i - 1) % 3 AS lvl, conv_id % 2 = 0 AS deck, conv_id % 3 = 0 AS deck_all, n % 2 = 0 AS shape, n % 3 = 0 AS shape_all, i % 4 = 0 AS para, i % 5 = 0 AS run
    FROM (SELECT file, conv_id, n, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM (SELECT conv_id, 'deck-' || conv_id || '.pptx' AS file, string_split(text, chr(10)) AS lines, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations))"""


def styled_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as slides: lines are paragraphs at list levels 0 to 2, and every level states defaults now and then."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    rows = rows.withColumns({"n": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")), "lines": F.split("text", "\n")})
    style = lambda lvl, size, bold, color, bullet: F.struct(F.lit(lvl).alias("lvl"), F.lit(size).cast("int").alias("size"), F.lit(bold).cast("boolean").alias("bold"), F.lit(color).cast("string").alias("color"), F.lit(bullet).cast("string").alias("bullet"))
    given = lambda *pairs: F.array_compact(F.array(*(F.when(when, s) for when, s in pairs)))
    conv, n = F.col("conv_id"), F.col("n")
    deck = given((conv % 2 == 0, style(1, 1100, None, "0000AA", "-")), (conv % 3 == 0, style(-1, 1000, True, None, "#")))
    own = given((n % 2 == 0, style(0, 2100, True, None, "*")), (n % 3 == 0, style(-1, None, False, "00AA00", None)))

    def para(x: Column, i: Column) -> Column:
        fourth, fifth = (i + 1) % 4 == 0, (i + 1) % 5 == 0
        run = F.struct(x.alias("text"), F.when(fifth, 3000).alias("size"), F.when(fifth, False).alias("bold"), F.when(fifth, "FF0000").alias("color"))
        return F.struct((i % 3).alias("lvl"), F.when(fourth, 1500).alias("size"), F.lit(None).cast("boolean").alias("bold"), F.when(fourth, "AAAAAA").alias("color"), F.when(fourth, "").alias("bullet"), F.array(run).alias("runs"))

    return rows.select(F.concat(F.lit("deck-"), conv.cast("string"), F.lit(".pptx")).alias("file"), n.alias("slide_number"), deck.alias("deck"), own.alias("styles"), F.transform("lines", para).alias("paras"))


EFFECTIVE = f"""SELECT file, n AS slide_number, i - 1 AS para, x AS text, lvl, CASE WHEN run THEN 30.0 WHEN para THEN 15.0 WHEN shape AND lvl = 0 THEN 21.0 WHEN deck AND lvl = 1 THEN 11.0 WHEN deck_all THEN 10.0 ELSE 18.0 END::DOUBLE AS size,
    CASE WHEN run THEN 'run' WHEN para THEN 'paragraph' WHEN shape AND lvl = 0 THEN 'shape_level' WHEN deck AND lvl = 1 THEN 'deck_level' WHEN deck_all THEN 'deck' ELSE 'default' END AS size_from,
    CASE WHEN run THEN false WHEN shape AND lvl = 0 THEN true WHEN shape_all THEN false WHEN deck_all THEN true ELSE false END AS bold,
    CASE WHEN run THEN '#FF0000' WHEN para THEN '#AAAAAA' WHEN shape_all THEN '#00AA00' WHEN deck AND lvl = 1 THEN '#0000AA' END AS color,
    CASE WHEN para THEN 'none' WHEN shape AND lvl = 0 THEN 'char' WHEN deck AND lvl = 1 THEN 'char' WHEN deck_all THEN 'number' ELSE 'none' END AS bullet,
    CASE WHEN para THEN NULL WHEN shape AND lvl = 0 THEN '*' WHEN deck AND lvl = 1 THEN '-' WHEN deck_all THEN 'arabicPeriod' END AS mark FROM ({STYLED})"""


@query("pkg_effective_formatting", EFFECTIVE)
def pkg_effective_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inheritance.effective(styles.paragraphs(writer.styled_of(styled_decks(spark, sf_dir), tasks(spark, sf_dir))))
    return longs(found.select("file", "slide_number", "para", "text", "lvl", "size", "size_from", "bold", "color", "bullet", "mark"), "slide_number", "para", "lvl")


@query("pkg_bullets", f"SELECT file, slide_number, para, lvl, bullet, mark, text AS text_content FROM ({EFFECTIVE}) WHERE bullet <> 'none' AND trim(text) <> ''")
def pkg_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inheritance.bullets(inheritance.effective(styles.paragraphs(writer.styled_of(styled_decks(spark, sf_dir), tasks(spark, sf_dir)))))
    return longs(found.drop("shape"), "slide_number", "para", "lvl")


# The graph of parts: a conversation's turns are slides with layouts, notes, pictures that aren't there, and parts that nothing leads to.
TURNS = "SELECT conv_id, 'deck-' || conv_id || '.pptx' AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations"
EDGES = f"""SELECT DISTINCT file, '' AS source, 'officeDocument' AS type, 'ppt/presentation.xml' AS target, false AS external FROM ({TURNS})
    UNION ALL SELECT DISTINCT file, '', 'customXml', 'customXml/item4.xml', false FROM ({TURNS}) WHERE conv_id % 3 = 0 UNION ALL SELECT DISTINCT file, 'ppt/presentation.xml', 'slideMaster', 'ppt/slideMasters/slideMaster1.xml', false FROM ({TURNS})
    UNION ALL SELECT file, 'ppt/presentation.xml', 'slide', 'ppt/slides/slide' || n || '.xml', false FROM ({TURNS}) UNION ALL SELECT file, 'ppt/slides/slide' || n || '.xml', 'slideLayout', 'ppt/slideLayouts/slideLayout' || (1 + n % 3) || '.xml', false FROM ({TURNS})
    UNION ALL SELECT file, 'ppt/slides/slide' || n || '.xml', 'notesSlide', 'ppt/notesSlides/notesSlide' || n || '.xml', false FROM ({TURNS}) WHERE n % 2 = 1 UNION ALL SELECT file, 'ppt/notesSlides/notesSlide' || n || '.xml', 'slide', 'ppt/slides/slide' || n || '.xml', false FROM ({TURNS}) WHERE n % 2 = 1
    UNION ALL SELECT file, 'ppt/slides/slide' || n || '.xml', 'image', 'ppt/media/image' || n || '.png', false FROM ({TURNS}) WHERE n % 5 = 0 UNION ALL SELECT file, 'ppt/slides/slide' || n || '.xml', 'hyperlink', 'https://example.com/../' || n, true FROM ({TURNS}) WHERE n % 2 = 0
    UNION ALL SELECT DISTINCT file, 'ppt/slideLayouts/slideLayout' || k || '.xml', 'slideMaster', 'ppt/slideMasters/slideMaster1.xml', false FROM ({TURNS}), (VALUES (1), (2), (3)) v(k) WHERE k < 3 OR conv_id % 2 = 1"""
HELD_PARTS = f"""SELECT DISTINCT file, 'ppt/' || p AS name FROM ({TURNS}), (VALUES ('presentation.xml'), ('slideMasters/slideMaster1.xml'), ('slideLayouts/slideLayout1.xml'), ('slideLayouts/slideLayout2.xml'), ('slideLayouts/slideLayout3.xml')) v(p)
    UNION ALL SELECT file, 'ppt/slides/slide' || n || '.xml' FROM ({TURNS}) UNION ALL SELECT file, 'ppt/notesSlides/notesSlide' || n || '.xml' FROM ({TURNS}) WHERE n % 2 = 1 UNION ALL SELECT file, 'customXml/item' || n || '.xml' FROM ({TURNS}) WHERE n % 4 = 0"""
REACHED = f"WITH RECURSIVE e AS ({EDGES}), r(file, name) AS (SELECT DISTINCT file, '' FROM e UNION SELECT r.file, e.target FROM r JOIN e ON r.file = e.file AND r.name = e.source AND NOT e.external) SELECT file, name FROM r"


def graph_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, name, content of the parts; targets are relative, absolute and with escapes in turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    rows = rows.select("conv_id", F.concat(F.lit("deck-"), F.col("conv_id").cast("string"), F.lit(".pptx")).alias("file"), "n")
    s, n, conv = F.col("n").cast("string"), F.col("n"), F.col("conv_id")
    link = lambda kind, *target, mode="": F.concat(F.lit(f'<Relationship Id="{kind}" Type="http://x/{kind}"{mode} Target="'), *(F.lit(t) if isinstance(t, str) else t for t in target), F.lit('"/>'))
    rels = lambda *x: F.concat(F.lit(f'<Relationships xmlns="{ooxml.NS["rel"]}">'), *(F.coalesce(c, F.lit("")) for c in x), F.lit("</Relationships>"))
    part = lambda name, content=F.lit("<x/>"): F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), content.alias("content"))
    named = lambda folder, end=".xml": F.concat(F.lit(folder), s, F.lit(end))
    of_slide = F.array_compact(F.array(
        part(named("ppt/slides/slide")),
        part(named("ppt/slides/_rels/slide", ".xml.rels"), rels(
            link("slideLayout", "../slideLayouts/slideLayout", (1 + n % 3).cast("string"), ".xml"), F.when(n % 2 == 1, link("notesSlide", F.when(n % 3 == 0, "/ppt/").otherwise("../"), "notesSlides/notes%53lide", s, ".xml")),
            F.when(n % 5 == 0, link("image", "../media/../../ppt/media/image", s, ".png")), F.when(n % 2 == 0, link("hyperlink", "https://example.com/../", s, mode=' TargetMode="External"')))),
        F.when(n % 2 == 1, part(named("ppt/notesSlides/notesSlide"))), F.when(n % 2 == 1, part(named("ppt/notesSlides/_rels/notesSlide", ".xml.rels"), rels(link("slide", "../slides/slide", s, ".xml#top")))), F.when(n % 4 == 0, part(named("customXml/item")))))
    slides_of = F.concat_ws("", F.collect_list(link("slide", F.when(n % 2 == 0, "/ppt/").otherwise(""), "slides/slide", s, ".xml")))
    of_file = F.array_compact(F.array(
        part("[Content_Types].xml"), part("_rels/.rels", rels(link("officeDocument", F.when(conv % 2 == 1, "/").otherwise(""), "ppt/presentation.xml"), F.when(conv % 3 == 0, link("customXml", "customXml/item4.xml")))),
        part("ppt/presentation.xml"), part("ppt/_rels/presentation.xml.rels", rels(F.col("slides"), link("slideMaster", "slideMasters/slideMaster1.xml"))), part("ppt/slideMasters/slideMaster1.xml"), part("ppt/slideMasters/_rels/slideMaster1.xml.rels", F.lit("<broken")),
        *(part(f"ppt/slideLayouts/slideLayout{k}.xml") for k in (1, 2, 3)),
        *(F.when(F.lit(k < 3) | (conv % 2 == 1), part(f"ppt/slideLayouts/_rels/slideLayout{k}.xml.rels", rels(link("slideMaster", "../slideMasters/slideMaster1.xml")))) for k in (1, 2, 3))))
    every = rows.select("file", F.explode(of_slide).alias("p")).unionByName(rows.groupBy("file", "conv_id").agg(slides_of.alias("slides")).select("file", F.explode(of_file).alias("p")))
    return every.select("file", "p.name", F.col("p.content").cast("binary").alias("content"))


@query("pkg_graph_edges", EDGES)
def pkg_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(graph_parts(spark, sf_dir)).drop("rid")


@query("pkg_graph_reached", REACHED)
def pkg_graph_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(graph.edges(graph_parts(spark, sf_dir))).select("file", "name")


@query("pkg_graph_orphans", f"SELECT file, name FROM ({HELD_PARTS}) ANTI JOIN ({REACHED}) USING (file, name)")
def pkg_graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = graph_parts(spark, sf_dir)
    return graph.orphans(parts, graph.edges(parts)).select("file", "name")


@query("pkg_graph_dangling", f"SELECT e.file, source, target FROM ({EDGES}) e ANTI JOIN ({HELD_PARTS}) p ON e.file = p.file AND e.target = p.name WHERE NOT external")
def pkg_graph_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = graph_parts(spark, sf_dir)
    return graph.dangling(parts, graph.edges(parts)).drop("rid")


@query("pkg_graph_layouts", f"SELECT file, 'ppt/slides/slide' || n || '.xml' AS slide, 'ppt/slideLayouts/slideLayout' || (1 + n % 3) || '.xml' AS layout, CASE WHEN n % 3 < 2 OR conv_id % 2 = 1 THEN 'ppt/slideMasters/slideMaster1.xml' END AS master FROM ({TURNS})")
def pkg_graph_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layouts(graph.edges(graph_parts(spark, sf_dir)))


# Ranges.
@query("pkg_section_ranges", f"SELECT s.file, s.n AS slide_number, g.section FROM ({S}) s JOIN (SELECT file, section, min(n) AS a, max(n) AS b FROM ({S}) GROUP BY ALL UNION ALL SELECT file, 'whole', 1, max(n) FROM ({S}) GROUP BY file) g ON s.file = g.file AND s.n BETWEEN g.a AND g.b")
def pkg_section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides with the ranges of their sections, and with one over all slides in which those lie."""
    found = bronze(spark, sf_dir)
    placed = slides.sections(found).where("slide_number IS NOT NULL")
    own = placed.groupBy("file", "section").agg(F.min("slide_number").alias("first"), F.max("slide_number").alias("last"))
    whole = placed.groupBy("file").agg(F.lit("whole").alias("section"), F.lit(1).alias("first"), F.max("slide_number").alias("last")).select(*own.columns)
    return longs(ranges.range_join(slides.slides(found).select("file", "slide_number"), own.union(whole), ["file"], "slide_number", "first", "last"), "slide_number").select("file", "slide_number", "section")


# Runs that parse only what changed.
@query("pkg_incremental", f"""SELECT file, n AS slide_number, CASE WHEN conv_id % 3 = 0 AND n = 2 THEN 'changed' ELSE title END AS title, notes, section, CASE WHEN conv_id % 3 = 0 AND n = 2 THEN 2 ELSE 1 END::BIGINT AS parsed_run,
    CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS run FROM ({S})""")  # fmt: skip
def pkg_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decks are parsed; then the second slide of every third one changes, and a second run parses those slides."""
    decks_at, table = storage.new_dir(spark, "decks"), storage.new_dir(spark, "bronze")
    rows = deck_slides(spark, sf_dir)
    archive.write_packages(writer.packages_of(rows, tasks(spark, sf_dir)), decks_at).write.format("noop").mode("overwrite").save()
    incremental.refresh(spark, decks_at, table)
    third = F.regexp_extract("file", r"(\d+)", 1).cast("long") % 3 == 0
    new = rows.where(third).withColumn("title", F.when(F.col("slide_number") == 2, "changed").otherwise(F.col("title")))
    archive.write_packages(writer.packages_of(new, tasks(spark, sf_dir)), decks_at).write.format("noop").mode("overwrite").save()
    incremental.refresh(spark, decks_at, table)
    found = incremental.state(spark, table)
    also = found.where("kind = 'slide'").select("file", "slide_number", "part", "parsed_run", "run")
    shown = slides.slides(found).select("file", "part", "title", "notes", "section").join(also, ["file", "part"])
    return longs(shown.select(file_name(), "slide_number", "title", "notes", "section", "parsed_run", "run"), "slide_number", "parsed_run", "run")


# Slides as streams.
@query("pkg_streamed", f"""SELECT file, 'ppt/slides/slide' || (total - n + 1) || '.xml' AS part, kind, ph_type, place, shown AS text FROM ({S}) JOIN (
    SELECT file, n, 'para' AS kind, CASE WHEN o = 0 THEN CASE WHEN n = 1 THEN 'ctrTitle' ELSE 'title' END WHEN o = 1 THEN 'subTitle' ELSE 'body' END AS ph_type, CASE WHEN o = 2 THEN i - 1 ELSE 0 END::BIGINT AS place, text AS shown FROM ({RUNS}) WHERE kind <> 'cell'
    UNION ALL SELECT file, n, 'row', NULL, row, string_agg(value, '|' ORDER BY col) || CASE WHEN any_value(span) = 2 THEN '|' ELSE '' END FROM ({CELLS}) GROUP BY file, n, row) USING (file, n)""")  # fmt: skip
def pkg_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and table rows of the decks in a folder, pulled from their parts."""
    found = pull.pieces(archive.scan(spark, folder(spark, sf_dir)))
    text = lambda runs: F.array_join(F.transform(runs, lambda r: r["text"]), "")
    shown = F.when(F.col("kind") == "para", text(F.col("runs"))).otherwise(F.array_join(F.transform("cells", lambda c: text(F.flatten(c["paras"]))), "|"))
    return found.select(file_name(), "part", "kind", "ph_type", F.col("at").cast("long").alias("place"), shown.alias("text"))
