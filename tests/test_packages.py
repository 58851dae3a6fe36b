"""Packages from file to tables. Names of tests that mend a known fault of such tools say which (D1 to D24)."""

import pytest
from decks import grid, run, sample, shape, slide, write
from pyspark.sql import functions as F

from deckhand.operators import analysis, formatting, slides, tables
from deckhand.sources import ooxml
from deckhand.streaming import ingest


@pytest.fixture(scope="module")
def packages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("decks")
    sample(folder)
    (folder / "empty.pptx").write_bytes(b"")
    (folder / "text.pptx").write_bytes(b"not a zip")
    (folder / "note.txt").write_bytes(b"x")
    rows = ooxml.packages(spark, str(folder))
    path = str(tmp_path_factory.mktemp("bronze"))
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def view(packages):
    return slides.slides(packages).cache()


def numbers(df):
    return [r.slide_number for r in df.collect()]


def test_rejects(packages):
    assert sorted(r.error for r in packages.where("kind = 'reject'").collect()) == ["not a ZIP archive", "wrong extension"]  # the reader skips empty files


def test_d13_order_is_the_presentations(view):
    assert [(r.slide_number, r.part_number, r.title) for r in view.orderBy("slide_number").collect()] == [
        (1, 1, "Harbour report"), (2, 3, "Quay South repairs"), (3, 2, "Quay North repairs"), (4, 4, None),
    ]


def test_d3_sections(view):
    assert numbers(slides.query_slides(view, {"section": "main"})) == [2, 3]
    assert numbers(slides.query_slides(view, {"sections": ["START"]})) == [1]


def test_titles_and_content(view):
    q = lambda c: numbers(slides.query_slides(view, c))
    assert q({"title": {"contains": "repairs"}}) == [2, 3]
    assert q({"title": {"starts_with": "quay"}}) == [2, 3]
    assert q({"title": {"regex": "Quay (North|South)"}}) == [2, 3]
    assert q({"title": {"one_of": ["^Quay North", "report$"]}}) == [1, 3]
    assert q({"content": {"has_tables": True}}) == [3]
    assert q({"content": {"has_images": True}}) == [2]
    assert q({"content": {"contains_text": "BOLD"}}) == [3]
    assert q({"slide_numbers": [1, 3]}) == [1, 3]
    assert q({"slide_numbers": "3:"}) == [3, 4]
    assert numbers(slides.query_slides(view, {}, limit=2)) == [1, 2]


def test_d8_notes_by_relation(view):
    assert numbers(slides.query_slides(view, {"notes": {"contains": "say"}})) == [3]
    assert numbers(slides.query_slides(view, {"notes": {"is_empty": True}})) == [1, 2, 4]


def test_d15_object_counts(view):
    for content in ({"object_count_min": 5}, {"object_count": {"min": 5}}):
        assert numbers(slides.query_slides(view, {"content": content})) == [2, 3]


def test_d9_d14_fields(view):
    row = slides.query_slides(view, {"slide_numbers": 3}, ["layout_type", "notes", "section", "table_info", "preview_text_3boxes"]).first()
    assert (row.layout_type, row.notes, row.section) == ("titleOnly", "Say this", "Main")
    assert row.table_info[0].headers[0] == "Wide"
    assert row.preview_text_3boxes == "Quay North repairs | This is bold text"  # D24: the title's own shape isn't shown again


def test_d20_bad_specifications(view):
    with pytest.raises(ValueError, match="unknown fields"):
        slides.query_slides(view, {}, ["preview_text"])
    for bad in ({"title": "x"}, {"title": {"regex": "("}}, {"colour": 1}, {"content": {"has_tables": "yes"}}, {"content": {"object_count_min": 5, "object_count_max": 1}}):
        with pytest.raises(ValueError):
            slides.query_slides(view, bad)
    with pytest.raises(ValueError):
        slides.attributes(view, [])


def test_attributes(view):
    assert slides.attributes(view, ["title", "layout", "images"]).columns == ["file", "slide_number", "title", "layout_name", "layout_type", "images"]


def test_merged_cells_and_headers(view):
    cells = tables.cells(view).orderBy("row", "logical_col").select("row", "logical_col", "header", "value").collect()
    assert [tuple(c) for c in cells] == [
        (0, 0, "Wide", "Wide"), (0, 1, "Column 2", ""),
        (1, 0, "Wide", "1"), (1, 1, "Column 2", "2"), (1, 2, "Column 3", "3"), (2, 0, "Wide", "a"), (2, 1, "Column 2", "b"), (2, 2, "Column 3", "c"),
    ]


def test_d5_columns_by_header(view):
    flat = tables.flat(tables.selected(tables.cells(view), ["column 2"], all_columns=False), ["Column 2"]).orderBy("row").collect()
    assert [r["Column 2"] for r in flat] == ["2", "b"]
    assert tables.selected(tables.cells(view), patterns=["^Wi"], all_columns=False).select("header").distinct().collect()[0][0] == "Wide"
    assert tables.selected(tables.cells(view), exclude=["Wide"]).where("header = 'Wide'").count() == 0


def test_criteria_and_formats(view):
    assert tables.extract(view, criteria={"min_rows": 3, "header_contains": ["wid"]}).count() == 1
    assert tables.extract(view, criteria={"min_rows": 4}).count() == 0
    html = tables.extract(view, "html").first().html
    assert html.startswith('<table><tr><th colspan="2">Wide</th>') and "<td>c</td></tr></table>" in html
    assert tables.extract(view, "row_col_value").count() == 8
    assert len(tables.extract(view, "grouped_by_slide").first().tables) == 1
    assert tables.totals(tables.cells(view)).first().total_rows == 3


def test_d7_d10_segments_index_into_the_text(view):
    row = formatting.segments(view, "bold").first()
    assert (row.slide_number, row.text) == (3, "bold")
    whole = formatting.runs(view).where("slide_number = 3").orderBy("start").collect()
    text = ""
    for r in whole:
        text = text.ljust(r.start) + r.text
    assert text[row.start : row.end] == "bold"
    assert text.startswith("Quay North repairs This is bold text Wide")


def test_d6_d22_links_and_values(view):
    link = formatting.segments(view, "hyperlinks").first()
    assert (link.text, link.info) == ("site", "https://example.com")
    assert [tuple(r) for r in formatting.segments(view, "font_sizes").select("text", "info").collect()] == [(" x", "24.0")]
    assert formatting.segments(view, "font_colors").first().info == "#FF0000"
    assert slides.links(view).first().link_type == "external"


def test_d4_formatting_analysis(view):
    found = formatting.elements(view)
    total = formatting.summary(found).first()
    assert (total.bold_count, total.colored_elements, total.hyperlink_elements) == (1, 1, 1)
    assert formatting.filtered(found, formatting_types=["bold"]).count() == 1
    assert formatting.filtered(found, colors=["#FF0000"]).count() == 1
    assert formatting.filtered(found, min_font_size=40).count() == 3
    keys = {r.group_key for r in formatting.groups(found, "by_formatting_type").collect()}
    assert keys == {"bold", "color", "hyperlink"}
    assert formatting.histogram(found, "content_type").where("content_type = 'tables'").first().n == 7  # those with text
    assert formatting.extraction_summary(view, "bold").first().total_segments == 1


def test_presentation(packages):
    p = slides.presentations(packages).first()
    assert (p.slide_count, p.width_in, p.slide_masters, p.has_notes_master) == (4, 10.0, 1, False)
    assert slides.sections(packages).count() == 3


def test_analysis(view):
    rows = analysis.view(view)
    kinds = {r.slide_number: r.slide_type for r in analysis.classified(rows).collect()}
    assert kinds == {1: "section_header", 2: "mixed_content", 3: "mixed_content", 4: "blank_slide"}
    x = analysis.insights(rows).first()
    assert (x.slides, x.notes_count) == (4, 1)
    assert "1 blank slides" in x.issues and "no title slide" in x.issues
    assert x.estimated_minutes == 4.5
    assert analysis.sample(rows).count() == 4
    assert {r.pattern_name for r in analysis.patterns(rows).collect()} == set()


def test_d12_last_run_counts(spark):
    rows = spark.createDataFrame([("f", k, "t" if k > 2 else "s") for k in range(1, 10)], "file string, slide_number int, slide_type string")
    assert analysis.runs(rows).where("length > 5").first().first == 3


def test_d1_large_and_damaged_slides(spark, tmp_path):
    big = "word " * 300_000
    write(tmp_path / "big.pptx", [slide(shape(run(big))), "<p:sld", slide(grid([["x"]]))])
    found = slides.slides(ooxml.packages(spark, str(tmp_path))).orderBy("slide_number").collect()
    assert len(found[0].text_elements[0].text) == len(big.strip())
    assert found[1].error and found[1].slide_number == 2
    assert len(found[2].tables) == 1


def test_parts_and_census(spark, tmp_path):
    sample(tmp_path)
    found = ooxml.parts(spark, str(tmp_path))
    row = ooxml.census(found).first()
    assert (row.slides, row.notes, row.has_presentation) == (4, 1, True)
    assert [r.place for r in slides.numbered(found, "file", "name", r"/slide(\d+)\.xml$").orderBy("place").collect()] == [1, 2, 3, 4]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sample(tmp_path / "in")
    q = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert slides.slides(spark.read.parquet(str(tmp_path / "out"))).count() == 4


def test_rendering(spark, view):
    body = view.where("slide_number = 3").select(F.col("shapes")[1]["paras"].alias("p"))
    row = body.select(tables.html_runs(F.col("p")).alias("h"), tables.markdown_runs(F.col("p")).alias("m"), formatting.marked_up(F.col("p")).alias("x")).first()
    assert row.h == "This is <strong>bold</strong> text"
    assert row.m == "This is **bold** text"
    assert row.x == "This is <b>bold</b> text"
