"""Inputs on which operators once failed, and the operators that came with their mending."""

import zipfile

import pytest
from decks import R, grid, run, shape, slide, write
from pyspark.sql import functions as F

from deckhand.functions import arguments, ordinals
from deckhand.operators import analysis, formatting, rendering, slides, tables
from deckhand.plans import pipeline
from deckhand.plans import spec as specs
from deckhand.sources import ooxml, records
from deckhand.streaming import ingest


def rewritten(path, **parts):
    """The package with other contents of some parts, named by their last word."""
    with zipfile.ZipFile(path) as z:
        old = {i.filename: z.read(i) for i in z.infolist()}
    with zipfile.ZipFile(path, "w") as z:
        for name, data in old.items():
            z.writestr(name, next((v for k, v in parts.items() if k in name), data))
    return path


@pytest.fixture(scope="module")
def view(spark, tmp_path_factory):
    """Decks with faults; one is sound."""
    folder = tmp_path_factory.mktemp("faulty")
    two = [slide(shape(run("Tides"), ph="title"), shape(run("one"), run("two", 'b="1"'))), slide(grid([]), shape(run("a")))]
    write(folder / "sound.pptx", two, links={1: {"rId9": "https://example.com/?a&amp;b"}})
    rewritten(write(folder / "top.pptx", two), presentation="<p:presentation")
    rewritten(write(folder / "rels.pptx", two), **{"presentation.xml.rels": "<x"})
    write(folder / "unknown.pptx", two, order=[1, 2, 7])
    rewritten(write(folder / "ids.pptx", two), **{"presentation.xml.rels": f"<Relationships {R}/>"})
    rewritten(write(folder / "own.pptx", two), **{"slide1.xml.rels": "<Relationships"})
    (folder / "crypt.pptx").write_bytes(write(folder / "x.bin", two).read_bytes().replace(b"PK\x01\x02\x14\x03\x14\x00\x00", b"PK\x01\x02\x14\x03\x14\x00\x01"))
    (folder / "x.bin").unlink()
    with zipfile.ZipFile(folder / "bomb.pptx", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(3):
            z.writestr(f"ppt/media/{k}", bytes(400 << 20), compresslevel=1)
    rows = ooxml.packages(spark, str(folder))
    path = str(tmp_path_factory.mktemp("read"))
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_faulty_packages_leave_their_rows(view):
    name = F.element_at(F.split("file", "/"), -1)
    found = {(r.name, r.error_type) for r in ooxml.rejects(view).select(name.alias("name"), "error_type").collect()}
    assert found == {("top.pptx", "unreadable_part"), ("rels.pptx", "unreadable_part"), ("own.pptx", "unreadable_part"), ("crypt.pptx", "invalid_file"), ("bomb.pptx", "invalid_file")}
    listed = slides.slides(view).withColumn("name", name).groupBy("name").agg(F.array_sort(F.collect_list("slide_number")).alias("n")).collect()
    assert {r.name: r.n for r in listed} == {k: [1, 2] for k in ("sound.pptx", "top.pptx", "rels.pptx", "unknown.pptx", "ids.pptx", "own.pptx")}
    assert slides.order(view).where("part IS NULL").count() == 4  # both slides of the two files without relations
    assert slides.sections(view).count() == 0


def test_table_without_rows(view):
    own = slides.slides(view).where("file LIKE '%sound%'")
    info = slides.query_slides(own, {}, ["table_info"]).collect()[1].table_info
    assert [(t.rows, t.columns, t.headers) for t in info] == [(0, 0, None)]


def test_paragraphs_are_parted_by_a_space(view):
    own = formatting.elements(slides.slides(view).where("file LIKE '%sound%' AND slide_number = 1"))
    assert {r.text_content for r in own.collect()} == {"Tides", "one two"}
    assert formatting.filtered(own, text_contains="one two").count() == 1


def test_numbers_are_equal_by_value(spark):
    df = spark.createDataFrame([(0, 12345678.5, 7), (1, 5.0, 8), (2, None, None)], "seq long, d double, i int")
    kept = lambda **rule: [r.seq for r in pipeline.run(df, {"filters": [rule]}, "seq").orderBy("seq").collect()]
    assert kept(field="d", condition="equals", value=12345678.5) == kept(field="d", condition="in_list", value=["12345678.5", "x"]) == [0]
    assert kept(field="d", condition="equals", value="5") == [1] and kept(field="i", condition="equals", value=7.0) == [0]
    assert kept(field="d", condition="not_equals", value=5) == [0, 2] and kept(field="d", condition="not_in_list", value=[5, "12345678.5"]) == [2]
    assert kept(field="d", condition="equals", value="five") == [] and kept(field="d", condition="equals", value=None) == [2]


def test_lenient_ordinals_of_an_empty_file(spark):
    df = spark.createDataFrame([([3, 1, 1, 9], 0), ([3, 1, 1, 9], 3)], "c array<int>, n int")
    assert [r[0] for r in df.select(ordinals.lenient(F.col("c"), F.col("n"))).collect()] == [[], [1, 3]]


def test_sessions_count_kinds_exactly(spark):
    rows = spark.range(4000).selectExpr("1L AS user_id", "timestamp_seconds(id) AS ts", "string(id % 1777) AS event_type")
    assert [(r.steps, r.tools) for r in ingest.sessions(rows).collect()] == [(4000, 1777)]


def test_summary_of_groups(spark):
    df = spark.createDataFrame([(k, k % 5, k) for k in range(50)], "seq long, g int, v int")
    spec = {"filters": [{"field": "v", "condition": "less_than", "value": 43}], "grouping": {"fields": ["g"], "aggregations": []}, "offset": 1, "limit": 3}
    row = pipeline.summary(df, spec, "seq").first()
    assert (row.original_count, row.filtered_count, row.final_count, row.grouped) == (50, 43, 3, True)
    assert row.final_count == pipeline.run(df, spec, "seq").count()


def test_records(spark, tmp_path):
    given = '{"data": [{"a": 1, "b": "é"}, {"a": 2.5, "c": [1]}]}'
    df = records.inline(spark, given)
    assert [(r.a, r.b, r.c) for r in df.orderBy("seq").collect()] == [(1, "é", None), (2.5, None, [1])]
    assert [r.json for r in records.as_json(df.orderBy("seq").select("b", "c")).collect()] == ['{"b":"é","c":null}', '{"b":null,"c":[1]}']
    records.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and records.inline(spark, []).count() == 0
    for bad in ('"x"', '{"rows": []}', [1]):
        with pytest.raises(ValueError):
            records.inline(spark, bad)


def test_arguments_and_builders():
    assert arguments.sanitized({"a": "True", "b": ["None", "x", {"c": "false"}]}) == {"a": True, "b": [None, "x", {"c": False}]}
    assert [arguments.boolean(x) for x in ("Yes", "off", None, 2)] == [True, False, False, True]
    assert specs.Spec((specs.simple_filter("a", "equals", 1), specs.formatting_filter("f", {"bold": True})), sorting=(specs.sort("a", "desc"),)).filters[1].condition == "has_formatting"
    assert specs.aggregation("a", "sum", "s").separator == ", " and specs.column_selection({"specific_columns": ["x"], "all_columns": False}) == {"specific": ["x"], "all_columns": False}
    assert specs.slide_criteria(title={"contains": "x"}, notes=None) == {"title": {"contains": "x"}} and specs.table_criteria({"min_rows": 2}) == {"min_rows": 2}
    assert specs.element_filter({"colors": ["#000000"], "slide_numbers": None}) == {"colors": ["#000000"]}
    for bad in (lambda: specs.slide_criteria(title={"contains": 1}), lambda: specs.table_criteria({"rows": 1}), lambda: specs.sort("a", "up")):
        with pytest.raises(ValueError):
            bad()


def test_single_slides_and_forms(view):
    own = slides.slides(view).where("file LIKE '%sound%'").cache()
    file = own.first().file
    assert slides.slide_info(own, file, 1).first().title == "Tides"
    with pytest.raises(ValueError, match="slides 1 to 2, not 3"):
        slides.slide_info(own, file, 3)
    with pytest.raises(ValueError):
        rendering.query_simple(own, {}, ["colour"])
    with pytest.raises(ValueError):
        tables.extract(own, "xml")
    with pytest.raises(ValueError):
        analysis.overview(analysis.view(own), "deep")
    whole = analysis.overview(analysis.view(own), "comprehensive").first()
    assert whole.slides == 2 and whole.readability_score and whole.sample_titles == ["Tides"]
