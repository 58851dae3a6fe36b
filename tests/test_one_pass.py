"""Whole decks in one pass: equal to the aggregations, with every pattern, and one parse however much is asked for."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deckhand.functions.arrays import stretches
from deckhand.operators import analysis, decks, formatting, slides, tables, workflow
from deckhand.plans import package_queries, surface_queries, varied_queries
from deckhand.sources import ooxml, writer

KINDS = ("shapes", "text_boxes", "images", "tables", "charts", "media", "connectors", "groups")
SCHEMA = f"file string, slide_number int, title string, subtitle string, notes string, counts struct<{','.join(k + ':int' for k in KINDS)}>, texts array<string>"


def made_rows():
    r = random.Random(1)
    rows = []
    for f in range(12):
        for n in range(1, r.choice([1, 2, 8, 30, 60])):
            title = r.choice([None, "", f"{n}. Step", "Why so?", "Our plan again", "Our plan", "End", "What is it?  "])
            counts = tuple(r.choice([0, 0, 0, 1, 2, 5]) if f % 3 else 0 for _ in KINDS)
            rows.append((f"f{f}" if f else None, n, title, r.choice([None, "sub"]), r.choice([None, "", "note " * 30]), counts, [r.choice(["• a • b • c", "x" * 130, "text", "- one"]) for _ in range(r.randint(0, 4))]))
    return rows


def test_equal_to_the_aggregations(spark):
    df = spark.createDataFrame(made_rows(), SCHEMA).repartition(3)
    named = df.where("file IS NOT NULL")
    by_file = lambda d: {r.file: r.asDict(True) for r in d.collect()}
    one, many = by_file(decks.insights(decks.decks(named)).drop("deck", "samples")), by_file(analysis.insights(named))
    assert one.keys() == many.keys() and len(one) >= 8
    rounded = lambda v: round(float(v), 1) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    assert {f: {k: rounded(v) for k, v in x.items()} for f, x in one.items()} == {f: {k: rounded(v) for k, v in x.items()} for f, x in many.items()}
    found = {(r.file, *map(str, p)) for r in decks.decks(named).select("file", decks.patterns(F.col("deck")).alias("p")).collect() for p in r.p}
    assert found == {(r[0], *map(str, r[1:])) for r in analysis.patterns(named).select("file", "pattern_type", "pattern_name", "occurrences", "slides", "examples", "confidence").collect()}
    assert {p[2] for p in found} == {"numbered_titles", "question_titles", "common_prefix", "consistent_bullets", "repeated_sequence"}
    assert by_file(decks.overview(df))[None]["slides"] == sum(x[0] is None for x in made_rows())  # files without a name are one file
    assert decks.overview(df.limit(0), "comprehensive").count() == 0


def test_one_parse_for_all_that_is_asked(spark):
    view = slides.slides(package_queries.packages(spark, "/root/testdata/sf0.001"))
    parses = lambda d: d._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].count("MapInArrow")
    base = parses(view)
    for depth in analysis.DEPTHS:
        assert parses(analysis.overview(analysis.view(view), depth)) == base
    for flags in ((True, True, True), (False, True, True), (True, False, False), (False, False, True), (False, False, False)):
        found = decks.analyse(view, "detailed", *flags)
        assert parses(found) == base
        wanted = ["file", *["structure", "slide_classifications"] * flags[2], *["content_patterns", "insights", "sample_titles", "sample_texts"] * flags[0], *["formatting_analysis"] * flags[1]]
        assert found.columns == wanted
    assert parses(tables.cells(view)) == base and parses(slides.links(view)) == base
    plan = slides.query_slides(view, {"title": {"contains": "user"}}, ["title"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert decks.analyse(view, "basic").first().content_patterns == []
    assert "visual_balance" in decks.analyse(view).select("insights.*").columns and "visual_balance" not in decks.analyse(view, formats=False).select("insights.*").columns


def test_stretches(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "a", "b", "c", "c", "a"],)], "x array<string>")
    got = [r[0] for r in df.select(stretches(F.col("x"), lambda x: x)).collect()]
    assert got == [[], [["a"]], [["a", "a"], ["b"], ["c", "c"], ["a"]]]


def test_work_grows_with_the_input(spark):
    steps = spark.createDataFrame([(["b", "a", "c"] * 6000,), ([],), (None,), (["a", "x", "b"],)], "steps array<string>")
    began = time.time()
    assert [r[0] for r in steps.select(workflow.partial_sequence(F.col("steps"), ["a", "b", "c", "d"])).collect()] == [0.75, 0.0, 0.0, 0.5] and time.time() - began < 8
    n = 4000
    rows = [("f", k, f"Part {k % 700} of it", None, None, (1,) * 8, ["t"]) for k in range(n)]
    began = time.time()
    (found,) = decks.decks(spark.createDataFrame(rows, SCHEMA)).select(decks.patterns(F.col("deck")).alias("p")).collect()
    assert len([p for p in found.p if p.pattern_name == "common_prefix"]) == 700 and time.time() - began < 40


def test_links_take_the_first_relation_of_a_slide(spark):
    run = "struct<text:string,rid:string>"
    df = spark.sql(f"SELECT 'f' AS file, 1 AS slide_number, array(named_struct('idx', 0, 'paras', CAST(array(array(named_struct('text', 'a', 'rid', 'r1'), named_struct('text', 'b', 'rid', 'r9'), named_struct('text', 'c', 'rid', NULL))) AS array<array<{run}>>))) AS shapes, "
                   "array(named_struct('rid', 'r1', 'type', 'image', 'target', 'x'), named_struct('rid', 'r1', 'type', 'hyperlink', 'target', 'https://a'), named_struct('rid', 'r1', 'type', 'hyperlink', 'target', 'https://b')) AS rels")  # fmt: skip
    assert [tuple(r) for r in slides.links(df).orderBy("text").collect()] == [("f", 1, 0, "a", "https://a", "external"), ("f", 1, 0, "b", "r9", "internal")]


def test_scores_are_rounded_as_sql_does(spark):
    """A mean of 7.95 that comes out as 7.949999999999999 is 8.0, by both ways."""
    df = spark.createDataFrame([("f", n, None, None, None, (1, 1, 0, 0, 0, 0, 0, 0), ["x" * size]) for n, size in ((1, 202), (2, 313))], SCHEMA)
    assert [d.first().readability_score for d in (analysis.insights(df), analysis.overview(df, "comprehensive"))] == [8.0] * 2


def parses(df):
    """How often a plan parses packages."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].count("MapInArrow")


def test_operators_read_their_slides_once(spark):
    view = slides.slides(package_queries.packages(spark, "/root/testdata/sf0.001"))
    assert [parses(formatting.segments(view, kind)) for kind in formatting.TYPES] == [1] * len(formatting.TYPES)
    found = formatting.elements(view)
    assert parses(formatting.runs(view)) == parses(found) == parses(formatting.summary(found)) == 1
    assert {name: parses(tables.extract(view, name)) for name in tables.FORMATS} == dict.fromkeys(tables.FORMATS, 1)
    assert parses(tables.extract(view, criteria={"min_rows": 3, "max_columns": 2, "header_contains": ["LIN"]})) == 1
    assert parses(analysis.patterns(analysis.view(view))) == parses(slides.sections(package_queries.packages(spark, "/root/testdata/sf0.001"))) == 1


@pytest.mark.parametrize("name", ["pkg_query_simple", "pkg_section_ranges", "pkg_content", "pkg_extraction_summary", "pkg_insights", "pkg_overview_formatting", "varied_insights", "sql_text_segments", "sql_deck_scores"])
def test_queries_that_read_decks_more_than_once_write_them(spark, name):
    queries = package_queries.QUERIES | varied_queries.QUERIES | surface_queries.QUERIES
    assert parses(queries[name](spark, "/root/testdata/sf0.001")) == 0


def test_tasks_grow_with_the_slides(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    grown = spark.range(40).crossJoin(spark.read.parquet(f"{small}/conversations.parquet")).withColumn("conv_id", F.col("conv_id") + 1000 * F.col("id")).drop("id").repartition(1)
    grown.crossJoin(spark.range(3).select(F.col("id").alias("k"))).withColumn("conv_id", F.col("conv_id") + 100_000 * F.col("k")).drop("k").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [package_queries.files(spark, d).rdd.getNumPartitions() for d in (small, str(tmp_path))] == [spark.sparkContext.defaultParallelism, -(-87 * 120 // package_queries.TASK_SLIDES)]


def test_batches_are_bounded(spark):
    """A task has one file's bytes at a time, and rows of a file go on in batches."""
    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3]})
    assert list(ooxml.each(iter([batch, batch]))) == [{"a": k} for k in (1, 2, 3)] * 2
    rows = spark.range(150).select(F.lit("deck.pptx").alias("file"), (F.col("id") + 1).cast("int").alias("slide_number"), F.lit("x").alias("title"))
    given = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(writer.SLIDE)}
    made = writer.packages_of(rows.select(*(F.col(n) if n in rows.columns else c for n, c in given.items())), 2)
    assert sorted(r.slide_number for r in ooxml.parsed(made).where("kind = 'slide'").collect()) == list(range(1, 151))


def test_a_large_deck_stays_columns(spark, monkeypatch):
    """Slides become Python objects some at a time, so that a deck of many slides needs little beside its archive; the archive is that of all of them in order."""
    run = {"text": "some words", "bold": True, "size": 1800, "color": "FF0000"}
    row = {"file": "deck.pptx", "title": "t", "section": "Main", "body": [[run]] * 50, "bodies": [run] * 50, "styles": [], "paras": [{"lvl": 1, "bullet": "-", "runs": [run]}] * 50}
    rows = [row | {"slide_number": k, "notes": f"note {k}"} for k in range(200, 0, -1)]
    styled = "file string, slide_number int, deck array<struct<lvl:int>>, styles array<struct<lvl:int>>, paras array<struct<lvl:int,bullet:string,runs:array<struct<text:string,bold:boolean,size:int,color:string>>>>"

    def peak(f) -> int:
        tracemalloc.start()
        f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    for made, whole, ddl in ((writer.packages_of, writer.package, writer.SLIDE), (writer.varied_of, writer.varied_package, writer.VARIED), (writer.styled_of, writer.styled_package, styled)):
        held, empty = [], spark.createDataFrame([], ddl)
        with monkeypatch.context() as m:
            m.setattr(type(empty.groupBy("file")), "applyInArrow", lambda self, f, schema: held.append(f) or spark.createDataFrame([], schema))  # noqa: B023
            made(empty)
        table = pa.concat_tables(pa.Table.from_pylist(some, schema=to_arrow_schema(empty.schema)) for some in (rows[:90], rows[90:]))
        build = lambda: held[0]((pa.scalar("deck.pptx"),), table)  # noqa: B023,E731
        assert build()["content"][0].as_py() == whole(table.to_pylist()[::-1])
        assert 2 * peak(build) < peak(table.to_pylist)


def test_sections_of_faulty_lists(spark):
    """An id that is listed twice has both places; one that isn't listed, or a section without slides, has none."""
    ids, named = "array<struct<id:string,rid:string>>", "array<struct<name:string,id:string,slide_ids:array<string>>>"
    df = spark.createDataFrame([("f", "package", [("1", "a"), ("2", "b"), ("1", "c"), (None, "d")], [("A", "x", ["1", "9"]), ("B", "y", []), ("C", "z", ["2", None])])], f"file string, kind string, slide_ids {ids}, sections {named}")
    assert sorted(map(str, (tuple(r) for r in slides.sections(df).select("section", "section_ord", "slide_id", "slide_number").collect()))) == sorted(map(str, [("A", 0, "1", 1), ("A", 0, "1", 3), ("A", 0, "9", None), ("B", 1, None, None), ("C", 2, "2", 2), ("C", 2, None, None)]))
