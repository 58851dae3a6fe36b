"""SQL table functions give what the operators give."""

import pytest

from deckhand.operators import formatting, slides, tables
from deckhand.plans import package_queries, surface


@pytest.fixture(scope="module")
def deck(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("turns"))
    texts = ["An apple\nand a pear\nlinks here\nmarked", "b", "", "cat\n\nmore of it", "xy"]
    turns = [(c, t, ("system", "user", "assistant")[(c + t) % 3], texts[(c * 2 + t) % 5]) for c in range(6) for t in range(5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    package_queries.packages(spark, folder).write.parquet(f"{folder}/bronze")
    view = slides.slides(spark.read.parquet(f"{folder}/bronze"))
    surface.register(spark, view)
    return view


CASES = [
    ("title_has => 'USER'", {"title": {"contains": "USER"}}), ("title_ends => '3', with_tables => false", {"title": {"ends_with": "3"}, "content": {"has_tables": False}}),
    ("title_like => '^(user|none) [1-3]$'", {"title": {"regex": "^(user|none) [1-3]$"}}), ("text_has => 'AN'", {"content": {"contains_text": "AN"}}),
    ("with_images => true, least_objects => 3, most_objects => 8", {"content": {"has_images": True, "object_count_min": 3, "object_count_max": 8}}), ("layout_has => 'CONTENTONLY'", {"layout": {"type": "CONTENTONLY"}}),
    ("in_sections => array('MAIN'), with_notes => false", {"section": "MAIN", "notes": {"is_empty": True}}), ("from_slide => 2, to_slide => 3, notes_have => 'A'", {"slide_numbers": "[2,3]", "notes": {"contains": "A"}}), ("", {}),
]


@pytest.mark.parametrize("arguments,criteria", CASES)
def test_searches(spark, deck, arguments, criteria):
    got = spark.sql(f"SELECT file, slide_number, title FROM query_slides({arguments})").collect()
    want = slides.query_slides(deck, criteria, ["title"]).select("file", "slide_number", "title").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_tables_cells_and_segments(spark, deck):
    got = spark.sql("SELECT file, slide_number, rows, cells.value AS vals FROM query_tables(header_has => 'SIZ', least_rows => 4)").collect()
    want = tables.extract(deck, criteria={"header_contains": ["SIZ"], "min_rows": 4}).select("file", "slide_number", "rows", "cells.value").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.sql("SELECT * FROM table_cells(header_has => 'lin')").count() == tables.selected(tables.cells(deck), patterns=["lin"]).count()
    for kind in formatting.TYPES:
        got = spark.sql(f"SELECT file, slide_number, text, start, `end`, info FROM text_segments('{kind}')").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, formatting.segments(deck, kind).collect()))), kind


def test_unknown_kinds_and_patterns_are_errors(spark, deck):
    with pytest.raises(Exception, match="unknown kind of formatting: shiny"):
        spark.sql("SELECT * FROM text_segments('shiny')").collect()
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        spark.sql("SELECT * FROM query_slides(title_like => '(')").collect()


def test_unasked_columns_are_not_read(spark, deck):
    plan = spark.sql("SELECT file, notes FROM query_slides(with_notes => true, in_sections => array('main'))")._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1]
    assert "notes" in read and "tables" not in read and "comments" not in read and "Python" not in plan


def test_two_sets_of_decks_in_a_session(spark, deck):
    assert "few_slide_info" in surface.register(spark, deck.where("slide_number = 1"), "few_")
    assert spark.sql("SELECT * FROM few_slide_info()").count() == 6 and spark.sql("SELECT * FROM slide_info()").count() == 30
    assert spark.sql("SELECT * FROM few_query_slides(title_has => 'nothing at all')").count() == 0
