"""Decks of the rarer cases: each case occurs, and operators find it in a deck written by hand."""

from deckhand.operators import analysis, slides, tables
from deckhand.plans import varied_queries
from deckhand.sources import ooxml, writer

RUN = dict.fromkeys(("bold", "italic", "underline", "strike"), False) | dict.fromkeys(("text", "size", "color", "highlight", "url"))
EMPTY = dict.fromkeys(("title", "subtitle", "bodies", "tables", "parted", "pictures", "videos", "charts", "connectors", "grouped", "notes", "notes_of", "threaded"))


def view(spark, rows):
    made = spark.createDataFrame([EMPTY | {"file": "a.pptx"} | r for r in rows], writer.VARIED)
    return slides.slides(ooxml.parsed(writer.varied_of(made)))


def cell(text, **look):
    run = RUN | {"text": text} | {k: v for k, v in look.items() if k in RUN}
    return {"run": run, "fill": None, "row_span": 1, "col_span": 1, "covered": False} | {k: v for k, v in look.items() if k not in RUN}


def test_all_cases_occur_in_the_decks(spark, tmp_path):
    turns = [(c, t, ("system", "user", "assistant")[t % 3], "x" * (7 * c + 3 * t)) for c in range(16) for t in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = varied_queries.view(spark, str(tmp_path))
    types = {r[0] for r in analysis.classified(analysis.view(found)).select("slide_type").distinct().collect()}
    assert types == {f"{t}_slide" for t in ("title", "table", "chart", "image", "bullet", "blank", "content")} | {"section_header", "mixed_content"}
    assert {r[0] for r in found.select("layout_type").distinct().collect()} == {"blank", "titleOnly", "titleAndContent", "twoContent", "contentOnly"}
    sums = tables.totals(tables.cells(found)).first()
    assert sums["bold_cells"] > 0 and sums["italic_cells"] > 0 and sums["highlight_cells"] > 0
    assert {r[0] for r in analysis.patterns(analysis.view(found)).select("pattern_name").distinct().collect()} >= {"numbered_titles", "question_titles", "common_prefix"}


def test_formatted_and_spanning_cells(spark):
    rows = [[cell("a"), cell(""), cell("c")], [cell("x", bold=True, color="00AA00"), cell("y&", italic=True, fill="accent1", col_span=2)], [cell("t", row_span=2), cell("", highlight="FFFF00"), cell(None)], [cell("", covered=True), cell("p", strike=True), cell("q", underline=True)]]
    deck = view(spark, [{"slide_number": 1, "tables": [rows, [[cell("second")]]], "parted": True}])
    html = {r["table_index"]: r["html"] for r in tables.extract(deck, "html").collect()}
    assert html[0] == (
        '<table><tr><th>a</th><th></th><th>c</th></tr><tr><td><span style="color:#00AA00"><strong>x</strong></span></td><td colspan="2" style="background-color:accent1"><em>y&amp;</em></td></tr>'
        '<tr><td rowspan="2">t</td><td><span style="background-color:#FFFF00"></span></td><td></td></tr><tr><td></td><td><s>p</s></td><td><u>q</u></td></tr></table>'
    )
    assert html[1] == "<table><tr><th>second</th></tr></table>"
    assert {(r["table_index"], r["frame"]) for r in tables.cells(deck).collect()} == {(0, 0), (1, 2)}
    marked = {(r["row"], r["col"]): r["value"] for r in tables.extract(deck, "row_col_formattedvalue").where("table_index = 0").collect()}
    assert (marked[1, 0], marked[1, 1], marked[2, 1], marked[3, 1], marked[3, 2]) == ("**x**", "*y&*", "", "~~p~~", "<u>q</u>")
    assert [r["headers"] for r in tables.extract(deck).where("table_index = 0").collect()] == [["a", "Column 2", "c"]]


def test_notes_by_number_groups_and_media(spark):
    deck = view(spark, [
        {"slide_number": 1, "notes": "by number"}, {"slide_number": 2, "notes": "of another", "notes_of": 3}, {"slide_number": 3, "notes": "own", "notes_of": 3},
        {"slide_number": 4, "grouped": ["one", "two"], "pictures": 2, "videos": 1, "threaded": "so & so"},
    ])
    assert {r["slide_number"]: r["content"] for r in slides.notes(deck).collect()} == {1: "by number", 3: "own"}
    last = deck.where("slide_number = 4").first()
    assert [last["object_counts"][k] for k in ("shapes", "groups", "images", "media")] == [0, 1, 2, 1]
    assert [e["text"] for e in last["text_elements"]] == ["one", "two"] and [c["text"] for c in last["comments"]] == ["so & so"]
