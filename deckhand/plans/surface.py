"""Decks as views and table functions of a session, for SQL.

The functions are Spark's own SQL table functions: Spark puts their bodies in place of the call, so that arguments are
constants, filters go below and columns that the query doesn't ask for are not made. Every argument may be left out and
given by name; null means no condition.

    surface.register(spark, slides.slides(bronze))
    spark.sql("SELECT file, title FROM query_slides(title_has => 'plan', with_tables => true) ORDER BY file")
    spark.sql("SELECT text, start FROM text_segments('bold') WHERE slide_number = 1")

Null titles, texts and notes count as empty. A pattern that isn't one and an unknown kind of formatting are errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckhand.operators import analysis, formatting, slides, tables

#: What a kind of formatting is in the view of runs, and what goes with it.
KINDS = {
    "bold": ("bold", "NULL"), "italic": ("italic", "NULL"), "underlined": ("underline", "NULL"), "strikethrough": ("strike", "NULL"), "highlighted": ("highlight IS NOT NULL", "highlight"),
    "hyperlinks": ("rid IS NOT NULL", "coalesce(target, rid)"), "font_sizes": ("size IS NOT NULL", "CAST(size AS STRING)"), "font_colors": ("color IS NOT NULL", "color"),
}


def _has(column: str, argument: str, how: str = "contains") -> str:
    return f"({argument} IS NULL OR {how}(lower(coalesce({column}, '')), lower({argument})))"


def _like(column: str, argument: str) -> str:
    return f"({argument} IS NULL OR coalesce({column}, '') RLIKE concat('(?iu)', {argument}))"


def _between(column: str, least: str, most: str) -> str:
    return f"({least} IS NULL OR {column} >= {least}) AND ({most} IS NULL OR {column} <= {most})"


def _flag(condition: str, argument: str) -> str:
    return f"({argument} IS NULL OR ({condition}) = {argument})"


#: name: view, arguments with their types, columns (None: all of the view), condition.
FUNCTIONS: dict[str, tuple[str, dict[str, str], dict[str, str] | None, list[str]]] = {
    "query_slides": ("deck_slides", {
        "from_slide": "INT", "to_slide": "INT", "title_has": "STRING", "title_starts": "STRING", "title_ends": "STRING", "title_like": "STRING", "text_has": "STRING", "with_tables": "BOOLEAN", "with_charts": "BOOLEAN",
        "with_images": "BOOLEAN", "least_objects": "INT", "most_objects": "INT", "layout_has": "STRING", "layout_name_has": "STRING", "in_sections": "ARRAY<STRING>", "with_notes": "BOOLEAN", "notes_have": "STRING", "notes_like": "STRING",
    }, None, [
        _between("slide_number", "from_slide", "to_slide"), _has("title", "title_has"), _has("title", "title_starts", "startswith"), _has("title", "title_ends", "endswith"), _like("title", "title_like"),
        "(text_has IS NULL OR contains(lower(coalesce(title, '')), lower(text_has)) OR exists(text_elements, e -> contains(lower(e.text), lower(text_has))))",
        *(_flag(f"coalesce(object_counts.{k}, 0) > 0", f"with_{k}") for k in ("tables", "charts", "images")), _between("total_objects", "least_objects", "most_objects"),
        _has("layout_type", "layout_has"), _has("layout_name", "layout_name_has"), "(in_sections IS NULL OR array_contains(transform(in_sections, s -> lower(s)), lower(coalesce(section, ''))))",
        _flag("trim(coalesce(notes, '')) <> ''", "with_notes"), _has("notes", "notes_have"), _like("notes", "notes_like"),
    ]),
    "slide_info": ("deck_slides", {"of_file": "STRING", "number": "INT"}, None, ["(of_file IS NULL OR file = of_file)", "(number IS NULL OR slide_number = number)"]),
    "query_tables": ("deck_tables", {"header_has": "STRING", "header_like": "STRING", "least_rows": "INT", "most_rows": "INT", "least_columns": "INT", "most_columns": "INT"}, None, [
        "(header_has IS NULL OR exists(headers, h -> contains(lower(h), lower(header_has))))", "(header_like IS NULL OR exists(headers, h -> h RLIKE concat('(?iu)', header_like)))",
        _between("rows", "least_rows", "most_rows"), _between("columns", "least_columns", "most_columns"),
    ]),
    "table_cells": ("deck_cells", {"header_has": "STRING", "header_like": "STRING", "value_has": "STRING", "formatted": "BOOLEAN"}, None, [
        _has("header", "header_has"), _like("header", "header_like"), _has("value", "value_has"), _flag("bold OR italic OR highlight", "formatted"),
    ]),
    "text_segments": ("deck_runs", {"kind": "STRING"}, {
        "file": "STRING", "slide_number": "INT", "text": "STRING", "start": "BIGINT", "end": "BIGINT", "info": "STRING",
    }, ["text <> ''", f"CASE kind {' '.join(f'WHEN {name!r} THEN {when}' for name, (when, _) in KINDS.items())} ELSE raise_error(concat('unknown kind of formatting: ', coalesce(kind, 'null'))) END"]),
    "deck_scores": ("deck_insights", {"of_file": "STRING"}, None, ["(of_file IS NULL OR file = of_file)"]),
}
#: Columns of a function that its view has not.
MADE = {"info": f"CAST(CASE kind {' '.join(f'WHEN {name!r} THEN {info}' for name, (_, info) in KINDS.items())} END AS STRING)"}


def views(view: DataFrame) -> dict[str, DataFrame]:
    """The tables that the functions read, of the view ``slides``: slides, tables, cells, runs and insights."""
    cells = tables.cells(view)
    runs = formatting.runs(view, ("url",)).withColumnRenamed("url", "target")
    return {
        "deck_slides": view.withColumn("total_objects", slides.total_objects(F.col("object_counts"))),
        "deck_tables": tables.structured(cells), "deck_cells": cells.drop("rels"),
        "deck_runs": runs.withColumns({"start": F.col("start").cast("long"), "end": (F.col("start") + F.length("text")).cast("long")}),
        "deck_insights": analysis.insights(analysis.view(view)),
    }


def statement(name: str, made: DataFrame, prefix: str = "") -> str:
    """The statement that creates a function over its view."""
    source, arguments, columns, conditions = FUNCTIONS[name]
    columns = columns or {f.name: f.dataType.simpleString() for f in made.schema}
    returned = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    chosen = ", ".join(f"{MADE[c]} AS `{c}`" if c in MADE and c not in made.columns else f"`{c}`" for c in columns)
    given = ", ".join(f"{a} {t}{'' if name == 'text_segments' else ' DEFAULT NULL'}" for a, t in arguments.items())
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS TABLE ({returned}) RETURN SELECT {chosen} FROM {prefix}{source} WHERE {' AND '.join(f'({c})' for c in conditions)}"


def register(spark: SparkSession, view: DataFrame, prefix: str = "") -> list[str]:
    """Make the views and functions in a session and return the functions' names.

    view: the view ``slides`` of packages; written bronze is better than raw packages, as each query reads it anew.
    prefix: put before all names, so that a session can hold several sets of decks.
    """
    made = views(view)
    for name, df in made.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    for name, (source, *_) in FUNCTIONS.items():
        spark.sql(statement(name, made[source], prefix))
    return [f"{prefix}{name}" for name in FUNCTIONS]
