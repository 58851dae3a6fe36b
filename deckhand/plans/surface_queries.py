"""Registered queries by SQL table functions, over the decks of ``package_queries``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deckhand.plans import surface
from deckhand.plans.package_queries import CELLS, KINDS, RUNS, S, written_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, oracle: str) -> None:
    """A query as its users write it, over views and functions with a prefix of their own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        surface.register(spark, written_view(spark, sf_dir), "conv_")
        return spark.sql(sql)

    QUERIES[name], ORACLES[name] = run, oracle


query("sql_query_slides", "SELECT file, CAST(slide_number AS BIGINT) AS slide_number, title FROM conv_query_slides(to_slide => 3, title_starts => 'USER', notes_like => '^[a-m]', with_notes => true, in_sections => array('opening', 'none'))",
      f"SELECT file, n AS slide_number, title FROM ({S}) WHERE n <= 3 AND starts_with(coalesce(title, ''), 'user') AND trim(coalesce(notes, '')) <> '' AND regexp_matches(notes, '^[a-m]', 'i') AND section = 'Opening'")
query("sql_slides_by_layout", """SELECT layout_type, count(*) AS slides, CAST(sum(object_counts.images) AS BIGINT) AS images FROM conv_query_slides(text_has => 'An', with_charts => false) GROUP BY layout_type""",
      f"SELECT layout_type, count(*) AS slides, sum(images)::BIGINT AS images FROM ({S}) WHERE charts = 0 AND (contains(lower(coalesce(title, '')), 'an') OR contains(lower(body), 'an') OR contains(lower(coalesce(subtitle, '')), 'an')) GROUP BY layout_type")
query("sql_slide_info", "SELECT file, CAST(slide_number AS BIGINT) AS slide_number, title, section FROM conv_slide_info('deck-1.pptx', 2)", f"SELECT file, n AS slide_number, title, section FROM ({S}) WHERE file = 'deck-1.pptx' AND n = 2")
query("sql_query_tables", "SELECT file, CAST(slide_number AS BIGINT) AS slide_number, CAST(rows AS BIGINT) AS rows, array_join(headers, ',') AS headers FROM conv_query_tables(header_has => 'LIN', header_like => '^si.e$', least_rows => 3, most_rows => 6)",
      f"SELECT file, n AS slide_number, (max(row) + 1)::BIGINT AS rows, 'line,size' AS headers FROM ({CELLS}) GROUP BY file, n HAVING max(row) + 1 BETWEEN 3 AND 6")
query("sql_table_cells", "SELECT header, count(*) AS cells, CAST(sum(try_cast(value AS INT)) AS BIGINT) AS total FROM conv_table_cells(header_like => '^(line|size)$', formatted => false) WHERE row > 0 GROUP BY header",
      f"SELECT header, count(*) AS cells, sum(try_cast(value AS INT))::BIGINT AS total FROM ({CELLS}) WHERE row > 0 GROUP BY header")
query("sql_text_segments", " UNION ALL ".join(f"SELECT '{k}' AS kind, file, CAST(slide_number AS BIGINT) AS slide_number, text, start, `end`, info FROM conv_text_segments('{k}')" for k in ("bold", "hyperlinks", "font_colors")),
      " UNION ALL ".join(f"SELECT '{k}' AS kind, file, n AS slide_number, text, start, start + length(text) AS \"end\", {KINDS[k][1]} AS info FROM ({RUNS}) WHERE {KINDS[k][0]} AND text <> ''" for k in ("bold", "hyperlinks", "font_colors")))
query("sql_deck_scores", "SELECT notes_count, count(*) AS decks, sum(slides) AS slides FROM conv_deck_scores() GROUP BY notes_count",
      f"SELECT notes_count, count(*) AS decks, sum(slides)::BIGINT AS slides FROM (SELECT file, count(*) AS slides, count(*) FILTER (coalesce(notes, '') <> '') AS notes_count FROM ({S}) GROUP BY file) GROUP BY notes_count")
