"""Tables of slides: merged cells, headers, selection, and output shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckhand.functions.predicates import combined, matches, text, valid_pattern
from deckhand.operators.slides import joined

KEY = ["file", "slide_number", "table_index"]


def compacted(df: DataFrame, key: list[str], col: str, span: str) -> DataFrame:
    """Cells that no earlier cell of their row covers, with their place among those."""
    w = Window.partitionBy(*key).orderBy(col)
    cover = F.max(F.col(col) + F.coalesce(F.col(span), F.lit(1)) - 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = df.withColumn("_cover", F.coalesce(cover, F.lit(-1))).where(F.col(col) > F.col("_cover")).drop("_cover")
    return kept.withColumn("logical_col", F.row_number().over(w) - 1)


def header(name: Column, place: Column) -> Column:
    return F.when(F.trim(text(name)) == "", F.concat(F.lit("Column "), (place + 1).cast("string"))).otherwise(F.trim(name))


def cells(slides: DataFrame) -> DataFrame:
    """One row a cell, compacted, with its header; row 0 is the header row."""
    rels = ["rels"] if "rels" in slides.columns else []
    t = slides.select("file", "slide_number", *rels, F.posexplode("tables").alias("table_index", "t"))
    rows = t.select(*KEY, *rels, F.col("t.idx").alias("frame"), F.posexplode("t.rows").alias("row", "r"))
    each = rows.select(*KEY, *rels, "frame", "row", F.posexplode("r").alias("phys_col", "c")).where("NOT c.h_merge")
    flag = lambda f: F.exists(F.flatten("c.paras"), f)
    each = each.select(
        *KEY, *rels, "frame", "row", "phys_col", joined(F.col("c.paras")).alias("value"), F.col("c.row_span").alias("row_span"), F.col("c.col_span").alias("col_span"),
        flag(lambda r: r["bold"]).alias("bold"), flag(lambda r: r["italic"]).alias("italic"), flag(lambda r: r["underline"]).alias("underline"),
        flag(lambda r: r["strike"]).alias("strikethrough"), flag(lambda r: r["highlight"].isNotNull()).alias("highlight"),
        F.array_distinct(F.filter(F.transform(F.flatten("c.paras"), lambda r: r["color"]), lambda x: x.isNotNull())).alias("colors"),
        F.col("c.fill").alias("fill"), F.col("c.border").alias("border"), F.col("c.paras").alias("paras"),
    )
    each = compacted(each, [*KEY, "row"], "phys_col", "col_span")
    own = F.max(F.when(F.col("row") == 0, header(F.col("value"), F.col("logical_col")))).over(Window.partitionBy(*KEY, "logical_col"))
    return each.withColumn("header", F.coalesce(own, F.concat(F.lit("Column "), (F.col("logical_col") + 1).cast("string"))))


def selected(df: DataFrame, specific: list[str] | None = None, patterns: list[str] | None = None, exclude: list[str] | None = None, all_columns: bool = True) -> DataFrame:
    """Cells of the columns asked for, by header: names in the order of asking, then patterns, less those excluded."""
    h, wanted = F.lower("header"), []
    if specific:
        wanted.append(h.isin([s.lower() for s in specific]))
    wanted += [matches(F.col("header"), p) if valid_pattern(p) else h.contains(p.lower()) for p in patterns or ()]
    if wanted or not all_columns:
        df = df.where(combined(wanted, "OR") if wanted else F.lit(False))
    if specific:
        # Columns asked for by name come first, in the order of asking.
        asked = F.array_position(F.array(*(F.lit(s.lower()) for s in specific)), h)
        df = df.withColumn("place", F.when(asked > 0, asked).otherwise(len(specific) + 1))
    return df.where(~h.isin([s.lower() for s in exclude])) if exclude else df


def _place(df: DataFrame) -> Column:
    return F.col("place") if "place" in df.columns else F.lit(0)


def meeting(df: DataFrame, min_rows: int | None = None, max_rows: int | None = None, min_columns: int | None = None, max_columns: int | None = None,
            header_contains: list[str] | None = None, header_patterns: list[str] | None = None) -> DataFrame:
    """Cells of the tables that meet all criteria; every word and every pattern must be in some header."""
    parts = [F.col(f"_{c}") >= v for c, v in (("rows", min_rows), ("columns", min_columns)) if v is not None]
    parts += [F.col(f"_{c}") <= v for c, v in (("rows", max_rows), ("columns", max_columns)) if v is not None]
    for s in header_contains or ():
        parts.append(F.exists("_headers", _contains(s)))
    for p in header_patterns or ():
        parts.append(F.exists("_headers", _matches(p) if valid_pattern(p) else _contains(p)))
    if not parts:
        return df
    # A window instead of a join, which would read the cells twice; a table's headers and columns are few.
    w = Window.partitionBy(*KEY)
    shape = {"_rows": F.max("row").over(w) + 1, "_columns": F.size(F.collect_set("logical_col").over(w)), "_headers": F.collect_set(F.when(F.col("row") == 0, F.col("header"))).over(w)}
    return df.withColumns(shape).where(combined(parts)).drop(*shape)


def _contains(s: str):
    return lambda h: F.lower(h).contains(s.lower())


def _matches(p: str):
    return lambda h: matches(h, p)


def structured(df: DataFrame) -> DataFrame:
    """One row a table: its headers in order and its cells in order."""
    place = _place(df)
    cell = F.struct("row", place.alias("place"), "logical_col", "header", "value", "row_span", "col_span", "bold", "italic", "underline", "strikethrough", "highlight", "colors")
    return df.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("row") == 0, F.struct(place.alias("place"), "logical_col", "header")))), lambda x: x["header"]).alias("headers"),
        (F.max("row") + 1).alias("rows"), F.countDistinct("logical_col").alias("columns"), F.transform(F.array_sort(F.collect_list(cell)), lambda x: x.dropFields("place")).alias("cells"),
        F.count_if(F.trim("value") != "").alias("non_empty_cells"), F.bool_or(F.col("bold") | F.col("italic") | F.col("highlight")).alias("has_formatting"),
    )


def grouped_by_slide(df: DataFrame) -> DataFrame:
    return structured(df).groupBy("file", "slide_number").agg(F.sort_array(F.collect_list(F.struct("table_index", "headers", "rows", "columns", "cells"))).alias("tables"))


def flat(df: DataFrame, headers: list[str]) -> DataFrame:
    """A row of a table as a row, with the columns asked for, their formatting flags and their first color."""
    body = df.where("row > 0")
    pick = lambda c, h: F.max_by(F.when(F.col("header") == h, F.col(c)), F.when(F.col("header") == h, F.col("logical_col")))
    columns = [pick("value", h).alias(h) for h in headers] + [pick(c, h).alias(f"{h}_{c}") for h in headers for c in ("bold", "italic", "highlight")]
    body = body.withColumn("color", F.get("colors", F.lit(0)))
    columns += [pick("color", h).alias(f"{h}_color") for h in headers]
    return body.groupBy(*KEY, "row").agg(*columns)


def flat_rows(df: DataFrame) -> DataFrame:
    """A row of any table as a map from header to value, and one from header to formatting; of equal headers the last counts."""
    entry = F.struct("header", "logical_col", "value", F.struct("bold", "italic", "highlight", F.get("colors", F.lit(0)).alias("color")).alias("formatting"))
    rows = df.where("row > 0").groupBy(*KEY, "row").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    last = F.filter("e", lambda x, k: ~F.coalesce(F.get(F.col("e"), k + 1)["header"] == x["header"], F.lit(False)))
    pairs = lambda field: F.map_from_entries(F.transform(last, lambda x: F.struct(x["header"], x[field])))
    return rows.select(*KEY, "row", pairs("value").alias("values"), pairs("formatting").alias("formatting"))


def row_col_value(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "row", F.col("logical_col").alias("col"), "value")


def row_col_formatted(df: DataFrame) -> DataFrame:
    """Values marked up as Markdown."""
    return df.select(*KEY, "row", F.col("logical_col").alias("col"), markdown_runs(F.col("paras")).alias("value"))


def escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def html_runs(paras: Column, rels: Column | None = None) -> Column:
    """Runs in strong, em, u, s and coloured spans, linked where relations explain their link; paragraphs joined by <br>."""

    def run(r: Column) -> Column:
        out = escaped(F.coalesce(r["text"], F.lit("")))
        for flag, tag in (("bold", "strong"), ("italic", "em"), ("underline", "u"), ("strike", "s")):
            out = F.when(r[flag], F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
        out = F.when(r["color"].isNotNull(), F.concat(F.lit('<span style="color:'), r["color"], F.lit('">'), out, F.lit("</span>"))).otherwise(out)
        out = F.when(r["highlight"].isNotNull(), F.concat(F.lit('<span style="background-color:'), r["highlight"], F.lit('">'), out, F.lit("</span>"))).otherwise(out)
        if rels is None:
            return out
        target = F.get(F.filter(rels, lambda x: (x["rid"] == r["rid"]) & (x["type"] == "hyperlink")), F.lit(0))["target"]
        return F.when(target.isNotNull(), F.concat(F.lit('<a href="'), escaped(target), F.lit('">'), out, F.lit("</a>"))).otherwise(out)

    return F.array_join(F.transform(paras, lambda p: F.array_join(F.transform(p, run), "")), "<br>")


def markdown_runs(paras: Column) -> Column:
    """Runs marked bold, italic, underlined, struck, in this order from inside; a line a paragraph."""

    def run(r: Column) -> Column:
        out = F.coalesce(r["text"], F.lit(""))
        for flag, before, after in (("bold", "**", "**"), ("italic", "*", "*"), ("underline", "<u>", "</u>"), ("strike", "~~", "~~")):
            out = F.when(r[flag] & (F.trim(out) != ""), F.concat(F.lit(before), out, F.lit(after))).otherwise(out)
        return out

    return F.array_join(F.transform(paras, lambda p: F.array_join(F.transform(p, run), "")), "\n")


def html(df: DataFrame, formatted: bool = False) -> DataFrame:
    """A table as an HTML table, with spans and cell backgrounds."""
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    span = lambda c, name: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    fill = F.when(F.col("fill").isNotNull(), F.concat(F.lit(' style="background-color:'), F.col("fill"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, span("col_span", "colspan"), span("row_span", "rowspan"), fill, F.lit(">"), html_runs(F.col("paras"), F.col("rels") if "rels" in df.columns else None) if formatted else escaped(F.col("value")), F.lit("</"), tag, F.lit(">"))
    rows = df.groupBy(*KEY, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("logical_col").alias("k"), cell.alias("v")))), lambda x: x["v"]), "").alias("tr"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "tr"))), lambda x: F.concat(F.lit("<tr>"), x["tr"], F.lit("</tr>"))), "")
    return rows.groupBy(*KEY).agg(F.concat(F.lit("<table>"), lines, F.lit("</table>")).alias("html"))


def totals(df: DataFrame) -> DataFrame:
    """Tables, rows, slides and formatted cells of all."""
    return df.agg(
        F.countDistinct(*KEY).alias("total_tables"), F.countDistinct(*KEY, "row").alias("total_rows"), F.countDistinct("file", "slide_number").alias("slides_with_tables"),
        *(F.count_if(c).alias(f"{c}_cells") for c in ("bold", "italic", "highlight")),
    )


def formatted_html(df: DataFrame) -> DataFrame:
    return html(df, formatted=True)


FORMATS = {
    "structured": structured, "grouped_by_slide": grouped_by_slide, "flat": flat_rows, "row_col_value": row_col_value, "row_col_formattedvalue": row_col_formatted,
    "simple_html": html, "html": formatted_html,
}


def extract(slides: DataFrame, output_format: str = "structured", criteria: dict | None = None, columns: dict | None = None) -> DataFrame:
    """Tables of slides: selection of columns, then criteria, then the output format."""
    if output_format not in FORMATS:
        raise ValueError(f"unknown format: {output_format}; known are {', '.join(FORMATS)}")
    return FORMATS[output_format](meeting(selected(cells(slides), **(columns or {})), **(criteria or {})))
