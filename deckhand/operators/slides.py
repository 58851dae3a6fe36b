"""Slides: views over parsed packages, predicates, projections and previews.

``slides`` is one row a slide, in the order that the presentation lists them; predicates and projections
work on any DataFrame with the columns they name.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckhand.functions.ordinals import predicate as in_ordinals
from deckhand.functions.predicates import combined, matches, text, valid_pattern

#: Object kinds, fields that a query may ask for, and attributes of a slide.
KINDS = ("shapes", "text_boxes", "images", "tables", "charts", "media", "connectors", "groups")
FIELDS = ("slide_number", "title", "subtitle", "layout_name", "layout_type", "object_counts", "preview_text_3boxes", "full_text", "table_info", "full_content", "notes", "section")
ATTRIBUTES = ("title", "subtitle", "text_elements", "text", "tables", "images", "charts", "layout", "size", "sections", "notes", "object_counts", "placeholders", "section", "slide_number")
#: Fields that a simple query may ask for.
SIMPLE_FIELDS = ("slide_number", "title", "subtitle", "text", "extracted_tables")


def joined(paras: Column, between: str = " ") -> Column:
    """Text of paragraphs: runs directly after one another, white space made single."""
    lines = F.transform(paras, lambda p: F.trim(F.regexp_replace(F.array_join(F.transform(p, lambda r: F.coalesce(r["text"], F.lit(""))), ""), r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), between)


def order(packages: DataFrame) -> DataFrame:
    """file, part, slide_number, slide_id as the presentation lists its slides."""
    top = packages.where("kind = 'package'").select("file", "rels", F.posexplode("slide_ids").alias("at", "s"))
    named = top.select("file", (F.col("at") + 1).alias("slide_number"), F.col("s.id").alias("slide_id"), F.get(F.filter("rels", lambda r: r["rid"] == F.col("s.rid")), F.lit(0))["target"].alias("target"))
    return named.select("file", "slide_number", "slide_id", F.regexp_replace(F.concat(F.when(F.col("target").startswith("/"), "").otherwise("ppt/"), "target"), r"^(/|ppt/\.\./)", "").alias("part"))


ENTRIES = "array<struct<slide_id:string,number:int,section_ord:int,section:string,section_id:string>>"


def sections(packages: DataFrame) -> DataFrame:
    """file, section, section_id, section_ord, slide_id, slide_number (null if the slide isn't listed)."""
    # A package's row holds both lists; their entries meet by their ids without a second reading.
    listed = F.transform("slide_ids", lambda x, k: F.struct(x["id"].alias("slide_id"), (k + 1).alias("number"), F.lit(None).cast("int").alias("section_ord"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("section_id")))
    entry = lambda s, k, i: F.struct(i.alias("slide_id"), F.lit(None).cast("int").alias("number"), k.alias("section_ord"), s["name"].alias("section"), s["id"].alias("section_id"))
    ids = lambda s: F.when(F.size(s["slide_ids"]) > 0, s["slide_ids"]).otherwise(F.array(F.lit(None).cast("string")))
    own = F.flatten(F.transform("sections", lambda s, k: F.transform(ids(s), lambda i: entry(s, k, i))))
    rows = packages.where("kind = 'package'").select("file", F.explode(F.concat(*(F.coalesce(x, F.array().cast(ENTRIES)) for x in (own, listed)))).alias("e")).select("file", "e.*")
    numbers = F.collect_list(F.when(F.col("slide_id").isNotNull(), F.col("number"))).over(Window.partitionBy("file", "slide_id"))
    found = rows.withColumn("numbers", numbers).where("section_ord IS NOT NULL")
    return found.select("file", "slide_id", "section_ord", "section", "section_id", F.explode_outer("numbers").alias("slide_number"))


def layout_type(shapes: Column) -> Column:
    title = F.exists(shapes, lambda s: s["ph_type"] == "title")
    bodies = F.size(F.filter(shapes, lambda s: s["ph_type"].isin("body", "obj", "content")))
    return (
        F.when(title & (bodies >= 2), "twoContent").when(title & (bodies == 1), "titleAndContent").when(title, "titleOnly").when(bodies > 0, "contentOnly").otherwise("blank")
    )


def last_text(shapes: Column, kinds: list[str]) -> Column:
    """The last text that isn't empty of the shapes of some placeholder kinds."""
    found = F.filter(F.transform(F.filter(shapes, lambda s: s["ph_type"].isin(kinds)), lambda s: joined(s["paras"])), lambda x: x != "")
    return F.try_element_at(found, F.lit(-1))


def slide_size(w: Column, h: Column) -> Column:
    """Width and height in EMU and several units; null if the presentation states none."""
    units = {"inches": (914400, 2), "cm": (914400 / 2.54, 2), "points": (914400 / 72, 1)}
    both = [(side, c, unit) for unit in units for side, c in (("width", w), ("height", h))]
    fields = [w.alias("width_emu"), h.alias("height_emu"), *(F.round(c / units[u][0], units[u][1]).alias(f"{side}_{u}") for side, c, u in both)]
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(*fields, F.when(h > 0, F.round(w / h, 2)).otherwise(0.0).alias("aspect_ratio")))


def slides(packages: DataFrame) -> DataFrame:
    """file, slide_number, part_number, titles, layout, notes, section, object_counts, text_elements, shapes, tables, rels, slide_size."""
    # A package is parsed as a whole, so its slides know their places and sections: nothing is joined or shuffled.
    shapes = F.coalesce("shapes", F.expr("filter(shapes, s -> false)"))
    return packages.where("kind = 'slide'").select(
        "file", "slide_number", "part", "part_number", "slide_id", "error", "digest", "layout_name",
        layout_type(shapes).alias("layout_type"),
        last_text(shapes, ["title", "ctrTitle"]).alias("title"),
        last_text(shapes, ["subTitle"]).alias("subtitle"),
        "notes", "section", F.col("counts").alias("object_counts"),
        F.filter(F.transform(shapes, lambda s: F.struct(s["idx"].alias("idx"), s["ph_type"].alias("ph_type"), joined(s["paras"]).alias("text"))), lambda e: e["text"] != "").alias("text_elements"),
        "shapes", "tables", "rels", "comments", slide_size(F.col("width"), F.col("height")).alias("slide_size"),
    )


def total_objects(counts: Column) -> Column:
    return sum((F.coalesce(counts[k], F.lit(0)) for k in KINDS), F.lit(0))


def check_criteria(criteria: dict) -> list[str]:
    """What is wrong with search criteria; nothing if they are fine."""
    known = {
        "title": {"contains": str, "starts_with": str, "ends_with": str, "regex": str, "one_of": list},
        "content": {"contains_text": str, "has_tables": bool, "has_charts": bool, "has_images": bool, "object_count": dict, "object_count_min": int, "object_count_max": int},
        "layout": {"type": str, "name": str, "layout_type": str, "layout_name": str},
        "notes": {"contains": str, "regex": str, "is_empty": bool},
    }
    errors = []
    for key, value in criteria.items():
        if key in known:
            if not isinstance(value, dict):
                errors.append(f"{key} must be an object")
                continue
            for k, v in value.items():
                kind = known[key].get(k)
                if kind is None:
                    errors.append(f"{key}.{k} is unknown")
                elif not isinstance(v, kind) or (kind is int and isinstance(v, bool)):
                    errors.append(f"{key}.{k} must be of type {kind.__name__}")
                elif k == "regex" and not valid_pattern(v):
                    errors.append(f"{key}.regex isn't a pattern: {v}")
            low, high = _range(value)
            if low is not None and high is not None and low > high:
                errors.append(f"{key}: the least count is above the greatest")
        elif key in ("section", "sections"):
            if not isinstance(value, (str, list)):
                errors.append(f"{key} must be a name or a list of names")
        elif key != "slide_numbers":
            errors.append(f"{key} is unknown")
    return errors


def _range(content: dict) -> tuple[int | None, int | None]:
    inner = content.get("object_count") if isinstance(content.get("object_count"), dict) else {}
    return content.get("object_count_min", inner.get("min")), content.get("object_count_max", inner.get("max"))


def title_condition(c: Column, f: dict) -> Column:
    low, parts = F.lower(text(c)), []
    for k, method in (("contains", "contains"), ("starts_with", "startswith"), ("ends_with", "endswith")):
        if f.get(k) is not None:
            parts.append(getattr(low, method)(f[k].lower()))
    if f.get("regex") is not None:
        parts.append(matches(c, f["regex"]))
    if f.get("one_of"):
        parts.append(combined([matches(c, p) if valid_pattern(p) else low.contains(p.lower()) for p in f["one_of"]], "OR"))
    return combined(parts)


def content_condition(f: dict, counts: Column, title: Column, texts: Column) -> Column:
    """``texts`` is an array of strings."""
    parts = []
    for k, kind in (("has_tables", "tables"), ("has_charts", "charts"), ("has_images", "images")):
        if f.get(k) is not None:
            parts.append((F.coalesce(counts[kind], F.lit(0)) > 0) == F.lit(f[k]))
    low, high = _range(f)
    if low is not None:
        parts.append(total_objects(counts) >= low)
    if high is not None:
        parts.append(total_objects(counts) <= high)
    if f.get("contains_text"):
        s = f["contains_text"].lower()
        parts.append(F.coalesce(F.exists(texts, lambda t: F.lower(text(t)).contains(s)), F.lit(False)) | F.lower(text(title)).contains(s))
    return combined(parts)


def notes_condition(c: Column, f: dict) -> Column:
    parts = []
    if f.get("is_empty") is not None:
        parts.append((F.trim(text(c)) == "") == F.lit(f["is_empty"]))
    if f.get("contains") is not None:
        parts.append(F.lower(text(c)).contains(f["contains"].lower()))
    if f.get("regex") is not None:
        parts.append(matches(c, f["regex"]))
    return combined(parts)


def layout_condition(f: dict, kind: Column, name: Column) -> Column:
    wanted = [(kind, f.get("type", f.get("layout_type"))), (name, f.get("name", f.get("layout_name")))]
    return combined([F.lower(text(c)).contains(v.lower()) for c, v in wanted if v is not None])


def slide_condition(criteria: dict) -> Column:
    """All criteria as one condition on the view ``slides``."""
    if errors := check_criteria(criteria):
        raise ValueError("; ".join(errors))
    names = criteria.get("section", criteria.get("sections"))
    names = [names] if isinstance(names, str) else names
    parts = [
        in_ordinals(F.col("slide_number"), criteria.get("slide_numbers")),
        title_condition(F.col("title"), criteria.get("title", {})),
        content_condition(criteria.get("content", {}), F.col("object_counts"), F.col("title"), F.col("text_elements.text")),
        layout_condition(criteria.get("layout", {}), F.col("layout_type"), F.col("layout_name")),
        notes_condition(F.col("notes"), criteria.get("notes", {})),
    ]
    if names:
        parts.append(F.lower(text(F.col("section"))).isin([n.lower() for n in names]))
    return combined(parts)


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def preview(elements: Column, title: Column, boxes: int | None = 3, most: int = 100) -> Column:
    """Title, then boxes that aren't the title's own shape, each shortened, joined by " | "."""
    rest = F.filter(elements, lambda e: ~F.coalesce(e["ph_type"].isin("title", "ctrTitle"), F.lit(False)))
    rest = F.transform(rest, lambda e: shortened(e["text"], most))
    rest = rest if boxes is None else F.slice(rest, 1, boxes)
    return F.array_join(F.concat(F.when(text(title) != "", F.array(title)).otherwise(F.array().cast("array<string>")), rest), " | ")


def fields(names: list[str] | None) -> list[Column]:
    """The projection of a query; an unknown name is an error. slide_number always stays."""
    names = list(names or ["title", "object_counts"])
    if bad := [n for n in names if n not in FIELDS]:
        raise ValueError(f"unknown fields: {', '.join(bad)}; known are {', '.join(FIELDS)}")
    computed = {
        "preview_text_3boxes": preview(F.col("text_elements"), F.col("title")),
        "full_text": preview(F.col("text_elements"), F.col("title"), None, 500),
        "table_info": F.transform("tables", lambda t, k: F.struct(k.alias("table_index"), F.size(t["rows"]).alias("rows"), F.coalesce(F.size(F.get(t["rows"], F.lit(0))), F.lit(0)).alias("columns"), F.transform(F.get(t["rows"], F.lit(0)), lambda c: joined(c["paras"])).alias("headers"))),
        "full_content": F.struct("title", "subtitle", "layout_name", "layout_type", "text_elements", "object_counts", "notes"),
    }
    return [F.col("slide_number"), *(computed.get(n, F.col(n)).alias(n) for n in names if n != "slide_number")]


def query_slides(view: DataFrame, criteria: dict | None = None, return_fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Slides that meet the criteria, with the requested fields, each task's in order; with a limit the first ones of all.

    A global order would sample packages to part them by range, and so parse all of them twice.
    """
    found = view.where(slide_condition(criteria or {})).select("file", *fields(return_fields))
    return found.orderBy("file", "slide_number").limit(limit) if limit and limit > 0 else found.sortWithinPartitions("file", "slide_number")


def attributes(view: DataFrame, wanted: list[str]) -> DataFrame:
    """Named attributes of all slides; some stand for several columns."""
    if not wanted:
        raise ValueError("at least one attribute is needed")
    if bad := [a for a in wanted if a not in ATTRIBUTES]:
        raise ValueError(f"unknown attributes: {', '.join(bad)}")
    placeholders = F.filter("shapes", lambda s: s["ph_type"].isNotNull()).alias("placeholders")
    plain = F.array_join(F.col("text_elements.text"), " ").alias("content_plain")
    alias = {
        "text": ["text_elements", plain], "layout": ["layout_name", "layout_type"], "images": [F.col("object_counts.images").alias("images")],
        "charts": [F.col("object_counts.charts").alias("charts")], "sections": ["section"], "size": ["slide_size"], "placeholders": [placeholders],
    }
    columns: list[Any] = ["file", "slide_number"]
    for a in wanted:
        columns += [c for c in alias.get(a, [a]) if not any(c is x or (isinstance(c, str) and isinstance(x, str) and c == x) for x in columns)]
    return view.select(*columns)


def attribute_summary(view: DataFrame, wanted: list[str]) -> DataFrame:
    """One row a file: its slides, and of the attributes asked for the sums over all slides."""
    totals = []
    if "object_counts" in wanted:
        totals.append(F.struct(*(F.sum(F.coalesce(F.col("object_counts")[k], F.lit(0))).alias(k) for k in KINDS)).alias("total_objects"))
    if "text" in wanted:
        totals.append(F.sum(F.size("text_elements")).alias("total_text_elements"))
    if "tables" in wanted:
        totals.append(F.sum(F.coalesce(F.size("tables"), F.lit(0))).alias("total_tables"))
    return view.groupBy("file").agg(F.count("*").alias("total_slides"), *totals)


def with_counts(df: DataFrame) -> DataFrame:
    """Fills object_counts that are missing from what the row holds: text elements, tables and placeholders."""
    held = {"text_boxes": "text_elements", "tables": "tables", "shapes": "placeholders"}
    count = lambda k: F.coalesce(F.size(held[k]), F.lit(0)) if held.get(k) in df.columns else F.lit(0)
    made = F.struct(*(F.when(count(k) >= 0, count(k)).otherwise(0).alias(k) for k in KINDS))
    return df.withColumn("object_counts", F.coalesce("object_counts", made) if "object_counts" in df.columns else made)


def notes(view: DataFrame) -> DataFrame:
    """file, slide_number, content of the slides that have notes."""
    return view.where(F.trim(text(F.col("notes"))) != "").select("file", "slide_number", F.col("notes").alias("content"))


def comments(view: DataFrame) -> DataFrame:
    return view.select("file", "slide_number", F.explode("comments").alias("c")).select("file", "slide_number", "c.*")


def slide_info(view: DataFrame, file: str, number: int) -> DataFrame:
    """One slide of a file with all its attributes; a number that the file doesn't have is an error."""
    own = view.where(F.col("file") == file)
    found = own.where(F.col("slide_number") == number)
    if found.isEmpty():
        raise ValueError(f"{file} has slides 1 to {own.count()}, not {number}")
    return found


def content(packages: DataFrame) -> DataFrame:
    """One row a file: its presentation, all its slides and all its notes, in order."""
    view = slides(packages)
    kept = ["slide_number", "title", "subtitle", "layout_name", "layout_type", "section", "text_elements", "tables", "object_counts", "notes"]
    own = F.array_sort(F.collect_list(F.struct(*kept)))
    noted = F.filter(F.col("slides"), lambda s: F.trim(text(s["notes"])) != "")
    whole = view.groupBy("file").agg(own.alias("slides")).withColumn("notes", F.transform(noted, lambda s: F.struct(s["slide_number"].alias("slide_number"), s["notes"].alias("content"))))
    return presentations(packages).join(whole, "file", "left")


def link_target(rels: Column, rid: Column) -> Column:
    """Where a link of a slide goes, from the slide's own relations; an id that none explains stays as it is."""
    return F.coalesce(F.get(F.filter(rels, lambda l: (l["type"] == "hyperlink") & (l["rid"] == rid)), F.lit(0))["target"], rid)


def links(view: DataFrame) -> DataFrame:
    """Every linked run with its target; an id that no relation explains stays as it is."""
    runs = view.select("file", "slide_number", "rels", F.explode("shapes").alias("s")).select("file", "slide_number", "rels", F.col("s.idx").alias("shape"), F.explode(F.flatten("s.paras")).alias("r"))
    out = runs.where("r.rid IS NOT NULL").select("file", "slide_number", "shape", F.col("r.text").alias("text"), F.col("r.rid").alias("rid"), link_target(F.col("rels"), F.col("r.rid")).alias("url"))
    return out.select("file", "slide_number", "shape", "text", "url", F.when((F.col("url") != F.col("rid")) & F.col("url").rlike("^[a-z]+:"), "external").otherwise("internal").alias("link_type"))


def presentations(packages: DataFrame) -> DataFrame:
    """One row a package: counts, flags, and the slide size in several units."""
    w, h = F.col("width"), F.col("height")
    return packages.where("kind = 'package'").select(
        "file", F.size("slide_ids").alias("slide_count"), "slide_ids", "slide_masters", "has_notes_master", "has_handout_master", "sections",
        w.alias("width_emu"), h.alias("height_emu"), (w / 914400).alias("width_in"), (h / 914400).alias("height_in"),
        (w / 914400 * 2.54).alias("width_cm"), (h / 914400 * 2.54).alias("height_cm"), (w / 914400 * 72).alias("width_pt"), (h / 914400 * 72).alias("height_pt"),
        F.when(h > 0, w / h).alias("aspect_ratio"), slide_size(w, h).alias("slide_size"),
    )


def numbered(df: DataFrame, file: str, name: str, pattern: str = r"slide(\d+)\.xml$") -> DataFrame:
    """Parts in the order of the numbers in their names, with their places."""
    n = F.regexp_extract(name, pattern, 1).try_cast("int")
    return df.where(F.col(name).rlike(pattern)).withColumn("number", n).withColumn("place", F.row_number().over(Window.partitionBy(file).orderBy("number", name)))
