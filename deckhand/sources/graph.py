"""The graph of a package's parts: every relation as an edge, its target resolved, and what the root reaches.

Targets are resolved as the format has it: against the folder of the part that states them, or from the root of the
package if they begin with a slash. The package itself is the root, a part with an empty name.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckhand.sources import storage
from deckhand.sources.ooxml import target_part

#: Kinds of relations that lead from a slide to its layout and from a layout to its master.
LAYOUT, MASTER = "slideLayout", "slideMaster"


def source_of(rels: str) -> str | None:
    """The part whose relations a part states: a/_rels/b.xml.rels is of a/b.xml, _rels/.rels of the package; None if it isn't one."""
    folder, _, name = rels.rpartition("/")
    if not name.endswith(".rels") or posixpath.basename(folder) != "_rels":
        return None
    return posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels"))


def edges(parts: DataFrame) -> DataFrame:
    """file, source, rid, type, target, external of all relations, from parts with content (file, name, content).

    An external target stays as it is. A part of relations that isn't well-formed, or has no content, states none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f in batch.to_pylist():
                source = source_of(f["name"] or "")
                try:
                    found = ET.fromstring(f["content"] or b"") if source is not None else ()
                except (ET.ParseError, LookupError, ValueError):
                    continue
                for r in found:
                    external, target = r.get("TargetMode") == "External", r.get("Target")
                    if target is not None:
                        rows.append((f["file"], source, r.get("Id"), (r.get("Type") or "").rpartition("/")[2], target if external else target_part(target, source), external))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.bool_())], ["file", "source", "rid", "type", "target", "external"])

    return parts.where(F.col("name").endswith(".rels")).select("file", "name", "content").mapInArrow(run, "file string, source string, rid string, type string, target string, external boolean")


def inner(found: DataFrame) -> DataFrame:
    """Edges between parts, each once."""
    return found.where("NOT external").select("file", "source", "target").distinct()


def reachable(found: DataFrame, most: int = 1000) -> DataFrame:
    """file, name, distance of all parts that relations lead to from the package's root, the root (with distance 0) included.

    Every round joins the parts that are new with the edges and writes what it finds, so no lineage grows with the depth; it ends
    when nothing is new. Cycles, as between slides and notes, end by themselves. A path longer than ``most`` is an error.
    """
    links = storage.written(inner(found), "edges")
    known = new = storage.written(links.select("file").distinct().select("file", F.lit("").alias("name"), F.lit(0).alias("distance")), "reached")
    for distance in range(1, most + 1):
        ahead = new.join(links, (new.file.eqNullSafe(links.file)) & (new.name == links.source)).select(new.file, F.col("target").alias("name")).distinct()
        seen = known.select(F.col("file").alias("_file"), F.col("name").alias("_name"))
        new = ahead.join(seen, ahead.file.eqNullSafe(seen._file) & (ahead.name == seen._name), "left_anti").withColumn("distance", F.lit(distance))
        new = storage.written(new, "reached")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise ValueError(f"a path of more than {most} relations")


def orphans(parts: DataFrame, found: DataFrame) -> DataFrame:
    """file, name of parts that no path of relations leads to; relations themselves and the list of content types aren't led to."""
    held = parts.where(~F.col("name").endswith(".rels") & (F.col("name") != "[Content_Types].xml")).select("file", "name").distinct()
    there = reachable(found).select("file", "name")
    return held.join(there, held.file.eqNullSafe(there.file) & (held.name == there.name), "left_anti")


def dangling(parts: DataFrame, found: DataFrame) -> DataFrame:
    """file, source, rid, target of relations to parts that the package doesn't have."""
    held = parts.select(F.col("file").alias("_file"), F.col("name").alias("_name")).distinct()
    return found.where("NOT external").join(held, F.col("file").eqNullSafe(F.col("_file")) & (F.col("target") == F.col("_name")), "left_anti").select("file", "source", "rid", "target")


def layouts(found: DataFrame) -> DataFrame:
    """file, slide, layout, master of every slide that has a relation to a layout; of several targets the first by name."""
    to = lambda kind, a, b: found.where((F.col("type") == kind) & ~F.col("external")).groupBy("file", F.col("source").alias(a)).agg(F.min("target").alias(b))
    slide = to(LAYOUT, "slide", "layout").where(F.col("slide").startswith("ppt/slides/"))
    own = to(MASTER, "_layout", "master").withColumnRenamed("file", "_file")
    return slide.join(own, slide.file.eqNullSafe(own._file) & (slide.layout == own._layout), "left").select("file", "slide", "layout", "master")
