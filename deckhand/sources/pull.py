"""Slides read as streams: a part is unpacked and parsed piece by piece, and what has been read is let go.

``pieces`` has a row for each paragraph of a shape and each row of a table, in document order. A part may be larger than a
worker's memory: at any time a task holds the open elements, one paragraph or table row, and a batch of rows. Archives are
read by range, so a part costs its own bytes. For slides of ordinary size ``ooxml.packages`` has everything in one row.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deckhand.sources import storage
from deckhand.sources.archive import Counted
from deckhand.sources.ooxml import CELL, NS, RUN, UNREADABLE, _cell, _run

SCHEMA = f"file string, part string, kind string, idx int, in_group boolean, ph_type string, at int, runs array<{RUN}>, cells array<{CELL}>, error string"
#: Rows of a batch; and characters of text, as one paragraph may hold much.
BATCH_ROWS, BATCH_CHARS = 1000, 1 << 20
A, P = (f"{{{NS[k]}}}" for k in "ap")
#: These are kept as a whole while they are open.
HELD = frozenset((f"{A}p", f"{A}tr"))


def stream(source: IO[bytes]) -> Iterator[dict]:
    """kind (para or row), idx (of the shape or graphic frame), in_group, ph_type, at (the paragraph or row), runs or cells.

    As a tree parser takes them: shapes count in document order with those of groups, frames beside them. Table rows are as
    wide as they are; nothing is filled up.
    """
    opened: list[ET.Element] = []
    shapes = frames = groups = holding = 0
    inside: dict = {}
    for event, e in ET.iterparse(source, events=("start", "end")):
        tag = e.tag
        if event == "start":
            opened.append(e)
            if tag in HELD:
                holding += 1
            elif tag == f"{P}grpSp":
                groups += 1
            elif tag == f"{P}sp":
                inside = {"kind": "para", "idx": shapes, "in_group": groups > 0, "ph_type": None, "at": 0}
                shapes += 1
            elif tag == f"{P}graphicFrame":
                inside = {"kind": "row", "idx": frames, "in_group": groups > 0, "ph_type": None, "at": 0}
                frames += 1
            elif tag == f"{P}ph" and inside:
                inside["ph_type"] = e.get("type", "content")
            continue
        opened.pop()
        done = None
        if tag in HELD:
            holding -= 1
            if tag == f"{A}p" and inside.get("kind") == "para":
                done = {"runs": [_run(r) for r in e if r.tag in (f"{A}r", f"{A}fld", f"{A}br")]}
            elif tag == f"{A}tr" and inside.get("kind") == "row":
                done = {"cells": [_cell(c) for c in e.findall("a:tc", NS)]}
        elif tag == f"{P}grpSp":
            groups -= 1
        elif tag in (f"{P}sp", f"{P}graphicFrame"):
            inside = {}
        if done is not None:
            yield inside | done
            inside["at"] += 1
        # What lies in a paragraph or a table's row is needed until that ends; all else goes as soon as it has ended.
        if opened and not holding:
            e.clear()
            opened[-1].remove(e)


def pieces(parts: DataFrame) -> DataFrame:
    """The pieces of slide parts, given by file (a path or URI that tasks can open) and name, as ``archive.scan`` lists them.

    A part that can't be unpacked or isn't well-formed gives what comes before the fault and a last row of kind
    ``error``; a file that can't be opened as an archive gives that row alone.
    """
    fields = T.StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(fields)
    blank = dict.fromkeys(fields.names)

    def read(file: str, name: str) -> Iterator[dict]:
        own = blank | {"file": file, "part": name}
        fs, path = storage.opened(file)
        try:
            with fs.open_input_file(path) as f, zipfile.ZipFile(Counted(f, fs.get_file_info(path).size)) as z, z.open(name) as part:
                for piece in stream(part):
                    yield own | piece
        except (ET.ParseError, KeyError, zlib.error, *UNREADABLE) as e:
            yield own | {"kind": "error", "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for file, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in read(file, name):
                    rows.append(row)
                    held += sum(len(r["text"]) for r in row["runs"] or ()) + 100
                    if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return parts.where(F.col("name").rlike(r"^ppt/slides/slide[^/]*\.xml$")).select("file", "name").mapInArrow(run, fields)
