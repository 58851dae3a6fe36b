"""What packages state of text formatting at each level, as a table: nothing is resolved here (see ``operators.inheritance``).

A row a paragraph of a slide's shapes: its own properties, its runs with theirs, the list styles of its shape and of the
presentation by level. Null means that a level states nothing.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deckhand.sources.ooxml import NS, UNREADABLE, _color, _local, parse_presentation, parse_rels, problem, target_part

LOOK = "size:double,bold:boolean,italic:boolean,underline:boolean,color:string"
STYLE = f"struct<lvl:int,bullet:string,mark:string,indent:bigint,{LOOK}>"
SCHEMA = (
    f"file string, slide_number int, part string, shape int, ph_type string, para int, lvl int, bullet string, mark string, indent long, look struct<{LOOK}>, "
    f"runs array<struct<text:string,{LOOK}>>, shape_styles array<{STYLE}>, deck_styles array<{STYLE}>"
)
OFF = ("0", "false", "none")


def look(pr: ET.Element | None) -> dict:
    """Formatting that run properties state; null where they state none."""
    flag = lambda k: None if pr is None or pr.get(k) is None else pr.get(k) not in OFF
    size = pr.get("sz") if pr is not None else None
    fill = pr.find("a:solidFill", NS) if pr is not None else None
    return {"size": int(size) / 100 if size and size.isdigit() else None, "bold": flag("b"), "italic": flag("i"), "underline": flag("u"), "color": _color(fill)}


def paragraph(pr: ET.Element | None) -> dict:
    """Bullet and indent that paragraph properties state; bullet is none, char, number or picture."""
    found = {"bullet": None, "mark": None, "indent": None}
    if pr is None:
        return found
    margin = pr.get("marL")
    found["indent"] = int(margin) if margin and margin.lstrip("-").isdigit() else None
    for e in pr:
        kind = {"buNone": "none", "buChar": "char", "buAutoNum": "number", "buBlip": "picture"}.get(_local(e.tag))
        if kind:
            found |= {"bullet": kind, "mark": e.get("char") or e.get("type")}
    return found


def styles(of: ET.Element | None) -> list[dict]:
    """List styles by level; level -1 is for all levels."""
    out = []
    for pr in of if of is not None else ():
        name = _local(pr.tag)
        level = -1 if name == "defPPr" else int(name[3]) - 1 if name[:3] == "lvl" and name.endswith("pPr") and name[3:4].isdigit() else None
        if level is not None:
            out.append({"lvl": level, **paragraph(pr), **look(pr.find("a:defRPr", NS))})
    return out


def _rows(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        read = lambda name: ET.fromstring(z.read(name))
        top = parse_presentation(z.read("ppt/presentation.xml"))
        deck = styles(read("ppt/presentation.xml").find("p:defaultTextStyle", NS))
        rels = parse_rels(z.read("ppt/_rels/presentation.xml.rels")) if "ppt/_rels/presentation.xml.rels" in names else []
        targets = {r["rid"]: target_part(r["target"]) for r in reversed(rels)}
        for number, x in enumerate(top["slide_ids"], 1):
            part = targets.get(x["rid"])
            if part not in names:
                continue
            for k, sp in enumerate(read(part).iter(f"{{{NS['p']}}}sp")):
                ph, body = sp.find("p:nvSpPr/p:nvPr/p:ph", NS), sp.find("p:txBody", NS)
                own = {"slide_number": number, "part": part, "shape": k, "ph_type": ph.get("type", "content") if ph is not None else None, "deck_styles": deck}
                own["shape_styles"] = styles(body.find("a:lstStyle", NS)) if body is not None else []
                for j, p in enumerate(body.findall("a:p", NS) if body is not None else ()):
                    pr = p.find("a:pPr", NS)
                    level = pr.get("lvl") if pr is not None else None
                    runs = [{"text": "".join(t.text or "" for t in r.findall("a:t", NS)), **look(r.find("a:rPr", NS))} for r in p if _local(r.tag) in ("r", "fld")]
                    yield own | {"para": j, "lvl": int(level) if level and level.isdigit() else 0, **paragraph(pr), "look": look(pr.find("a:defRPr", NS) if pr is not None else None), "runs": runs}


def paragraphs(files: DataFrame) -> DataFrame:
    """A row a paragraph of every readable package among files as the binary source reads them.

    A file that isn't a package, or whose parts aren't well-formed, has no rows; ``ooxml.parsed`` says why.
    """
    fields = T.StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                if problem(f["path"], f["length"], f["content"]):
                    continue
                try:
                    rows = [{"file": f["path"], **r} for r in _rows(f["content"])]
                except (ET.ParseError, KeyError, *UNREADABLE):
                    continue
                for lo in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 2000], schema=arrow)

    return files.select("path", "length", "content").mapInArrow(run, fields)
