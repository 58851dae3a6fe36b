"""Presentation packages as tables: one mapper unzips and parses, everything after it is column work.

``parts`` lists what packages hold. ``packages`` parses them to one row a slide and one row a package,
nested; written once as Parquet, it serves all further queries, which read only the fields they need.
Parsing goes in document order, which native XML functions can't keep among siblings of different names.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import batched
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Namespaces, required parts, and the largest package.
NS = {
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml")
MAX_BYTES = 100 << 20
#: What all parts of a package may unpack to.
MAX_UNPACKED = 1 << 30
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, ValueError)
RID = f"{{{NS['r']}}}id"
#: Rows for a batch, however many files they are of and however many a file has.
BATCH_ROWS = 64

RUN = "struct<text:string,size:double,color:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,highlight:string,rid:string>"
PARAS = f"array<array<{RUN}>>"
BOX = "x:bigint,y:bigint,cx:bigint,cy:bigint"
SHAPE = f"struct<idx:int,in_group:boolean,ph_type:string,{BOX},paras:{PARAS}>"
CELL = f"struct<row_span:int,col_span:int,h_merge:boolean,v_merge:boolean,fill:string,border:array<bigint>,paras:{PARAS}>"
TABLE = f"struct<idx:int,{BOX},rows:array<array<{CELL}>>>"
REL = "struct<rid:string,type:string,target:string>"
COUNTS = "struct<shapes:int,text_boxes:int,images:int,tables:int,charts:int,media:int,connectors:int,groups:int>"
COMMENT = "struct<author_id:string,dt:string,idx:string,x:bigint,y:bigint,text:string>"
SCHEMA = (
    f"file string, modified timestamp, length long, kind string, part string, part_number int, error string, "
    f"slide_number int, slide_id string, section string, digest string, layout_name string, shapes array<{SHAPE}>, tables array<{TABLE}>, counts {COUNTS}, rels array<{REL}>, notes string, "
    f"comments array<{COMMENT}>, slide_ids array<struct<id:string,rid:string>>, sections array<struct<name:string,id:string,slide_ids:array<string>>>, "
    f"width long, height long, slide_masters int, has_notes_master boolean, has_handout_master boolean"
)


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _tag(name: str) -> str:
    """A prefixed name in full, which elements are found by without parsing a path."""
    prefix, _, local = name.partition(":")
    return f"{{{NS[prefix]}}}{local}"


RPR, SOLID, HLINK, HIGHLIGHT, T_, P_, TCPR, TXBODY, PTXBODY = map(_tag, ("a:rPr", "a:solidFill", "a:hlinkClick", "a:highlight", "a:t", "a:p", "a:tcPr", "a:txBody", "p:txBody"))
RUNS = frozenset(map(_tag, ("a:r", "a:fld", "a:br")))
LINES = tuple(map(_tag, ("a:lnL", "a:lnR", "a:lnT", "a:lnB")))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _int(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"-?\d+", x) else None


def _flag(pr: ET.Element | None, name: str, off: tuple = ("0", "false", "none", "noStrike")) -> bool:
    """Set as an attribute or as a child element."""
    if pr is None:
        return False
    value = pr.get(name)
    if value is not None:
        return value not in off
    child = pr.find(f"{{{NS['a']}}}{name}")
    return child is not None and child.get("val", "1") not in off


def _color(e: ET.Element | None) -> str | None:
    if e is None:
        return None
    rgb, scheme = e.find(".//a:srgbClr", NS), e.find(".//a:schemeClr", NS)
    return f"#{rgb.get('val')}" if rgb is not None else scheme.get("val") if scheme is not None else None


def _run(r: ET.Element) -> dict:
    pr = r.find(RPR)
    size = pr.get("sz") if pr is not None else None
    link = pr.find(HLINK) if pr is not None else None
    mark = pr.find(HIGHLIGHT) if pr is not None else None
    return {
        "text": "".join(t.text or "" for t in r.findall(T_)) if _local(r.tag) != "br" else "\n",
        "size": int(size) / 100 if size and size.isdigit() else None,
        "color": _color(pr.find(SOLID)) if pr is not None else None,
        "bold": _flag(pr, "b"),
        "italic": _flag(pr, "i"),
        "underline": _flag(pr, "u"),
        "strike": _flag(pr, "strike"),
        "highlight": (_color(mark) or "set") if mark is not None else None,
        "rid": link.get(RID) if link is not None else None,
    }


def _paras(body: ET.Element | None) -> list:
    if body is None:
        return []
    return [[_run(r) for r in p if _local(r.tag) in ("r", "fld", "br")] for p in body.findall(P_)]


def _box(e: ET.Element) -> dict:
    off, ext = e.find(".//a:off", NS), e.find(".//a:ext[@cx]", NS)
    if off is None:
        off, ext = e.find("p:xfrm/a:off", NS), e.find("p:xfrm/a:ext", NS)
    get = lambda x, k: _int(x.get(k)) if x is not None else None
    return {"x": get(off, "x"), "y": get(off, "y"), "cx": get(ext, "cx"), "cy": get(ext, "cy")}


def _cell(tc: ET.Element) -> dict:
    pr = tc.find(TCPR)
    lines = [pr.find(k) if pr is not None else None for k in LINES]
    return {
        "row_span": _int(tc.get("rowSpan")) or 1,
        "col_span": _int(tc.get("gridSpan")) or 1,
        "h_merge": tc.get("hMerge") in ("1", "true"),
        "v_merge": tc.get("vMerge") in ("1", "true"),
        "fill": _color(pr.find(SOLID)) if pr is not None else None,
        "border": [_int(x.get("w")) if x is not None else None for x in lines],
        "paras": _paras(tc.find(TXBODY)),
    }


def parse_slide(data: bytes) -> dict:
    """Shapes in document order with those of groups, tables by their frame's place, and object counts."""
    root = ET.fromstring(data)
    tree = root.find("p:cSld/p:spTree", NS)
    shapes, tables, counts = [], [], dict.fromkeys(("shapes", "text_boxes", "images", "tables", "charts", "media", "connectors", "groups"), 0)

    def visit(e: ET.Element, grouped: bool) -> None:
        for x in e:
            name = _local(x.tag)
            if name == "sp":
                ph = x.find("p:nvSpPr/p:nvPr/p:ph", NS)
                paras = _paras(x.find(PTXBODY))
                shapes.append({"idx": len(shapes), "in_group": grouped, "ph_type": ph.get("type", "content") if ph is not None else None, **_box(x), "paras": paras})
                if not grouped:
                    counts["shapes"] += 1
                    counts["text_boxes"] += any(r["text"].strip() for p in paras for r in p)
            elif name == "pic":
                counts["images"] += 1
                counts["media"] += x.find("p:nvPicPr/p:nvPr/a:videoFile", NS) is not None or x.find("p:nvPicPr/p:nvPr/a:audioFile", NS) is not None
            elif name == "graphicFrame":
                counts["charts"] += any("chart" in _local(d.tag).lower() for d in x.iter())
                tbl = x.find(".//a:tbl", NS)
                if tbl is not None:
                    counts["tables"] += 1
                    rows = [[_cell(tc) for tc in tr.findall("a:tc", NS)] for tr in tbl.findall("a:tr", NS)]
                    wide = max((len(r) for r in rows), default=0)
                    empty = {"row_span": 1, "col_span": 1, "h_merge": False, "v_merge": False, "fill": None, "border": [], "paras": []}
                    tables.append({"idx": frames[0], **_box(x), "rows": [r + [empty] * (wide - len(r)) for r in rows]})
                frames[0] += 1
            elif name == "cxnSp":
                counts["connectors"] += 1
            elif name == "grpSp":
                counts["groups"] += 1
                visit(x, True)

    frames = [0]
    if tree is not None:
        visit(tree, False)
    c = root.find("p:cSld", NS)
    return {"layout_name": c.get("name") if c is not None else None, "shapes": shapes, "tables": tables, "counts": counts}


def parse_rels(data: bytes) -> list[dict]:
    return [{"rid": r.get("Id"), "type": (r.get("Type") or "").rpartition("/")[2], "target": r.get("Target")} for r in ET.fromstring(data)]


def parse_notes(data: bytes) -> str:
    """The text of the body placeholder, paragraphs joined by spaces."""
    found = []
    for sp in ET.fromstring(data).iter(f"{{{NS['p']}}}sp"):
        ph = sp.find("p:nvSpPr/p:nvPr/p:ph", NS)
        if ph is not None and ph.get("type") == "body":
            found += [" ".join("".join(r["text"] for r in p).split()) for p in _paras(sp.find("p:txBody", NS))]
    return " ".join(x for x in found if x)


def parse_comments(data: bytes) -> list[dict]:
    """Classic and threaded comments."""
    found = []
    for c in ET.fromstring(data):
        pos = next((x for x in c if _local(x.tag) == "pos"), None)
        words = [t.text or "" for t in c.iter() if _local(t.tag) in ("text", "t")]
        at = lambda k: _int(pos.get(k)) if pos is not None else None  # noqa: B023,E731
        found.append({"author_id": c.get("authorId"), "dt": c.get("dt") or c.get("created"), "idx": c.get("idx") or c.get("id"), "x": at("x"), "y": at("y"), "text": "".join(words)})
    return found


def parse_presentation(data: bytes) -> dict:
    root = ET.fromstring(data)
    size = root.find("p:sldSz", NS)
    sections = []
    for s in root.iter():
        if _local(s.tag) == "section":
            sections.append({"name": s.get("name"), "id": s.get("id"), "slide_ids": [x.get("id") for x in s.iter() if _local(x.tag) == "sldId"]})
    return {
        "slide_ids": [{"id": x.get("id"), "rid": x.get(RID)} for x in root.findall("p:sldIdLst/p:sldId", NS)],
        "sections": sections,
        "width": _int(size.get("cx")) if size is not None else None,
        "height": _int(size.get("cy")) if size is not None else None,
        "slide_masters": len(root.findall("p:sldMasterIdLst/p:sldMasterId", NS)),
        "has_notes_master": root.find("p:notesMasterIdLst", NS) is not None,
        "has_handout_master": root.find("p:handoutMasterIdLst", NS) is not None,
    }


def problem(path: str, length: int, data: bytes | None) -> str | None:
    """Why a file isn't a package, or None. (Spark's reader leaves out empty files by itself.)

    Sizes that the directory states are checked before anything is unpacked, and no part unpacks to more.
    """
    if not path.lower().endswith(".pptx"):
        return "wrong extension"
    if not length:
        return "empty file"
    if length > MAX_BYTES:
        return "file too large"
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            found = z.infolist()
            if sum(i.file_size for i in found) > MAX_UNPACKED:
                return "unpacks to too much"
            if any(i.flag_bits & 1 for i in found):
                return "encrypted"
            if bad := z.testzip():
                return f"damaged part: {bad}"
            missing = missing_parts(z.namelist())
    except zipfile.BadZipFile:
        return "not a ZIP archive"
    except UNREADABLE as e:
        return f"unreadable archive: {e}"
    return f"missing parts: {', '.join(missing)}" if missing else None


def missing_parts(names: list[str]) -> list[str]:
    """Required parts that a package lacks."""
    return [r for r in REQUIRED if r not in names]


def _numbered(name: str) -> int | None:
    m = re.search(r"(\d+)\.xml$", name)
    return int(m[1]) if m else None


def target_part(target: str | None, source: str = "ppt/presentation.xml") -> str:
    """The part that a relation of a part points to: a path from the part's folder, or from the root if it begins with a slash."""
    path = unquote((target or "").partition("#")[0])
    return posixpath.normpath(posixpath.join("/", posixpath.dirname(source), path)).lstrip("/") if path else source if target else ""


def stamp(z: zipfile.ZipFile, parts: list[str], names: set[str]) -> str:
    """A hash of all parts that a slide's row is made from."""
    made = hashlib.md5()
    for part in parts:
        content = z.read(part) if part in names else b""
        made.update(f"{part} {len(content)} {part in names} ".encode() + content)
    return made.hexdigest()


def _package(data: bytes, known: dict[str, str] | None = None) -> Iterator[dict]:
    """The package's row, then its slides'. A part that isn't well-formed leaves its fields empty and a note in the row's error.

    known: a stamp of each slide part that was parsed before. A slide whose stamp is the same isn't parsed again: its row
    is of kind ``kept`` and has only its place.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        errors: list[str] = []

        def parsed_part(name: str, parse, default):
            if name not in names:
                return default
            try:
                return parse(z.read(name))
            except (ET.ParseError, LookupError, ValueError) as e:
                errors.append(f"{name}: {e}")
                return default

        top = {"kind": "package", "part": "ppt/presentation.xml", "rels": parsed_part("ppt/_rels/presentation.xml.rels", parse_rels, [])}
        top |= parsed_part("ppt/presentation.xml", parse_presentation, {"slide_ids": [], "sections": []})
        yield top | {"error": "; ".join(errors) or None}
        targets = {r["rid"]: target_part(r["target"]) for r in reversed(top["rels"])}
        listed = {}
        for k, x in enumerate(top["slide_ids"], 1):
            listed.setdefault(targets.get(x["rid"]), (k, x["id"]))
        sections = {i: s["name"] for s in reversed(top["sections"]) for i in s["slide_ids"]}
        for name in sorted(names, key=lambda n: (_numbered(n) or 0, n)):
            if re.fullmatch(r"ppt/slides/slide\d+\.xml", name):
                errors.clear()
                own = name.replace("slides/", "slides/_rels/") + ".rels"
                number, slide_id = listed.get(name, (_numbered(name), None))
                row = {"kind": "slide", "part": name, "part_number": _numbered(name), "slide_number": number, "slide_id": slide_id, "section": sections.get(slide_id)}
                row |= {"width": top.get("width"), "height": top.get("height"), "rels": parsed_part(own, parse_rels, [])}
                notes, commented = [], []
                for r in row["rels"]:
                    target = target_part(r["target"], name)
                    if r["type"] == "notesSlide" and target in names:
                        notes.append(target)
                    if r["type"].startswith("comment"):
                        commented.append(target)
                # Notes also name their slide; without either relation the number of the part decides.
                if not notes and f"ppt/notesSlides/notesSlide{row['part_number']}.xml" in names:
                    alone = f"ppt/notesSlides/notesSlide{row['part_number']}.xml"
                    back = [r["target"] or "" for r in parsed_part(alone.replace("notesSlides/", "notesSlides/_rels/") + ".rels", parse_rels, []) if r["type"] == "slide"]
                    notes = [alone] if not back or any(t.endswith(f"/slide{row['part_number']}.xml") for t in back) else []
                content = z.read(name)
                row["digest"] = hashlib.md5(content).hexdigest()
                if known is not None:
                    row["stamp"] = stamp(z, [name, own, *notes[:1], *commented], names)
                    if known.get(name) == row["stamp"]:
                        yield {k: row[k] for k in ("part", "part_number", "slide_number", "slide_id", "section", "width", "height", "digest", "stamp")} | {"kind": "kept"}
                        continue
                row |= parsed_part(name, lambda _: parse_slide(content), {})  # noqa: B023
                row |= {"notes": parsed_part(notes[0], parse_notes, None) if notes else None, "comments": [c for t in commented for c in parsed_part(t, parse_comments, [])]}
                yield row | {"error": "; ".join(errors) or None}


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that a task has one file's bytes beside its batch and not a second copy of all."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def packages(spark: SparkSession, path: str) -> DataFrame:
    """All packages below a path, parsed."""
    return parsed(binary(spark, path))


def parsed(files: DataFrame) -> DataFrame:
    """Rows of kind ``slide`` and ``package``, and ``reject`` with an error, of files as the binary source reads them.

    A part that isn't well-formed leaves its own fields empty and its error in the row: a slide keeps its number,
    and a package whose list of slides can't be read keeps them by the numbers of their parts. A file is parsed by one
    task, as its parts share one archive; files larger than 100 MB are rejected without being unzipped.
    """
    fields = T.StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(fields)
    blank = dict.fromkeys(fields.names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for f in each(batches):
            own = {"file": f["path"], "modified": f["modificationTime"], "length": f["length"]}
            why = problem(f["path"], f["length"], f["content"])
            for r in [{"kind": "reject", "error": why}] if why else _package(f["content"]):
                yield blank | own | r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(rows(batches), BATCH_ROWS):
            yield pa.RecordBatch.from_pylist(list(some), schema=arrow)

    content = F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content")
    return files.select("path", "modificationTime", "length", content).mapInArrow(run, fields)


def rejects(parsed_rows: DataFrame) -> DataFrame:
    """file, error_type, error of files that aren't packages, and of parts that couldn't be read."""
    kind = F.when(F.col("kind") == "reject", "invalid_file").otherwise("unreadable_part")
    return parsed_rows.where("error IS NOT NULL").select("file", kind.alias("error_type"), "part", "error")


def metadata(files: DataFrame) -> DataFrame:
    """file, name, extension, length, modified and identity (a hash of path, length and time) of files as the binary source reads them."""
    name = F.element_at(F.split("path", "/"), -1)
    identity = F.sha2(F.concat_ws(":", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    return files.select(
        F.col("path").alias("file"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), "length", F.col("modificationTime").alias("modified"), identity.alias("identity")
    )


def parts(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """The parts of every readable archive below a path."""
    return parts_of(binary(spark, path), content)


def parts_of(files: DataFrame, content: bool = False) -> DataFrame:
    """file, ordinal (in archive order, from 0), name, size, is_xml of every part, without unpacking them; on demand content.

    Only parts of up to 100 MB are unpacked; others, and damaged ones, have no content. An archive that can't be
    opened has no parts.
    """
    fields = "file string, ordinal int, name string, size long, is_xml boolean" + ", content binary" * content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in each([batch]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(f["content"] or b""))
                    found = z.infolist()
                except UNREADABLE:
                    continue
                columns = [
                    pa.array([f["path"]] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([i.filename for i in found], pa.string()),
                    pa.array([i.file_size for i in found], pa.int64()), pa.array([bool(re.search(r"\.(xml|rels)$", i.filename)) for i in found], pa.bool_()),
                ]
                if content:
                    columns.append(pa.array([_unpacked(z, i) for i in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in fields.split(", ")])

    return files.select("path", "content").mapInArrow(run, fields)


def _unpacked(z: zipfile.ZipFile, i: zipfile.ZipInfo) -> bytes | None:
    try:
        return z.read(i) if i.file_size <= MAX_BYTES else None
    except UNREADABLE:
        return None


def xml_parts(found: DataFrame) -> DataFrame:
    return found.where("is_xml")


def part(found: DataFrame, name: str) -> DataFrame:
    """A part by its name, one row a file that has it."""
    return found.where(F.col("name") == name)


#: Where parts of a kind stand.
PLACES = {"slides": r"^ppt/slides/slide.*\.xml$", "layouts": r"^ppt/slideLayouts/slideLayout.*\.xml$", "notes": r"^ppt/notesSlides/notesSlide.*\.xml$", "media": r"^ppt/media/."}


def parts_like(found: DataFrame, kind: str) -> DataFrame:
    """Slides, layouts, notes or media, with ``ordinal`` as their archive order."""
    return found.where(F.col("name").rlike(PLACES[kind]))


def required(found: DataFrame) -> DataFrame:
    """file, name of each required part that a package lacks."""
    wanted = found.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, REQUIRED))).alias("name"))
    return wanted.join(found.select("file", "name"), ["file", "name"], "left_anti")


def elements(found: DataFrame, path: str, first: bool = False) -> DataFrame:
    """file, name, at, tag, text, attributes of the elements that a path finds in XML parts with content.

    The path is one of ElementTree's, with the prefixes p, a, r and rel, as ``.//a:t``. ``text`` is all text
    within the element; attributes keep their prefix, as ``r:id``. A part that isn't well-formed has none.
    """
    prefixes = {uri: p for p, uri in NS.items()}

    def short(name: str) -> str:
        uri, _, local = name[1:].partition("}") if name[0] == "{" else ("", "", name)
        return f"{prefixes[uri]}:{local}" if uri in prefixes else local

    kinds = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                try:
                    hits = ET.fromstring(f["content"] or b"").findall(path, NS)
                except ET.ParseError:
                    continue
                hits = hits[:1] if first else hits
                columns = [[f["file"]] * len(hits), [f["name"]] * len(hits), list(range(len(hits))), [short(e.tag) for e in hits], ["".join(e.itertext()) for e in hits], [[(short(k), v) for k, v in e.items()] for e in hits]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), kinds))], ["file", "name", "at", "tag", "text", "attributes"])

    return found.where("is_xml").select("file", "name", "content").mapInArrow(run, "file string, name string, at int, tag string, text string, attributes map<string,string>")


def census(found: DataFrame) -> DataFrame:
    """Per package: number of parts, slides, layouts, notes and media, and whether the required ones are there."""
    name = F.col("name")
    return found.groupBy("file").agg(
        F.count("*").alias("parts"),
        F.count_if(name.rlike(r"^ppt/slides/slide\d+\.xml$")).alias("slides"),
        F.count_if(name.rlike(r"^ppt/slideLayouts/slideLayout\d+\.xml$")).alias("layouts"),
        F.count_if(name.rlike(r"^ppt/notesSlides/notesSlide\d+\.xml$")).alias("notes"),
        F.count_if(name.startswith("ppt/media/")).alias("media"),
        F.sum("size").alias("bytes"),
        *(F.bool_or(name == r).alias(f"has_{k}") for k, r in zip(("content_types", "rels", "presentation"), REQUIRED)),
    )
