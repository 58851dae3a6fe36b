"""Packages made from a table of slides, as the binary source would read them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckhand.sources.ooxml import NS

P = " ".join(f"xmlns:{k}={quoteattr(NS[k])}" for k in ("p", "a", "r"))
R = f"xmlns={quoteattr(NS['rel'])}"
OFFICE = NS["r"]
#: Fixed value: the namespace of lists of sections.
SECTIONS = "http://schemas.microsoft.com/office/powerpoint/2010/main"
#: Fixed value: the namespace of threaded comments.
THREADED = "http://schemas.microsoft.com/office/powerpoint/2018/8/main"

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,size:int,color:string,highlight:string,url:string>"
#: What a slide is made of; size is in hundredths of a point, colors are six digits.
SLIDE = (
    f"file string, slide_number int, layout_name string, title string, subtitle string, body array<array<{RUN}>>, cells array<array<struct<text:string,span:int>>>, "
    "pictures int, charts int, connectors int, notes string, comment string, section string"
)


#: A slide of a varied deck: a cell is one run; colors are six digits or names of the scheme.
CELL = f"struct<run:{RUN},fill:string,row_span:int,col_span:int,covered:boolean>"
VARIED = (
    f"file string, slide_number int, title string, subtitle string, bodies array<{RUN}>, tables array<array<array<{CELL}>>>, parted boolean, pictures int, videos int, charts int, "
    "connectors int, grouped array<string>, notes string, notes_of int, threaded string"
)


#: Slides that become Python objects at a time.
SOME = 16


class Slides(Sequence):
    """A file's slides in order. They stay columns, and some at a time become Python objects, however many the file has.

    They are ordered by the columns named, nulls as empty text; equal ones stay as they come.
    """

    def __init__(self, table: pa.Table, *by: str):
        keys = [tuple("" if v is None else v for v in row.values()) for row in table.select(by).to_pylist()]
        self.table, self.order = table.combine_chunks(), sorted(range(table.num_rows), key=keys.__getitem__)

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, k: int) -> dict:
        return self.table.slice(self.order[k], 1).to_pylist()[0]

    def __iter__(self) -> Iterator[dict]:
        for k in range(0, len(self), SOME):
            yield from self.table.take(self.order[k : k + SOME]).to_pylist()

    def column(self, name: str) -> list:
        found = self.table[name].to_pylist()
        return [found[k] for k in self.order]


def _fill(color: str | None) -> str:
    tag = "srgbClr" if re.fullmatch("[0-9A-Fa-f]{6}", color or "") else "schemeClr"
    return f'<a:solidFill><a:{tag} val="{color}"/></a:solidFill>' if color else ""


def _run(run: dict, links: list[str]) -> str:
    attributes = "".join(f' {name}="{value}"' for name, value in (("sz", run["size"]), ("b", run["bold"] and 1), ("i", run["italic"] and 1), ("u", run["underline"] and "sng"), ("strike", run["strike"] and "sngStrike")) if value)
    inner = _fill(run["color"])
    inner += f'<a:highlight><a:srgbClr val="{run["highlight"]}"/></a:highlight>' if run["highlight"] else ""
    if run["url"]:
        links.append(run["url"])
        inner += f'<a:hlinkClick r:id="rIdL{len(links)}"/>'
    return f'<a:r><a:rPr{attributes}>{inner}</a:rPr><a:t>{escape(run["text"] or "")}</a:t></a:r>'


def _shape(paragraphs: Iterable[str], ph: str | None) -> str:
    kind = f'<p:ph type="{ph}"/>' if ph else ""
    return f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{''.join(f'<a:p>{p}</a:p>' for p in paragraphs)}</p:txBody></p:sp>"


def _plain(text: str) -> str:
    return f"<a:r><a:t>{escape(text)}</a:t></a:r>"


def _table(rows: list[list[dict]]) -> str:
    out = []
    for row in rows:
        cells = []
        for c in row:
            span = c["span"] or 1
            cells.append(f"<a:tc{f' gridSpan={quoteattr(str(span))}' if span > 1 else ''}><a:txBody><a:p>{_plain(c['text'] or '')}</a:p></a:txBody><a:tcPr/></a:tc>")
            cells += ['<a:tc hMerge="1"><a:txBody><a:p/></a:txBody><a:tcPr/></a:tc>'] * (span - 1)
        out.append(f"<a:tr>{''.join(cells)}</a:tr>")
    return f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{''.join(out)}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"


def _rels(rows: Iterable[tuple[str, str, str]]) -> str:
    return f"<Relationships {R}>{''.join(f'<Relationship Id={quoteattr(i)} Type={quoteattr(f'{OFFICE}/{kind}')} Target={quoteattr(target)}/>' for i, kind, target in rows)}</Relationships>"


def package(slides: Sequence[dict], width: int = 9144000, height: int = 6858000) -> bytes:
    """One package of slides in order. Their parts are numbered from the last slide to the first, as an edited deck's may be."""
    out, n = io.BytesIO(), len(slides)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)
        put("[Content_Types].xml", "<Types/>")
        put("_rels/.rels", _rels([("rId1", "officeDocument", "ppt/presentation.xml")]))
        ids = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in range(n))
        named: dict[str, list[int]] = {}
        for k, section in enumerate(slides.column("section") if isinstance(slides, Slides) else [s["section"] for s in slides]):
            if section is not None:
                named.setdefault(section, []).append(k)
        listed = "".join(f'<s:section name={quoteattr(name)} id="{{{j}}}"><s:sldIdLst>{"".join(f"<s:sldId id={quoteattr(str(256 + k))}/>" for k in own)}</s:sldIdLst></s:section>' for j, (name, own) in enumerate(named.items()))
        sections = f'<p:extLst><p:ext><s:sectionLst xmlns:s="{SECTIONS}">{listed}</s:sectionLst></p:ext></p:extLst>'
        put("ppt/presentation.xml", f'<p:presentation {P}><p:sldMasterIdLst><p:sldMasterId r:id="rIdM"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{width}" cy="{height}"/>{sections}</p:presentation>')
        put("ppt/_rels/presentation.xml.rels", _rels((f"rId{k}", "slide", f"slides/slide{n - k}.xml") for k in range(n)))
        for k, s in enumerate(slides):
            part, links, rels = n - k, [], []
            inner = _shape([_plain(s["title"])], "ctrTitle" if k == 0 else "title") if s["title"] is not None else ""
            inner += _shape([_plain(s["subtitle"])], "subTitle") if s["subtitle"] is not None else ""
            inner += _shape(["".join(_run(r, links) for r in p) for p in s["body"]], "body") if s["body"] else ""
            inner += _table(s["cells"]) if s["cells"] else ""
            inner += "<p:pic/>" * (s["pictures"] or 0) + "<p:cxnSp/>" * (s["connectors"] or 0)
            inner += "<p:graphicFrame><a:graphic><a:graphicData><c:chart xmlns:c='urn:chart'/></a:graphicData></a:graphic></p:graphicFrame>" * (s["charts"] or 0)
            put(f"ppt/slides/slide{part}.xml", f'<p:sld {P}><p:cSld name={quoteattr(s["layout_name"] or "")}><p:spTree>{inner}</p:spTree></p:cSld></p:sld>')
            rels += [(f"rIdL{j}", "hyperlink", url) for j, url in enumerate(links, 1)]
            if s["notes"] is not None:
                rels.append(("rIdN", "notesSlide", f"../notesSlides/notesSlide{k + 1}.xml"))
                put(f"ppt/notesSlides/notesSlide{k + 1}.xml", f"<p:notes {P}><p:cSld><p:spTree>{_shape([_plain(s['notes'])], 'body')}</p:spTree></p:cSld></p:notes>")
                put(f"ppt/notesSlides/_rels/notesSlide{k + 1}.xml.rels", _rels([("rId1", "slide", f"../slides/slide{part}.xml")]))
            if s["comment"] is not None:
                rels.append(("rIdC", "comments", f"../comments/comment{part}.xml"))
                put(f"ppt/comments/comment{part}.xml", f'<p:cmLst {P}><p:cm authorId="0" dt="2020-01-01T00:00:00" idx="1"><p:pos x="{k}" y="{part}"/><p:text>{escape(s["comment"])}</p:text></p:cm></p:cmLst>')
            put(f"ppt/slides/_rels/slide{part}.xml.rels", _rels(rels))
        put("ppt/slideLayouts/slideLayout1.xml", f"<p:sldLayout {P}/>")
    return out.getvalue()


def dealt(slides: DataFrame, tasks: int | None) -> DataFrame:
    """Slides dealt by file to so many tasks. Without a number Spark decides by their bytes, which are few for the work that packages are."""
    return slides.repartition(tasks, "file") if tasks else slides


def packages_of(slides: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of one package for each file of a table with the columns of SLIDE.

    A file's slides are ordered by number; equal numbers by title. A file is one package, so its slides meet in
    one task, of which there are ``tasks`` (see ``dealt``), as columns beside the archive that is made (see ``Slides``).
    """

    def build(key: tuple, table: pa.Table) -> pa.Table:
        data = package(Slides(table, "slide_number", "title"))
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "length": pa.array([len(data)], pa.int64()), "content": pa.array([data], pa.binary())})

    made = dealt(slides, tasks).groupBy("file").applyInArrow(build, "path string, length long, content binary")
    return made.select("path", F.lit("2020-01-01 00:00:00").cast("timestamp").alias("modificationTime"), "length", "content")


CHART = "<p:graphicFrame><a:graphic><a:graphicData><c:chart xmlns:c='urn:chart'/></a:graphicData></a:graphic></p:graphicFrame>"
VIDEO = '<p:pic><p:nvPicPr><p:nvPr><a:videoFile r:link="rIdV"/></p:nvPr></p:nvPicPr></p:pic>'


def _varied_table(rows: list[list[dict]]) -> str:
    out = []
    for row in rows:
        cells = []
        for c in row:
            attributes = "".join(f' {name}="{value}"' for name, value in (("rowSpan", c["row_span"]), ("gridSpan", c["col_span"])) if (value or 1) > 1)
            attributes += ' vMerge="1"' if c["covered"] else ""
            text = "" if c["covered"] else _run(c["run"], [])
            cells.append(f"<a:tc{attributes}><a:txBody><a:p>{text}</a:p></a:txBody><a:tcPr>{_fill(c['fill'])}</a:tcPr></a:tc>")
            cells += ['<a:tc hMerge="1"><a:txBody><a:p/></a:txBody><a:tcPr/></a:tc>'] * ((c["col_span"] or 1) - 1)
        out.append(f"<a:tr>{''.join(cells)}</a:tr>")
    return f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{''.join(out)}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"


def varied_package(slides: Sequence[dict]) -> bytes:
    """A package of slides of VARIED: any tables, groups, videos, scheme colors, threaded comments.

    Notes have the number of their slide and no relation from it; with ``notes_of`` they say themselves which slide they are of.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)
        put("[Content_Types].xml", "<Types/>")
        put("_rels/.rels", _rels([("rId1", "officeDocument", "ppt/presentation.xml")]))
        ids = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in range(len(slides)))
        put("ppt/presentation.xml", f"<p:presentation {P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        put("ppt/_rels/presentation.xml.rels", _rels((f"rId{k}", "slide", f"slides/slide{k + 1}.xml") for k in range(len(slides))))
        for k, s in enumerate(slides, 1):
            rels = []
            inner = _shape([_plain(s["title"])], "title") if s["title"] is not None else ""
            inner += _shape([_plain(s["subtitle"])], "subTitle") if s["subtitle"] is not None else ""
            inner += "".join(_shape([_run(r, [])], "body") for r in s["bodies"] or [])
            inner += (CHART if s["parted"] else "").join(_varied_table(t) for t in s["tables"] or [])
            inner += "<p:pic/>" * ((s["pictures"] or 0) - (s["videos"] or 0)) + VIDEO * (s["videos"] or 0) + CHART * (s["charts"] or 0) + "<p:cxnSp/>" * (s["connectors"] or 0)
            inner += f"<p:grpSp>{''.join(_shape([_plain(t)], None) for t in s['grouped'])}</p:grpSp>" if s["grouped"] else ""
            put(f"ppt/slides/slide{k}.xml", f"<p:sld {P}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>")
            if s["notes"] is not None:
                put(f"ppt/notesSlides/notesSlide{k}.xml", f"<p:notes {P}><p:cSld><p:spTree>{_shape([_plain(s['notes'])], 'body')}</p:spTree></p:cSld></p:notes>")
                if s["notes_of"]:
                    put(f"ppt/notesSlides/_rels/notesSlide{k}.xml.rels", _rels([("rId1", "slide", f"../slides/slide{s['notes_of']}.xml")]))
            if s["threaded"] is not None:
                rels.append(("rIdT", "comments", f"../comments/modernComment_{k}.xml"))
                body = f"<m:txBody><a:p>{_plain(s['threaded'])}</a:p></m:txBody>"
                put(f"ppt/comments/modernComment_{k}.xml", f'<m:cmLst xmlns:m="{THREADED}" {P}><m:cm id="{{{k}}}" authorId="{{A}}" created="2021-01-01T00:00:00">{body}</m:cm></m:cmLst>')
            put(f"ppt/slides/_rels/slide{k}.xml.rels", _rels(rels))
    return out.getvalue()


def varied_of(slides: DataFrame, tasks: int | None = None) -> DataFrame:
    """Packages of a table with the columns of VARIED, like ``packages_of``."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        data = varied_package(Slides(table, "slide_number"))
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "length": pa.array([len(data)], pa.int64()), "content": pa.array([data], pa.binary())})

    made = dealt(slides, tasks).groupBy("file").applyInArrow(build, "path string, length long, content binary")
    return made.select("path", F.lit("2020-01-01 00:00:00").cast("timestamp").alias("modificationTime"), "length", "content")


def _look(tag: str, of: dict, more: str = "") -> str:
    """Properties of a run or a level; only what is given."""
    attributes = "".join(f' {name}="{value}"' for name, value in (("sz", of.get("size")), ("b", None if of.get("bold") is None else int(of["bold"]))) if value is not None)
    fill = f'<a:solidFill><a:srgbClr val="{of["color"]}"/></a:solidFill>' if of.get("color") else ""
    return f"<a:{tag}{attributes}>{fill}{more}</a:{tag}>"


def _level(tag: str, of: dict, lvl: int | None = None) -> str:
    """Properties of paragraphs: a bullet character, "#" for numbers or "" for none, and those of its runs."""
    bullet = of.get("bullet")
    mark = "" if bullet is None else "<a:buNone/>" if not bullet else '<a:buAutoNum type="arabicPeriod"/>' if bullet == "#" else f"<a:buChar char={quoteattr(bullet)}/>"
    return f"<a:{tag}{f' lvl={quoteattr(str(lvl))}' if lvl else ''}>{mark}{_look('defRPr', of)}</a:{tag}>"


def _levels(tag: str, of: list[dict]) -> str:
    return f"<{tag}>{''.join(_level('defPPr' if s['lvl'] < 0 else f'lvl{s["lvl"] + 1}pPr', s) for s in of)}</{tag}>"


def styled_package(slides: Sequence[dict]) -> bytes:
    """A package whose slides have a shape with list styles (``styles``) and paragraphs (``paras``); the first slide's ``deck`` are the presentation's."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)
        put("[Content_Types].xml", "<Types/>")
        put("_rels/.rels", _rels([("rId1", "officeDocument", "ppt/presentation.xml")]))
        ids = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in range(len(slides)))
        put("ppt/presentation.xml", f"<p:presentation {P}><p:sldIdLst>{ids}</p:sldIdLst>{_levels('p:defaultTextStyle', slides[0]['deck'] or [])}</p:presentation>")
        put("ppt/_rels/presentation.xml.rels", _rels((f"rId{k}", "slide", f"slides/slide{k + 1}.xml") for k in range(len(slides))))
        for k, s in enumerate(slides):
            runs = lambda p: "".join(f"<a:r>{_look('rPr', r)}<a:t>{escape(r['text'] or '')}</a:t></a:r>" for r in p["runs"])
            paras = "".join(f"<a:p>{_level('pPr', p, p['lvl'])}{runs(p)}</a:p>" for p in s["paras"])
            body = f"<p:txBody><a:bodyPr/>{_levels('a:lstStyle', s['styles'] or [])}{paras}</p:txBody>"
            put(f"ppt/slides/slide{k + 1}.xml", f"<p:sld {P}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr>{body}</p:sp></p:spTree></p:cSld></p:sld>")
            put(f"ppt/slides/_rels/slide{k + 1}.xml.rels", _rels([]))
    return out.getvalue()


def styled_of(slides: DataFrame, tasks: int | None = None) -> DataFrame:
    """Packages of a table of file, slide_number, deck, styles and paras (see ``styled_package``), like ``packages_of``."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        data = styled_package(Slides(table, "slide_number"))
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "length": pa.array([len(data)], pa.int64()), "content": pa.array([data], pa.binary())})

    made = dealt(slides, tasks).groupBy("file").applyInArrow(build, "path string, length long, content binary")
    return made.select("path", F.lit("2020-01-01 00:00:00").cast("timestamp").alias("modificationTime"), "length", "content")
