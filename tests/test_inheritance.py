"""Effective formatting: each property from the nearest level that states it."""

import io
import zipfile

from deckhand.operators import inheritance
from deckhand.sources import styles, writer
from deckhand.sources.writer import _rels

SLIDE = f"<p:sld {writer.P}><p:cSld><p:spTree>%s</p:spTree></p:cSld></p:sld>"


def deck(shapes: str, defaults: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in {
            "[Content_Types].xml": "<Types/>", "_rels/.rels": "<x/>", "ppt/presentation.xml": f'<p:presentation {writer.P}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst>{defaults}</p:presentation>',
            "ppt/_rels/presentation.xml.rels": _rels([("r1", "slide", "slides/slide7.xml")]), "ppt/slides/slide7.xml": SLIDE % shapes,
        }.items():
            z.writestr(name, text)
    return out.getvalue()


def effective(spark, *decks: bytes):
    files = spark.createDataFrame([(f"{k}.pptx", len(d), d) for k, d in enumerate(decks)], "path string, length long, content binary")
    return inheritance.effective(styles.paragraphs(files))


def shape(body: str, ph: str = "") -> str:
    return f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"


def test_properties_come_from_their_own_levels(spark):
    defaults = '<p:defaultTextStyle><a:defPPr marL="5"><a:defRPr u="sng"/></a:defPPr><a:lvl2pPr><a:buChar char="-"/><a:defRPr sz="1200" i="1"/></a:lvl2pPr></p:defaultTextStyle>'
    lists = '<a:lstStyle><a:lvl2pPr marL="300"><a:buAutoNum type="x"/><a:defRPr b="1"/></a:lvl2pPr></a:lstStyle>'
    body = lists + '<a:p><a:pPr lvl="1"><a:defRPr><a:solidFill><a:schemeClr val="accent1"/></a:solidFill></a:defRPr></a:pPr><a:r><a:rPr b="0"/><a:t>a</a:t></a:r><a:fld><a:t>b</a:t></a:fld></a:p><a:p><a:r><a:t>c</a:t></a:r></a:p><a:p/>'
    group = f"<p:grpSp>{shape('<a:p><a:r><a:rPr sz=%sx%s/><a:t>d</a:t></a:r></a:p>' % (chr(34), chr(34)), '<p:ph type=%stitle%s/>' % (chr(34), chr(34)))}</p:grpSp>"
    rows = {r.text: r for r in effective(spark, deck(shape(body) + group, defaults)).collect()}
    assert rows.keys() == {"a", "b", "c", "d"}
    a, b, c, d = (rows[k] for k in "abcd")
    assert (a.size, a.size_from, a.bold, a.italic, a.underline, a.color, a.bullet, a.mark, a.indent, a.lvl) == (12.0, "deck_level", False, True, True, "accent1", "number", "x", 300, 1)
    assert b.bold and b.run == 1
    assert (c.size, c.size_from, c.bold, c.italic, c.underline, c.color, c.bullet, c.mark, c.indent, c.lvl) == (18.0, "default", False, False, True, None, "none", None, 5, 0)
    assert (d.size, d.ph_type, d.shape) == (44.0, "title", 1)
    assert [(r.text_content, r.bullet) for r in inheritance.bullets(effective(spark, deck(shape(body), defaults))).collect()] == [("ab", "number")]


def test_a_bullets_mark_goes_with_its_level(spark):
    body = '<a:lstStyle><a:lvl1pPr><a:buChar char="*"/></a:lvl1pPr></a:lstStyle><a:p><a:pPr><a:buBlip/></a:pPr><a:r><a:t>a</a:t></a:r></a:p><a:p><a:pPr><a:buNone/></a:pPr><a:r><a:t>b</a:t></a:r></a:p><a:p><a:r><a:t> </a:t></a:r></a:p>'
    rows = {r.text: (r.bullet, r.mark) for r in effective(spark, deck(shape(body))).collect()}
    assert rows == {"a": ("picture", None), "b": ("none", None), " ": ("char", "*")}


def test_files_without_paragraphs(spark):
    good = deck(shape("<a:p><a:r><a:t>x</a:t></a:r></a:p>"))
    assert [r.file for r in effective(spark, b"no archive", deck("<p:sp>"), deck(""), deck(shape("")), good).collect()] == ["4.pptx"]
    assert effective(spark, good).limit(0).count() == 0
