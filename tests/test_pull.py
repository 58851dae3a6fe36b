"""Pull parsing: equal to the tree parser, and bounded memory."""

import io
import subprocess
import sys
import zipfile
from pathlib import Path

from deckhand.sources import archive, ooxml, pull, writer

RUN = '<a:r><a:rPr b="1" sz="1200"/><a:t>{}</a:t></a:r>'
CELL = '<a:tc gridSpan="2"><a:txBody><a:p>' + RUN.format("c{}") + "</a:p><a:p/></a:txBody><a:tcPr><a:solidFill><a:srgbClr val='FF0000'/></a:solidFill></a:tcPr></a:tc>"
SHAPES = (
    "<p:nvGrpSpPr/><p:sp><p:nvSpPr><p:nvPr><p:ph type='title'/></p:nvPr></p:nvSpPr><p:txBody><a:bodyPr/><a:p>" + RUN.format("t") + "<a:br/><a:fld><a:t>5</a:t></a:fld></a:p></p:txBody></p:sp><p:pic/><p:sp/>"
    "<p:grpSp><p:grpSp><p:sp><p:nvSpPr><p:nvPr><p:ph/></p:nvPr></p:nvSpPr><p:txBody><a:p>" + RUN.format("g") + "</a:p><a:p/></p:txBody></p:sp></p:grpSp><p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>" + CELL.format(1) + "</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame></p:grpSp>"
    "<p:graphicFrame><a:graphic/></p:graphicFrame><p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tblPr/><a:tr>" + CELL.format(2) + CELL.format(3) + "</a:tr><a:tr/></a:tbl></a:graphicData></a:graphic></p:graphicFrame><p:cxnSp/>"
)
SLIDE = f"<p:sld {writer.P}><p:cSld name='n'><p:spTree>%s</p:spTree></p:cSld></p:sld>"


def as_pieces(slide: dict) -> list:
    """The tree parser's shapes and tables as pieces; its filled-up cells have no border at all."""
    shapes = [("para", s["idx"], s["ph_type"], k, p) for s in slide["shapes"] for k, p in enumerate(s["paras"])]
    return shapes, [("row", t["idx"], None, k, [c for c in r if c["border"]]) for t in slide["tables"] for k, r in enumerate(t["rows"])]


def test_equal_to_the_tree_parser():
    data = (SLIDE % SHAPES).encode()
    found = list(pull.stream(io.BytesIO(data)))
    shapes, rows = as_pieces(ooxml.parse_slide(data))
    assert [(x["kind"], x["idx"], x["ph_type"], x["at"], x["runs"]) for x in found if x["kind"] == "para"] == shapes and len(shapes) == 3
    assert [(x["kind"], x["idx"], x["ph_type"], x["at"], x["cells"]) for x in found if x["kind"] == "row"] == rows and len(rows) == 3
    assert [x["in_group"] for x in found] == [False, True, True, True, False, False]


MEASURE = """
import resource, sys, zipfile
sys.path.insert(0, sys.argv[2])
from deckhand.sources import pull
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with zipfile.ZipFile(sys.argv[1]) as z, z.open("big.xml") as part:
    size, n = z.getinfo("big.xml").file_size, sum(1 for _ in pull.stream(part))
print(n, size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_part_of_100_mb_takes_little_memory(tmp_path):
    para, row = "<a:p>" + RUN.format("word " * 400) + "</a:p>", "<a:tr>" + CELL.format(1) * 2 + "</a:tr>"
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("big.xml", "w") as f:
        head, tail = (SLIDE % "@").split("@")
        f.write(head.encode() + b"<p:sp><p:txBody>")
        for _ in range(50):
            f.write((para * 1000).encode())
        f.write(b"</p:txBody></p:sp><p:graphicFrame><a:graphic><a:graphicData><a:tbl>")
        for _ in range(20):
            f.write((row * 1000).encode())
        f.write(f"</a:tbl></a:graphicData></a:graphic></p:graphicFrame>{tail}".encode())
    out = subprocess.run([sys.executable, "-c", MEASURE, str(tmp_path / "big.zip"), str(Path(__file__).parents[1])], capture_output=True, text=True, check=True)
    n, size, mb = map(int, out.stdout.split())
    assert n == 70_000 and size > 100_000_000 and mb < 30, (n, size, mb)


def test_pieces_of_archives(spark, tmp_path):
    for name, slides in (("a", [SHAPES, ""]), ("b", ["<p:sp><p:txBody><a:p>" + RUN.format("x") + "</a:p></p:txBody></p:sp><broken"])):
        with zipfile.ZipFile(tmp_path / f"{name}.pptx", "w") as z:
            for k, s in enumerate(slides, 1):
                z.writestr(f"ppt/slides/slide{k}.xml", SLIDE % s)
                z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", "<x/>")
    found = pull.pieces(archive.scan(spark, tmp_path.as_uri())).collect()
    assert sorted((r.file[-6:], r.part[-5], r.kind) for r in found) == sorted([("a.pptx", "1", "para")] * 3 + [("a.pptx", "1", "row")] * 3 + [("b.pptx", "1", "para"), ("b.pptx", "1", "error")])
    assert [r.error for r in pull.pieces(spark.createDataFrame([((tmp_path / "a.pptx").as_uri(), "ppt/slides/slide9.xml")], "file string, name string")).collect()] != [None]
    assert pull.pieces(archive.scan(spark, tmp_path.as_uri()).limit(0)).count() == 0
