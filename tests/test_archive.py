"""The data source of package parts: equal rows to the mapper's, ranges, and how much it reads."""

import io
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, Not, StringEndsWith, StringStartsWith

from deckhand.sources import archive, ooxml


def made(folder: Path, names: dict[str, bytes], file: str, stored: bool = False) -> Path:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for n, content in names.items():
            z.writestr(n, content)
    (folder / file).write_bytes(data.getvalue())
    return folder / file


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("archives")
    (path / "sub").mkdir()
    for k in range(12):
        made(path, {"[Content_Types].xml": b"<Types/>", "ppt/a.xml": b"<a>%d</a>" % k, "ppt/media/x.bin": bytes(range(256)) * 40 * k}, f"{k}.pptx", stored=True)
    made(path / "sub", {}, "none.pptx")
    (path / "bad.pptx").write_bytes(b"not an archive")
    (path / "empty.pptx").write_bytes(b"")
    (path / "other.txt").write_bytes(b"x")
    return path


def rows(df, *names):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*names).collect())


def test_equal_to_the_mapper(spark, folder):
    columns = ["ordinal", "name", "size", "is_xml", "content"]
    expected = rows(ooxml.parts(spark, str(folder), content=True), F.element_at(F.split("file", "/"), -1).alias("file"), *columns)
    for size in ("30000", "100000000"):
        got = archive.scan(spark, folder.as_uri(), content=True, range_bytes=size)
        assert rows(got, F.element_at(F.split("file", "/"), -1).alias("file"), *columns) == expected and len(expected) == 36
    assert archive.scan(spark, str(folder)).columns == ["file", "ordinal", "name", "size", "is_xml", "length", "bytes_read"]
    assert archive.scan(spark, str(folder)).where("name = 'ppt/a.xml'").count() == 12
    assert archive.scan(spark, str(folder / "sub")).count() == 0


def test_filters_are_pushed(spark, folder):
    found = archive.scan(spark, folder.as_uri(), content=True)
    name = f"{folder.as_uri()}/7.pptx"
    assert found.select("file").distinct().count() == 12 and found.where(F.col("file") == name).select("name").count() == 3
    one = found.where((F.col("file") == name) & F.col("name").startswith("ppt/") & F.col("name").isin("ppt/a.xml", "zzz") & (F.col("size") > 0)).collect()
    assert [bytes(r.content) for r in one] == [b"<a>7</a>"]
    plan = found.where(F.col("name") == "ppt/a.xml")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter (isnotnull" not in plan
    reader = archive.PackageParts({"path": str(folder)}).reader(archive.SCHEMA)
    kept = [Not(EqualTo(("name",), "x")), EqualTo(("size",), 3)]
    assert list(reader.pushFilters([IsNotNull(("name",)), EqualTo(("name",), "a"), *kept, In(("ordinal",), (1, 2)), StringStartsWith(("file",), "f"), StringEndsWith(("name",), "a")])) == kept
    assert reader.passes("name", "a") and not reader.passes("name", "b") and not reader.passes("ordinal", 0) and not reader.passes("file", "x")


def test_a_lookup_reads_one_part(folder):
    big = made(folder.parent, {f"part{k}": bytes(range(256)) * 400 for k in range(50)} | {"wanted": b"x" * 1000}, "big.pptx", stored=True)
    reader = archive.PackageParts({"path": str(big)}).reader(archive.SCHEMA)
    assert list(reader.pushFilters([EqualTo(("name",), "wanted")])) == []
    (task,) = reader.partitions()
    (row,) = (r for b in reader.read(task) for r in b.to_pylist())
    assert row["content"] == b"x" * 1000 and row["length"] > 5_000_000 and row["bytes_read"] < 10_000
    without = archive.PackageParts({"path": str(big)}).reader(archive.T.StructType([f for f in archive.SCHEMA if f.name in ("name", "bytes_read")]))
    found = [r for t in without.partitions() for b in without.read(t) for r in b.to_pylist()]
    assert len(found) == 51 and set(found[0]) == {"name", "bytes_read"} and max(r["bytes_read"] for r in found) < 10_000


def test_plans_are_bounded():
    files = [(f"f{k}", 10) for k in range(1000)] + [("big", 1000), ("none", 0)]
    tasks = archive.planned(files, 100)
    assert sum(hi - lo for t in tasks for _, _, lo, hi in t.files) == 11_001 and len(tasks) < 130
    assert all(sum(hi - lo for _, _, lo, hi in t.files) <= 100 for t in tasks)
    assert len(archive.planned(files, 1, most=50)) <= 60 and archive.planned([]) == []
    assert sorted({(lo, hi) for t in tasks for p, _, lo, hi in t.files if p == "big"}) == [(k, k + 100) for k in range(0, 1000, 100)]


def test_written_packages_come_back(spark, folder, tmp_path):
    files = ooxml.binary(spark, str(folder)).where("path LIKE '%pptx'")
    archive.write_packages(files, tmp_path.as_uri()).collect()
    archive.write_packages(files, tmp_path.as_uri()).collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["bad.pptx", "none.pptx", *(f"{k}.pptx" for k in range(12))])
    assert archive.scan(spark, str(tmp_path)).count() == 36
