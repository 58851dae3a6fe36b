"""Runs over changing folders: what each parses, and that its table equals a parse of everything."""

import os
from pathlib import Path

import pytest

from deckhand.sources import ooxml, writer
from deckhand.streaming import incremental


def deck(*titles, notes=None, sections=None):
    blank = {"layout_name": "L", "subtitle": None, "body": [], "cells": None, "pictures": 0, "charts": 0, "connectors": 0, "comment": None}
    return writer.package([{**blank, "slide_number": k, "title": t, "notes": (notes or {}).get(k), "section": (sections or {}).get(k)} for k, t in enumerate(titles, 1)])


def put(folder: Path, name: str, data: bytes, at: int):
    (folder / name).write_bytes(data)
    os.utime(folder / name, (at, at))


def rows(df):
    names = [c for c in ooxml.T.StructType.fromDDL(ooxml.SCHEMA).names]
    return sorted(str(r.asDict(True)) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder, table = tmp_path_factory.mktemp("decks"), str(tmp_path_factory.mktemp("table") / "bronze")
    put(folder, "a.pptx", deck("one", "two", "three", notes={2: "say"}), 1_000)
    put(folder, "b.pptx", deck("x"), 1_000)
    put(folder, "bad.pptx", b"no archive", 1_000)
    uri = f"file://{folder}"
    done = [incremental.refresh(spark, uri, table)]

    def refreshed():
        done.append(incremental.refresh(spark, uri, table))
        assert rows(incremental.state(spark, table)) == rows(ooxml.packages(spark, uri))
        return done[-1]

    return folder, table, refreshed, done


def test_runs(spark, made):
    folder, table, refreshed, done = made
    counts = lambda *x: dict(zip(("run", "files", "gone", "parsed", "kept"), x))
    assert done == [counts(1, 3, 0, 4, 0)]
    assert refreshed() == counts(0, 0, 0, 0, 0) and incremental.runs(spark, table) == [1]
    put(folder, "a.pptx", deck("one", "TWO", "three", notes={2: "say"}), 2_000)
    assert refreshed() == counts(2, 1, 0, 1, 2)
    put(folder, "a.pptx", deck("one", "TWO", "three", notes={2: "say more"}, sections={1: "S", 3: "T"}), 3_000)
    assert refreshed() == counts(3, 1, 0, 1, 2)  # notes belong to their slide; sections are places, which are taken anew
    (folder / "b.pptx").unlink()
    put(folder, "c.pptx", deck("new", "deck"), 4_000)
    put(folder, "bad.pptx", deck("good"), 4_000)
    assert refreshed() == counts(4, 2, 1, 3, 0)
    os.utime(folder / "c.pptx", (5_000, 5_000))
    assert refreshed() == counts(5, 1, 0, 0, 2)  # touched, not changed
    put(folder, "b.pptx", deck("x"), 6_000)
    assert refreshed() == counts(6, 1, 0, 1, 0)  # it was gone, and comes back
    assert refreshed()["run"] == 0
    seen = incremental.state(spark, table).where("kind = 'slide' AND file LIKE '%a.pptx'").select("slide_number", "parsed_run", "run")
    assert sorted(map(tuple, seen.collect())) == [(1, 1, 3), (2, 3, 3), (3, 1, 3)]


def test_a_run_that_failed_doesnt_count(spark, made):
    folder, table, refreshed, done = made
    last = incremental.runs(spark, table)[-1]
    before = rows(incremental.state(spark, table))
    broken = Path(table) / f"run-{last + 1:06d}"
    broken.mkdir()
    (broken / "part-00000.parquet").write_bytes(b"half")
    assert incremental.runs(spark, table)[-1] == last and rows(incremental.state(spark, table)) == before
    put(folder, "a.pptx", deck("one"), 9_000)
    assert refreshed() == {"run": last + 1, "files": 1, "gone": 0, "parsed": 1, "kept": 0}


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    found = incremental.refresh(spark, (tmp_path / "none").as_uri(), str(tmp_path / "table"))
    assert found["run"] == 0 and incremental.state(spark, str(tmp_path / "table")).count() == 0


def test_tasks_that_parse_grow_with_the_files(spark, tmp_path):
    for k in range(64):
        (tmp_path / f"{k}.pptx").write_bytes(b"x")
    found = incremental.listed(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task a file
    try:
        assert incremental.tasks(incremental.listed(spark, str(tmp_path))) == 16
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert incremental.tasks(found.limit(1)) == spark.sparkContext.defaultParallelism
