"""Part graphs, range joins and frequent values against plain versions, and the plans they make."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deckhand.operators import ranges
from deckhand.plans import pipeline
from deckhand.sources import graph, ooxml

RELS = '<Relationships xmlns="{}">{}</Relationships>'


def parts_of(edges, also=()):
    """Parts of relations for a made graph: edges of file, source, target."""
    stated = {}
    for f, a, b in edges:
        folder, _, name = a.rpartition("/")
        stated.setdefault((f, f"{folder + '/' if folder else ''}_rels/{name}.rels"), []).append(b)
    rows = [(f, name, RELS.format(ooxml.NS["rel"], "".join(f'<Relationship Id="r{k}" Type="t" Target="/{b}"/>' for k, b in enumerate(own))).encode()) for (f, name), own in stated.items()]
    return rows + [(f, name, b"") for f, name in also]


def test_reachable_against_a_plain_walk(spark):
    r = random.Random(1)
    edges = [(f"f{f}", r.choice(["", "a/x0.xml", *(f"a/x{k}.xml" for k in range(12))]), f"a/x{r.randrange(14)}.xml") for f in range(8) for _ in range(r.randint(0, 16))] + [("cycle", "", "p"), ("cycle", "p", "q"), ("cycle", "q", "p"), (None, "", "n"), ("deep", "", "d0")]
    edges += [("deep", f"d{k}", f"d{k + 1}") for k in range(9)]
    parts = spark.createDataFrame(parts_of(edges, [("f1", "a/alone.xml"), (None, "m"), (None, "n"), ("cycle", "q")]), "file string, name string, content binary")
    found = graph.edges(parts)
    assert {(r.file, r.source, r.target) for r in found.collect()} == set(edges)
    expected = {}
    for f in {e[0] for e in edges}:
        expected[f, ""], ahead, d = 0, {""}, 0
        while ahead:
            d += 1
            ahead = {b for g, a, b in edges if g == f and a in ahead and (f, b) not in expected}
            expected.update({(f, b): d for b in ahead})
    reached = graph.reachable(found).collect()
    assert {(r.file, r.name): r.distance for r in reached} == expected and len(reached) == len(expected)
    assert sorted(map(tuple, graph.orphans(parts, found).collect()), key=str) == sorted([("f1", "a/alone.xml"), (None, "m")], key=str)
    held = {("cycle", "q"), ("f1", "a/alone.xml"), (None, "m"), (None, "n")} | {(f, n) for f, n, _ in parts_of(edges)}
    assert {(r.file, r.source, r.target) for r in graph.dangling(parts, found).collect()} == {e for e in edges if (e[0], e[2]) not in held}
    with pytest.raises(ValueError, match="more than 3"):
        graph.reachable(found, 3)
    assert graph.reachable(found.limit(0)).count() == graph.orphans(parts.limit(0), found).count() == 0


def test_targets_are_resolved_against_their_part():
    to = ooxml.target_part
    assert to("slides/slide1.xml") == "ppt/slides/slide1.xml" and to("/ppt/slides/slide1.xml") == "ppt/slides/slide1.xml" and to(None) == to("") == ""
    assert to("../customXml/item1.xml") == "customXml/item1.xml" and to("../../x", "a/b/c/d.xml") == "a/x" and to("../../../../x", "a/b") == "x"
    assert to("../media/a%20b.png#x", "ppt/slides/slide1.xml") == "ppt/media/a b.png" and to("#top", "ppt/a.xml") == "ppt/a.xml"
    source = graph.source_of
    assert source("_rels/.rels") == "" and source("ppt/_rels/a.xml.rels") == "ppt/a.xml" and source("ppt/a.rels") is source("_rels/a.xml") is None


def test_range_join_against_all_pairs(spark):
    r = random.Random(2)
    points = [(r.choice(["a", "b", None]), r.choice([None, r.randint(-300, 5000)]), k) for k in range(400)] + [("a", 7, 1000), ("a", 7, 1000)]
    held = [(r.choice(["a", "b", None]), s, s + r.choice([-1, 0, 1, 15, 16, 17, 255, 4000, 10**12]), f"r{k}") for k in range(120) for s in [r.randint(-400, 4000)]] + [("a", None, 5, "null"), ("b", 5, None, "null"), ("a", 0, 10, "twice"), ("a", 0, 10, "twice")]
    p, g = spark.createDataFrame(points, "k string, at long, id long"), spark.createDataFrame(held, "k string, lo long, hi long, name string")
    expected = Counter((k, at, i, lo, hi, n) for k, at, i in points for q, lo, hi, n in held if k is not None and k == q and None not in (at, lo, hi) and lo <= at <= hi)
    got = ranges.range_join(p, g, ["k"], "at", "lo", "hi")
    assert Counter(map(tuple, got.select("k", "at", "id", "lo", "hi", "name").collect())) == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    left = Counter(map(tuple, ranges.range_join(p, g, ["k"], "at", "lo", "hi", "left").select("k", "at", "id", "lo", "hi", "name").collect()))
    matched = {x[:3] for x in expected}
    assert left == expected + Counter((*x, None, None, None) for x in points if x not in matched)
    everywhere = ranges.range_join(p.drop("k"), g.drop("k"), [], "at", "lo", "hi")
    assert everywhere.count() == sum(lo <= at <= hi for _, at, _ in points for _, lo, hi, _ in held if None not in (at, lo, hi))
    assert ranges.range_join(p, g.limit(0), ["k"], "at", "lo", "hi").count() == 0 and ranges.range_join(p, g.limit(0), ["k"], "at", "lo", "hi", "left").count() == len(points)
    with pytest.raises(ValueError, match="both sides"):
        ranges.range_join(p, g.withColumnRenamed("name", "id"), ["k"], "at", "lo", "hi")


def test_frequent_values_of_many_columns_in_one_scan(spark):
    r = random.Random(3)
    rows = [(k, r.choice(["x", "y", None, ""]), r.choice([1, 2, 2, None]), r.choice(["u", "v", "w", None]), r.choice([1.5, 2.5, None])) for k in range(300)] + [(300, "none", None, None, None)]
    df = spark.createDataFrame(rows, "seq long, g string, a int, b string, c double")
    wanted = [("a", "most_common"), ("a", "least_common"), ("b", "most_common"), ("c", "least_common"), ("a", "sum"), ("b", "list"), ("c", "first"), ("b", "count")]
    spec = {"grouping": {"fields": ["g"], "aggregations": [{"field": f, "operation": o, "output_field": f"{f}_{o}"} for f, o in wanted]}}
    found = pipeline.run(df, spec, "seq")
    assert found.schema["a_most_common"].dataType.simpleString() == "int" and found.schema["c_least_common"].dataType.simpleString() == "double"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    for row in found.collect():
        own = [x for x in rows if (x[1] or None) == row.g]
        values = lambda i: [x[i] for x in own if x[i] is not None]  # noqa: B023,E731
        first = lambda i, v: min(x[0] for x in own if x[i] == v)  # noqa: B023,E731
        most = lambda i: min(Counter(values(i)).items(), key=lambda e: (-e[1], first(i, e[0])), default=(None,))[0]
        least = lambda i: min(Counter(values(i)).items(), key=lambda e: (e[1], -first(i, e[0])), default=(None,))[0]
        some = bool(values(2))
        assert (row.a_most_common, row.a_least_common, row.b_most_common, row.c_least_common) == (most(2), least(2), most(3), least(4))
        assert (row.a_sum, row.b_list, row.c_first) == (sum(values(2)) if some else None, values(3) or None, values(4)[0] if values(4) else None)
        assert row.seq == own[0][0] and row.b_count == (len(values(3)) or None)
    alone = pipeline.run(df, {"grouping": {"fields": ["g"], "aggregations": [{"field": "b", "operation": "most_common", "output_field": "b"}]}}, "seq")
    assert {x.g: x.b for x in alone.collect()} == {x.g: x.b_most_common for x in found.collect()}
