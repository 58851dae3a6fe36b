import math

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from deckhand.functions import ordinals
from deckhand.functions.predicates import condition
from deckhand.operators import workflow
from deckhand.plans import catalog, pipeline
from deckhand.plans.spec import Spec

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        (None, list(range(1, 101))), (3, [3]), ("3", [3]), ([1, 5, 10], [1, 5, 10]), ([1, 5, 1, 10, 5], [1, 5, 10]), ("1,5,10", [1, 5, 10]), ("[1,5,10]", [1, 5, 10]),
        (":10", list(range(1, 11))), ("[:10]", list(range(1, 11))), ("5:20", list(range(5, 21))), ("25:", list(range(25, 101))), ("95:110", list(range(95, 101))),
    ],
)
def test_d11_ordinals(spec, expected):
    assert ordinals.parse(spec, 100) == expected


@pytest.mark.parametrize("spec", [101, [1, 101], "101:110", "1:2:3", "20:10", {}, "", 0, -1, [0], True])
def test_bad_ordinals(spec):
    with pytest.raises(ValueError):
        ordinals.parse(spec, 100)


RECORDS = [
    Row(seq=0, k="a|b", v="10", n={"x": [1, 2]}), Row(seq=1, k="a|b", v=None, n={"x": [3, 4]}), Row(seq=2, k="", v=" 1e1 ", n=None), Row(seq=3, k=None, v="1_000", n=None),
    Row(seq=4, k="c", v="nan", n=None), Row(seq=5, k="c", v="1d", n=None), Row(seq=6, k="D", v="Text", n=None), Row(seq=7, k="D", v="text", n=None), Row(seq=8, k="D", v="", n=None),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "seq long, k string, v string, n map<string,array<int>>").cache()


def kept(records, **rule):
    return [r.seq for r in pipeline.run(records, {"filters": [rule]}, "seq").orderBy("seq").collect()]


def test_conditions(records):
    assert kept(records, field="v", condition="equals", value="TEXT") == [6, 7]
    assert kept(records, field="v", condition="equals", value="text", case_sensitive=True) == [7]
    assert kept(records, field="v", condition="greater_than", value="9") == [0, 2]
    assert kept(records, field="v", condition="less_equal", value=0) == [1]  # null counts as 0; what isn't a number never passes
    assert kept(records, field="v", condition="is_empty") == [1, 8]
    assert kept(records, field="v", condition="not_contains", value="e") == [0, 1, 3, 4, 5, 8]
    assert kept(records, field="v", condition="regex", value="(") == []
    assert kept(records, field="v", condition="not_in_list", value="x") == list(range(9))
    assert kept(records, field="n.x.1", condition="equals", value=4) == [1]
    assert kept(records, field="no.such", condition="is_empty") == list(range(9))


def test_regex_folds_all_letters(spark):
    df = spark.createDataFrame([("École",)], "t string")
    assert df.where(condition(F.col("t"), "string", "regex", "éc")).count() == 1


def test_formatting_conditions(spark):
    df = spark.createDataFrame([(1, (True, None)), (2, (False, "#FF0000")), (3, None)], "i int, f struct<bold:boolean,color:string>")
    has = lambda name, criteria=None: [r.i for r in df.where(condition(F.col("f"), dict(df.dtypes)["f"], name, criteria=criteria)).collect()]
    assert has("has_formatting") == [1, 2] and has("has_formatting", {"bold": True}) == [1]
    assert has("has_formatting", {"color": "#FF0000"}) == [2]


def grouped(records, *operations):
    spec = {"grouping": {"fields": ["k"], "aggregations": [{"field": "v", "operation": o, "output_field": o} for o in operations]}}
    return {r.k: r for r in pipeline.run(records, spec, "seq").collect()}


def test_d16_aggregations(records):
    got = grouped(records, "count", "sum", "average", "list", "unique", "concat", "first", "last", "min", "most_common", "least_common")
    assert set(got) == {"a|b", None, "c", "D"}
    assert (got["a|b"]["count"], got["a|b"]["sum"], got["a|b"].average) == (1, 10.0, 10.0)
    assert (got[None]["count"], got[None]["sum"]) == (2, 10.0)  # "" and null are one key; 1_000 isn't a number
    assert (got["c"]["sum"], got["c"]["min"]) == (0.0, None)
    assert got["D"].concat == "Text, text" and got["D"].list == ["Text", "text", ""]
    assert (got["D"]["first"], got["D"]["last"], got["D"].most_common, got["D"].least_common) == ("Text", "", "Text", "")


def test_all_null_group_is_null(spark):
    df = spark.createDataFrame([(0, "a", None)], "seq long, k string, v string")
    assert tuple(grouped(df, "count", "sum", "list")["a"])[1:4] == (None, None, None)


def test_d2_descending_and_pages(records):
    spec = {"sorting": [{"field": "v", "order": "desc"}], "offset": 1, "limit": 3}
    assert [r.seq for r in pipeline.run(records, spec, "seq").collect()] == [2, 6, 7]
    up = [r.seq for r in pipeline.run(records, {"sorting": [{"field": "v"}]}, "seq").collect()]
    assert up == [0, 2, 1, 8, 3, 5, 4, 6, 7]


def test_d17_bad_specifications(records):
    for bad in ({"filters": [{"field": "v", "condition": "like"}]}, {"sorting": [{"field": "v", "order": "up"}]}, {"filter_logic": "XOR"}, {"limit": -1}, {"select": []},
                {"grouping": {"fields": ["k"], "aggregations": [{"field": "v", "operation": "median", "output_field": "m"}]}}):
        with pytest.raises(ValueError):
            Spec.of(bad)


def test_summary_and_empty(records):
    row = pipeline.summary(records, {"filters": [{"field": "k", "condition": "equals", "value": "d"}], "limit": 2}, "seq").first()
    assert (row.original_count, row.filtered_count, row.final_count) == (9, 3, 2)
    assert pipeline.run(records.limit(0), {"grouping": {"fields": ["k"]}}, "seq").count() == 0


def test_plan_pushes_filters_down(spark, capsys):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("seq", F.col("l_orderkey"))
    pipeline.run(df.where("l_quantity > 49"), {"grouping": {"fields": ["l_returnflag"], "aggregations": [{"field": "l_tax", "operation": "max", "output_field": "m"}]}}, "seq").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_comment" not in plan and "l_shipdate" not in plan


def test_workflows(spark):
    log = [("s", 1, "query_slides", {"has_tables": "1"}), ("s", 2, "extract_table_data", {"slide_numbers": "1", "table_criteria": "x"}), ("t", 1, "x", {})]
    df = spark.createDataFrame(log, "session string, seq int, tool string, parameters map<string,string>")
    found = workflow.detected(workflow.sequences(df, "session", "seq", "tool", "parameters"))
    got = {r.session: r.workflow for r in found.collect()}
    assert got == {"s": "table_extraction", "t": None}
    assert [r.suggestion for r in workflow.suggestions(found).collect()] == ["get_presentation_overview"]
    steps = spark.createDataFrame([(["a", "b", "a", "c"],), ([],)], "steps array<string>")
    assert [r[0] for r in steps.select(workflow.contains_sequence(F.col("steps"), ["a", "c"])).collect()] == [True, False]
    assert [r[0] for r in steps.select(workflow.partial_sequence(F.col("steps"), ["b", "c", "d"])).collect()] == [2 / 3, 0.0]


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
