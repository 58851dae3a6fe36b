"""Advice at each step: the same from a table, from a stream, and from scoring each beginning of a session anew."""

import random

from pyspark.sql import functions as F

from deckhand.operators import workflow
from deckhand.streaming import advice

TOOLS = ["query_slides", "extract_table_data", "filter_and_aggregate", "get_presentation_overview", "analyze_text_formatting", "other", None]
GIVEN = ["has_tables", "filters", "grouping", "title", "x"]
SCHEMA = "who string, at long, tool string, p map<string,string>, ok boolean, error string"


def log():
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), k, r.choice(TOOLS), {g: "1" for g in r.sample(GIVEN, r.randint(0, 2))} if r.random() < 0.9 else None, r.random() < 0.7, r.choice([None, "EMPTY result", "File not found", "invalid format, no access, no results", "x"])) for k in range(160)]
    return rows + [("same", k, "get_powerpoint_attributes", None, True, None) for k in range(200, 205)] + [("mine", 300 + k, t, {"has_tables": "1", "filters": "1", "grouping": "1"}, None, None) for k, t in enumerate(["query_slides", "extract_table_data", "filter_and_aggregate"])]


def results(df):
    return sorted(((r.session, r.seq, r.tool, r.context, r.workflow, round(r.confidence, 9), r.steps_so_far, r.recovery) for r in df.collect()), key=str)


def advised(spark, df):
    return advice.batch(df, "who", "at", "tool", "p", "ok", "error")


def test_each_beginning_of_a_session(spark):
    rows = log()
    got = results(advised(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)))
    begun = []
    for who in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == who) if who else [r for r in rows if r[0] is None]
        for n in range(1, len(own) + 1):
            begun.append((who, own[n - 1][1], [r[2] for r in own[:n]], list({g for r in own[:n] for g in r[3] or ()})))
    df = spark.createDataFrame(begun, "who string, at long, steps array<string>, parameters array<string>")
    expected = {(r.who, r.at): (r.workflow, round(r.confidence, 9)) for r in workflow.detected(df).collect()}
    assert {(s, at): (w, c) for s, at, _, _, w, c, _, _ in got} == expected and len(got) == len(rows)
    assert [x[3] for x in got if x[0] == "same"] == ["targeted_extraction"] * 2 + ["optimization"] * 3
    assert [(x[4], x[5]) for x in got if x[0] == "mine"][-1] == ("data_mining", 1.0)
    by = {x[1]: x[7] for x in got}
    for who, at, _, _, ok, error in rows:
        says = (error or "").lower()
        fits = [n for n, any_of in advice.RECOVERIES.items() if any(w in says for w in any_of)]
        assert by[at] == ([] if ok else fits[:3])
    assert advised(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    plain = advice.batch(spark.createDataFrame([("s", 1, "query_slides")], "s string, at long, t string"), "s", "at", "t").first()
    assert (plain.success, plain.recovery, plain.context) == (True, [], "targeted_extraction")


def test_a_stream_advises_as_a_table_does(spark, tmp_path):
    rows, provider = log(), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lo in range(0, len(rows), 45):
            spark.createDataFrame(rows[lo : lo + 45], SCHEMA).repartition(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        steps = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        found = advice.stream(steps, "who", "at", "tool", "p", "ok", "error")
        query = found.writeStream.format("memory").queryName("advised").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None and len(query.recentProgress) >= 4
        assert results(spark.table("advised")) == results(advised(spark, spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def test_what_steps_teach(spark):
    steps = advised(spark, spark.createDataFrame(log(), SCHEMA))
    got = {(r.kind, r["rank"]): (r.name, r.n) for r in advice.learnt(steps).collect()}
    rows = [r.asDict() for r in steps.withColumn("tool", F.coalesce("tool", F.lit("unknown"))).collect()]
    for kind, own in (("tools", [r["tool"] for r in rows if r["success"]]), ("errors", [r["tool"] for r in rows if not r["success"]]), ("patterns", [f"{r['workflow'] or 'unknown'}_{r['context']}" for r in rows if r["success"]])):
        ranked = sorted({(-own.count(x), x) for x in own})[:5]
        assert [got[kind, k] for k in range(1, len(ranked) + 1)] == [(x, -n) for n, x in ranked] and (kind, len(ranked) + 1) not in got
