"""Step logs: what callers did in which order, and which known workflow it resembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Workflows in order of declaration, with their tools, parameters and sequences of steps.
WORKFLOWS = {
    "table_extraction": (
        ["query_slides", "extract_table_data"],
        ["has_tables", "slide_numbers", "table_criteria"],
        [["query_slides", "extract_table_data"], ["get_presentation_overview", "query_slides", "extract_table_data"]],
    ),
    "formatting_analysis": (
        ["analyze_text_formatting"],
        ["formatting_filter", "content_types", "formatting_types"],
        [["analyze_text_formatting"], ["query_slides", "analyze_text_formatting"]],
    ),
    "content_search": (["query_slides"], ["search_criteria", "title", "content"], [["query_slides"], ["get_presentation_overview", "query_slides"]]),
    "presentation_overview": (["get_presentation_overview"], ["analysis_depth"], [["get_presentation_overview"]]),
    "data_mining": (
        ["query_slides", "extract_table_data", "filter_and_aggregate"],
        ["has_tables", "filters", "grouping"],
        [["query_slides", "extract_table_data", "filter_and_aggregate"], ["get_presentation_overview", "query_slides", "extract_table_data", "analyze_text_formatting"]],
    ),
}
LEAST_SCORE = 0.5


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def contains_sequence(steps: Column, pattern: list[str]) -> Column:
    """Whether the steps hold the pattern without a gap."""
    n, m = F.size(steps), len(pattern)
    return F.when(n >= m, F.exists(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: F.slice(steps, i, F.lit(m)) == words(pattern))).otherwise(False)


def partial_sequence(steps: Column, pattern: list[str]) -> Column:
    """The greatest share of the pattern that follows in order, with gaps, from any start.

    Taking each step as soon as it fits from the first on never finds less than from a later start, so one pass does.
    """
    p = words(pattern)
    matched = F.aggregate(steps, F.lit(0), lambda k, x: F.when(x == F.get(p, k), k + 1).otherwise(k))
    return F.coalesce(matched / len(pattern), F.lit(0.0))


def context(df: DataFrame, session: str, seq: str, tool: str, last: int = 3) -> DataFrame:
    """Each step with its own tool and those just before it."""
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(1 - last, 0)
    return df.withColumn("recent", F.collect_list(tool).over(w))


def sequences(df: DataFrame, session: str, seq: str, tool: str, parameters: str | None = None) -> DataFrame:
    """One row a session: its tools in order, and the names of all its parameters."""
    names = F.array_distinct(F.flatten(F.collect_list(F.map_keys(parameters)))) if parameters else F.array().cast("array<string>")
    steps = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(tool).alias("t")))), lambda x: x["t"])
    return df.groupBy(session).agg(steps.alias("steps"), names.alias("parameters"))


def scores(df: DataFrame, steps: str = "steps", parameters: str = "parameters") -> DataFrame:
    """score_<workflow>: 0.4 of the tools used, 0.3 of the parameters, 0.3 of the best sequence."""
    columns = {}
    for name, (tools, given, patterns) in WORKFLOWS.items():
        share = lambda c, of: F.size(F.array_intersect(F.col(c), words(of))) / len(of)
        best = F.greatest(F.lit(0.0), *(F.when(contains_sequence(F.col(steps), p), 1.0).otherwise(partial_sequence(F.col(steps), p)) for p in patterns))
        columns[f"score_{name}"] = 0.4 * share(steps, tools) + 0.3 * share(parameters, given) + 0.3 * best
    return df.withColumns(columns)


def detected(df: DataFrame, **names: str) -> DataFrame:
    """workflow: the one with the best score, if that exceeds a half; the one declared first among equals."""
    scored = scores(df, **names)
    best = F.array_max(F.array(*(F.struct(F.col(f"score_{w}").alias("score"), F.lit(-k).alias("ord"), F.lit(w).alias("name")) for k, w in enumerate(WORKFLOWS))))
    return scored.withColumn("workflow", F.when(best["score"] > LEAST_SCORE, best["name"])).withColumn("confidence", best["score"])


def summary(df: DataFrame, session: str, tool: str, success: str, seconds: str) -> DataFrame:
    """One row a session: steps, successes, distinct tools and time."""
    return df.groupBy(session).agg(
        F.count("*").alias("steps"), F.count_if(success).alias("successes"), F.countDistinct(tool).alias("tools"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"),
        (F.count_if(success) / F.count("*")).alias("success_rate"),
    )


def top(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The values that occur most often; equal ones by name."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def suggestions(sessions: DataFrame, workflow: str = "workflow", steps: str = "steps", k: int = 3) -> DataFrame:
    """The steps of a session's workflow that it hasn't taken, best first."""
    spark = sessions.sparkSession
    rules = [(w, t, n) for w, (_, _, patterns) in WORKFLOWS.items() for n, t in enumerate(max(patterns, key=len))]
    table = F.broadcast(spark.createDataFrame(rules, "workflow string, suggestion string, ord int"))  # a dozen rows
    open_ = sessions.join(table, sessions[workflow] == table.workflow).where(~F.array_contains(steps, F.col("suggestion"))).drop(table.workflow)
    w = Window.partitionBy(*[c for c in sessions.columns if c not in (steps, "parameters") and not c.startswith("score_")]).orderBy("ord")
    return open_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("ord")
