"""Registered queries over the supplied tables, each with its SQL twin where SQL can express it.

None of these tables holds presentations. Queries over packages write conversations as packages and read them
back (see ``package_queries``); the others show operators on analogues: conversations stand for files of slides
(turns are ordinals), documents for text elements, pages for tagged text, events for step logs, and the
business tables for records and extracted tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckhand.functions import ordinals
from deckhand.operators import analysis, formatting, slides, tables, workflow
from deckhand.plans import package_queries, pipeline, surface_queries, varied_queries
from deckhand.streaming import advice

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, if given, the SQL that must return the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def specified(name: str, source: str, spec: dict, columns: list[str], sql: str, seq: str) -> None:
    """A query that is nothing but a specification."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        rows = rows.withColumn("seq", F.expr(seq))
        return pipeline.run(rows, spec, "seq").select(*columns)

    query(name, sql)(f)


# Filters, one condition each.
def predicate(name: str, source: str, rule: dict, columns: list[str], where: str, seq: str) -> None:
    specified(name, source, {"filters": [rule]}, columns, f"SELECT {', '.join(columns)} FROM {source} WHERE {where}", seq)


PART = ["p_partkey", "p_name", "p_type", "p_size"]
predicate("pred_equals_ci", "part", {"field": "p_type", "condition": "equals", "value": "economy"}, PART, "lower(p_type) = 'economy'", "p_partkey")
predicate("pred_equals_case", "part", {"field": "p_type", "condition": "equals", "value": "ECONOMY", "case_sensitive": True}, PART, "p_type = 'ECONOMY'", "p_partkey")
predicate("pred_not_equals", "part", {"field": "p_type", "condition": "not_equals", "value": "economy"}, PART, "lower(coalesce(p_type, '')) <> 'economy'", "p_partkey")
predicate("pred_contains", "part", {"field": "p_name", "condition": "contains", "value": "RING"}, PART, "contains(lower(p_name), 'ring')", "p_partkey")
predicate("pred_not_contains", "part", {"field": "p_name", "condition": "not_contains", "value": "ring"}, PART, "NOT contains(lower(coalesce(p_name, '')), 'ring')", "p_partkey")
predicate("pred_starts", "part", {"field": "p_name", "condition": "starts_with", "value": "Small"}, PART, "starts_with(lower(p_name), 'small')", "p_partkey")
predicate("pred_ends", "part", {"field": "p_name", "condition": "ends_with", "value": "widget"}, PART, "ends_with(lower(p_name), 'widget')", "p_partkey")
predicate("pred_regex", "customer", {"field": "c_name", "condition": "regex", "value": "customer#0+[1-3]5?$"}, ["c_custkey", "c_name"], "regexp_matches(c_name, 'customer#0+[1-3]5?$', 'i')", "c_custkey")
predicate("pred_in_list", "orders", {"field": "o_orderpriority", "condition": "in_list", "value": ["1-urgent", "5-LOW"]}, ["o_orderkey", "o_orderpriority"], "lower(o_orderpriority) IN ('1-urgent', '5-low')", "o_orderkey")
predicate("pred_not_in_list", "orders", {"field": "o_orderpriority", "condition": "not_in_list", "value": ["1-urgent", "5-LOW"]}, ["o_orderkey", "o_orderpriority"], "lower(o_orderpriority) NOT IN ('1-urgent', '5-low')", "o_orderkey")
predicate("pred_greater", "lineitem", {"field": "l_quantity", "condition": "greater_than", "value": "45"}, ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity > 45", "l_orderkey * 10 + l_linenumber")
predicate("pred_less_equal", "lineitem", {"field": "l_discount", "condition": "less_equal", "value": 0.01}, ["l_orderkey", "l_linenumber", "l_discount"], "l_discount <= 0.01", "l_orderkey * 10 + l_linenumber")
specified(
    "filter_or_logic", "orders",
    {"filter_logic": "OR", "filters": [{"field": "o_orderstatus", "condition": "equals", "value": "p"}, {"field": "o_totalprice", "condition": "greater_than", "value": 400000}]},
    ["o_orderkey", "o_orderstatus", "o_totalprice"], "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE lower(o_orderstatus) = 'p' OR o_totalprice > 400000", "o_orderkey",
)


# Groups and aggregations.
def over(field: str, *operations: str) -> list[dict]:
    return [{"field": field, "operation": o, "output_field": f"{o}_{field}"} for o in operations]


specified(
    "filter_and_agg_core", "lineitem",
    {"filters": [{"field": "l_quantity", "condition": "greater_equal", "value": 10}], "sorting": [{"field": "l_returnflag"}, {"field": "l_linestatus"}],
     "grouping": {"fields": ["l_returnflag", "l_linestatus"], "aggregations": over("l_quantity", "sum", "average", "count", "min", "max")}},
    ["l_returnflag", "l_linestatus", "sum_l_quantity", "average_l_quantity", "count_l_quantity", "min_l_quantity", "max_l_quantity"],
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_l_quantity, avg(l_quantity) AS average_l_quantity, count(l_quantity) AS count_l_quantity,
              min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem WHERE l_quantity >= 10 GROUP BY ALL""", "l_orderkey * 10 + l_linenumber",
)
specified(
    "agg_list_concat", "nation", {"grouping": {"fields": ["n_regionkey"], "aggregations": over("n_name", "list", "concat", "unique", "first", "last")}},
    ["n_regionkey", "list_n_name", "concat_n_name", "unique_n_name", "first_n_name", "last_n_name"],
    """SELECT n_regionkey::VARCHAR AS n_regionkey, list(n_name ORDER BY n_nationkey) AS list_n_name, string_agg(n_name, ', ' ORDER BY n_nationkey) AS concat_n_name,
              list_sort(list(DISTINCT n_name)) AS unique_n_name, arg_min(n_name, n_nationkey) AS first_n_name, arg_max(n_name, n_nationkey) AS last_n_name FROM nation GROUP BY n_regionkey""", "n_nationkey",
)
FREQUENT = """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
              SELECT user_id::VARCHAR AS user_id, event_type AS {0}_event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n {1}, f {2}) = 1"""
for _name, _n, _f in (("most_common", "DESC", "ASC"), ("least_common", "ASC", "DESC")):
    specified(f"agg_{_name}", "events", {"grouping": {"fields": ["user_id"], "aggregations": over("event_type", _name)}}, ["user_id", f"{_name}_event_type"], FREQUENT.format(_name, _n, _f), "event_id")
specified(
    "sort_multi_offset_limit", "orders",
    {"sorting": [{"field": "o_orderpriority", "order": "desc"}, {"field": "o_totalprice"}], "offset": 20, "limit": 50}, ["o_orderkey", "o_orderpriority", "o_totalprice"],
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY lower(o_orderpriority) DESC, o_totalprice, o_orderkey LIMIT 50 OFFSET 20", "o_orderkey",
)


@query("agg_all_null_group", "SELECT lang, nullif(count(toxic), 0) AS count_toxic, CASE WHEN count(toxic) > 0 THEN sum(toxic)::DOUBLE END AS sum_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def agg_all_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return pipeline.run(rows, {"grouping": {"fields": ["lang"], "aggregations": over("toxic", "count", "sum")}}, "doc_id").drop("doc_id")


@query("result_summary", "SELECT (SELECT count(*) FROM orders) AS original_count, count(*) AS filtered_count, least(count(*), 10) AS final_count, false AS grouped, false AS sorted, true AS paged FROM orders WHERE o_totalprice > 300000")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"filters": [{"field": "o_totalprice", "condition": "greater_than", "value": 300000}], "limit": 10}
    return pipeline.summary(table(spark, sf_dir, "orders"), spec, "o_orderkey")


@query("nested_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("p"))
    found = pipeline.run(rows, {"filters": [{"field": "p.k", "condition": "greater_than", "value": 90}]}, "event_id")
    return found.select("event_id", pipeline.resolved(found, "p.k")[0].cast("long").alias("k"))


# Ordinals, titles, content and sections.
@query("ordinal_slice", "SELECT conv_id, turn, role FROM conversations WHERE turn + 1 BETWEEN 2 AND 4")
def ordinal_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(ordinals.predicate(F.col("turn") + 1, "[2:4]")).select("conv_id", "turn", "role")


@query("ordinal_list", "SELECT conv_id, turn, role FROM conversations WHERE turn + 1 IN (1, 3, 8)")
def ordinal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(ordinals.predicate(F.col("turn") + 1, "3,1,8,1")).select("conv_id", "turn", "role")


@query("title_filters", "SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents WHERE starts_with(lower(split_part(text, chr(10), 1)), 'th') AND regexp_matches(split_part(text, chr(10), 1), ' (and|the) ', 'i')")
def title_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return rows.where(slides.title_condition(F.col("title"), {"starts_with": "Th", "regex": " (and|the) "}))


@query("title_one_of", "SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents WHERE regexp_matches(split_part(text, chr(10), 1), '^on ', 'i') OR contains(lower(split_part(text, chr(10), 1)), '(and')")
def title_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return rows.where(slides.title_condition(F.col("title"), {"one_of": ["^on ", "(and"]}))


@query(
    "object_counts",
    """SELECT page_id, len(regexp_extract_all(html, '<p>')) AS text_boxes, len(regexp_extract_all(html, '<li>')) AS shapes, len(regexp_extract_all(html, '<a ')) AS connectors
       FROM pages WHERE len(regexp_extract_all(html, '<p>')) + len(regexp_extract_all(html, '<li>')) + len(regexp_extract_all(html, '<a ')) BETWEEN 20 AND 40""",
)
def object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    zero = F.lit(0).cast("long")
    kinds = {"text_boxes": count("<p>"), "shapes": count("<li>"), "connectors": count("<a ")}
    rows = table(spark, sf_dir, "pages").select("page_id", F.struct(*(kinds.get(k, zero).alias(k) for k in slides.KINDS)).alias("counts"))
    found = rows.where(slides.content_condition({"object_count": {"min": 20, "max": 40}}, F.col("counts"), F.lit(""), F.array(F.lit(""))))
    return found.select("page_id", "counts.text_boxes", "counts.shapes", "counts.connectors")


@query("notes_filter", "SELECT conv_id, turn FROM conversations WHERE trim(coalesce(text, '')) <> '' AND contains(lower(coalesce(text, '')), 'the')")
def notes_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(slides.notes_condition(F.col("text"), {"is_empty": False, "contains": "THE"})).select("conv_id", "turn")


# Windows.
@query("segment_offsets", "SELECT conv_id, turn, length(text) AS size, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = formatting.running_offset(F.length("text"), ["conv_id"], ["turn"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"), start.cast("long").alias("start"))


@query(
    "run_lengths",
    """WITH i AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
       SELECT user_id, event_type, min(event_id) AS first, count(*) AS length FROM i GROUP BY user_id, event_type, g HAVING count(*) >= 3""",
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").where("length >= 3")


@query(
    "type_bigrams",
    """WITH p AS (SELECT user_id, event_type || ' -> ' || lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events)
       SELECT user_id, sequence, count(*) AS occurrences FROM p WHERE sequence IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""",
)
def type_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.bigrams(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


SPANS = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_returnflag NULLS FIRST) - 1 AS col, 1 + (l_partkey % 3) AS span, l_returnflag AS value FROM lineitem"""


@query(
    "merged_cell_compaction",
    f"""WITH s AS ({SPANS}), c AS (SELECT *, coalesce(max(col + span - 1) OVER (PARTITION BY l_orderkey ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS cover FROM s)
        SELECT l_orderkey, col, span, value, row_number() OVER (PARTITION BY l_orderkey ORDER BY col) - 1 AS logical_col FROM c WHERE col > cover""",
)
def merged_cell_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a row of cells; lines with the same number stand side by side, by part and flag (all else that the result depends on)."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")) - 1
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("col"), (1 + F.col("l_partkey") % 3).alias("span"), F.col("l_returnflag").alias("value"))
    return tables.compacted(cells, ["l_orderkey"], "col", "span").withColumn("logical_col", F.col("logical_col").cast("long"))


@query("last_three_steps", "SELECT event_id, user_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM events")
def last_three_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.context(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "recent")


STEPS = "SELECT user_id, list(event_type ORDER BY event_id) AS steps FROM events GROUP BY user_id"


@query("sequence_match", f"WITH s AS ({STEPS}) SELECT user_id, len(list_filter(range(1, len(steps) - 1), lambda i: steps[i:i+2] = ['view', 'click', 'purchase'])) > 0 AS matched FROM s")
def sequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = workflow.sequences(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return steps.select("user_id", workflow.contains_sequence(F.col("steps"), ["view", "click", "purchase"]).alias("matched"))


def partial_sql(steps: str, pattern: list[str]) -> str:
    """The greatest share of the pattern that follows in order, with gaps: each place holds how much of it has been met."""
    met = f"CASE WHEN x <= {len(pattern)} THEN a " + " ".join(f"WHEN a = {k} AND x = {k + 100} THEN {k + 1}" for k in range(len(pattern))) + " ELSE a END"
    coded = f"list_transform({steps}, lambda t: coalesce(list_position([{', '.join(repr(p) for p in pattern)}], t), 99) + 99)"
    return f"(coalesce(list_reduce(list_prepend(0, {coded}), lambda a, x: {met}), 0) / {len(pattern)})::DOUBLE"


@query("partial_sequence", f"WITH s AS ({STEPS}) SELECT user_id, {partial_sql('steps', ['signup', 'view', 'error', 'purchase'])} AS score FROM s")
def partial_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every user."""
    steps = workflow.sequences(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return steps.select("user_id", workflow.partial_sequence(F.col("steps"), ["signup", "view", "error", "purchase"]).alias("score"))


# Step logs: every three events of a user are a session, and kinds of events stand for tools.
TOOLS = {"view": "query_slides", "click": "extract_table_data", "purchase": "filter_and_aggregate", "signup": "get_presentation_overview", "error": "analyze_text_formatting"}
SESSIONS = f"""SELECT session, list(tool ORDER BY event_id) AS steps, list_distinct(list(parameter)) AS parameters FROM (SELECT event_id, user_id || '-' || ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3) AS session,
    CASE event_type {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in TOOLS.items())} END AS tool, CASE WHEN value > 50 THEN 'filters' ELSE 'title' END AS parameter FROM events) GROUP BY session"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    tool = F.coalesce(*(F.when(F.col("event_type") == e, t) for e, t in TOOLS.items()))
    log = events.select("event_id", F.concat_ws("-", "user_id", F.floor(place / 3).cast("string")).alias("session"), tool.alias("tool"), F.create_map(F.when(F.col("value") > 50, "filters").otherwise("title"), F.lit("x")).alias("p"))
    return workflow.sequences(log, "session", "event_id", "tool", "p")


def score_sql(name: str) -> str:
    tools, given, patterns = workflow.WORKFLOWS[name]
    quoted = lambda of: "[" + ", ".join(f"'{x}'" for x in of) + "]"
    share = lambda c, of: f"len(list_intersect(list_distinct({c}), {quoted(of)})) / {len(of)}"
    return f"0.4::DOUBLE * ({share('steps', tools)}) + 0.3::DOUBLE * ({share('parameters', given)}) + 0.3::DOUBLE * greatest({', '.join(partial_sql('steps', p) for p in patterns)})"


SCORES = f"SELECT *, {', '.join(f'round({score_sql(w)}, 6) AS score_{w}' for w in workflow.WORKFLOWS)} FROM ({SESSIONS})"
BEST = f"greatest({', '.join(f'score_{w}' for w in workflow.WORKFLOWS)})"
DETECTED = f"SELECT *, {BEST} AS confidence, CASE WHEN {BEST} > 0.5 THEN CASE {' '.join(f'WHEN score_{w} = {BEST} THEN {chr(39)}{w}{chr(39)}' for w in workflow.WORKFLOWS)} END END AS workflow FROM ({SCORES})"


@query("workflow_scores", f"SELECT session, {', '.join(f'score_{w}' for w in workflow.WORKFLOWS)} FROM ({SCORES})")
def workflow_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workflow.scores(sessions(spark, sf_dir))
    return found.select("session", *(F.round(f"score_{w}", 6).alias(f"score_{w}") for w in workflow.WORKFLOWS))


@query("workflow_detected", f"SELECT session, workflow, confidence FROM ({DETECTED})")
def workflow_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.detected(sessions(spark, sf_dir)).select("session", "workflow", F.round("confidence", 6).alias("confidence"))


LONGEST = {w: max(patterns, key=len) for w, (_, _, patterns) in workflow.WORKFLOWS.items()}


@query("workflow_suggestions", f"""WITH r(workflow, suggestion, ord) AS (VALUES {', '.join(f"('{w}', '{t}', {k})" for w, steps in LONGEST.items() for k, t in enumerate(steps))}), o AS (SELECT session, workflow, suggestion, ord FROM ({DETECTED}) JOIN r USING (workflow) WHERE NOT list_contains(steps, suggestion))
    SELECT session, workflow, suggestion, row_number() OVER (PARTITION BY session ORDER BY ord) AS rank FROM o QUALIFY rank <= 3""")  # fmt: skip
def workflow_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workflow.suggestions(workflow.detected(sessions(spark, sf_dir)))
    return found.select("session", "workflow", "suggestion", F.col("rank").cast("long").alias("rank"))


# Advice for each step: a user's events are a session, values up to 20 are failures.
PREFIXES = f"""SELECT *, list(tool) OVER w AS steps, list_distinct(list(parameter) OVER w) AS parameters, row_number() OVER w AS n FROM (SELECT user_id, event_id, CASE event_type {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in TOOLS.items())} END AS tool,
    CASE WHEN value > 50 THEN 'filters' ELSE 'title' END AS parameter, value > 20 AS success, CASE WHEN value <= 5 THEN 'Invalid value, no results' WHEN value <= 10 THEN 'access denied' ELSE 'failed' END AS error FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
ADVISED = f"""SELECT *, {BEST} AS confidence, CASE WHEN {BEST} > 0.5 THEN CASE {' '.join(f'WHEN score_{w} = {BEST} THEN {chr(39)}{w}{chr(39)}' for w in workflow.WORKFLOWS)} END END AS workflow,
    CASE WHEN list_contains(recent, 'get_presentation_overview') THEN 'exploration' WHEN list_has_any(recent, ['extract_table_data', 'analyze_text_formatting']) THEN 'targeted_extraction' WHEN list_contains(recent, 'filter_and_aggregate') THEN 'analysis'
      WHEN len(recent) = 3 AND len(list_distinct(recent)) = 1 THEN 'optimization' ELSE 'targeted_extraction' END AS context,
    CASE WHEN success THEN '' WHEN error LIKE 'Invalid%' THEN 'broaden_search,correct_parameters,start_from_overview' WHEN error LIKE 'access%' THEN 'check_file,start_from_overview' ELSE 'start_from_overview' END AS recovery
  FROM (SELECT *, steps[-3:] AS recent, {', '.join(f'round({score_sql(w)}, 6) AS score_{w}' for w in workflow.WORKFLOWS)} FROM ({PREFIXES}))"""


def advised(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.coalesce(*(F.when(F.col("event_type") == e, t) for e, t in TOOLS.items()))
    error = F.when(F.col("value") <= 5, "Invalid value, no results").when(F.col("value") <= 10, "access denied").otherwise("failed")
    log = table(spark, sf_dir, "events").select("user_id", "event_id", tool.alias("tool"), F.create_map(F.when(F.col("value") > 50, "filters").otherwise("title"), F.lit("x")).alias("p"), (F.col("value") > 20).alias("ok"), error.alias("error"))
    return advice.batch(log, "user_id", "event_id", "tool", "p", "ok", "error")


@query("workflow_advice", f"SELECT user_id AS session, event_id AS seq, context, workflow, confidence, n AS steps_so_far, recovery FROM ({ADVISED})")
def workflow_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context, workflow and recovery at every step of every session."""
    found = advised(spark, sf_dir)
    return found.select("session", "seq", "context", "workflow", F.round("confidence", 6).alias("confidence"), "steps_so_far", F.array_join("recovery", ",").alias("recovery"))


@query("workflow_learnt", f"""WITH e AS (SELECT 'patterns' AS kind, coalesce(workflow, 'unknown') || '_' || context AS name FROM ({ADVISED}) WHERE success UNION ALL SELECT CASE WHEN success THEN 'tools' ELSE 'errors' END, tool FROM ({ADVISED}))
    SELECT kind, name, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS rank FROM e GROUP BY kind, name QUALIFY rank <= 5""")  # fmt: skip
def workflow_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.learnt(advised(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


# Output shapes.
@query(
    "flat_pivot",
    f"SELECT l_orderkey, {', '.join(f'max(l_quantity) FILTER (l_linenumber = {k}) AS h{k}' for k in range(1, 8))} FROM lineitem GROUP BY l_orderkey",
)
def flat_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order has a row, and every line number a column."""
    rows = table(spark, sf_dir, "lineitem").withColumn("h", F.concat(F.lit("h"), F.col("l_linenumber").cast("string")))
    return rows.groupBy("l_orderkey").pivot("h", [f"h{k}" for k in range(1, 8)]).agg(F.max("l_quantity"))


@query("html_escape", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html FROM documents""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tables.escaped(F.col("text")).alias("html"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", slides.shortened(F.col("text"), 100).alias("short"))


@query("preview_text", "SELECT conv_id, array_to_string(list(CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END ORDER BY turn)[1:3], ' | ') AS preview FROM conversations GROUP BY conv_id")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    boxes = F.transform("t", lambda x: F.struct(F.lit(None).cast("string").alias("ph_type"), x["text"].alias("text")))
    return texts.select("conv_id", slides.preview(boxes, F.lit(None).cast("string")).alias("preview"))


# Analysis, on conversations as files: the role system stands for a title, other turns for text.
def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    counts = F.struct(*(F.when(F.lit(k == "shapes"), F.length("text") % 7).when(F.lit(k == "tables"), (F.length("text") % 5 == 0).cast("int")).otherwise(0).cast("long").alias(k) for k in slides.KINDS))
    return rows.select(
        F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("slide_number"), F.when(F.col("turn") % 2 == 0, F.split("text", "\n")[0]).alias("title"),
        F.lit(None).cast("string").alias("subtitle"), F.lit("").alias("notes"), counts.alias("counts"), F.split("text", "\n").alias("texts"),
    )


DECK = """SELECT conv_id AS file, turn + 1 AS slide_number, CASE WHEN turn % 2 = 0 THEN split_part(text, chr(10), 1) END AS title,
                 length(text) % 7 AS shapes, CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END AS tables, string_split(text, chr(10)) AS texts FROM conversations"""
TYPE = """CASE WHEN coalesce(title, '') <> '' AND shapes <= 2 AND shapes + tables <= 3 THEN 'title_slide' WHEN tables > 0 AND tables >= (shapes + tables) * 0.5 THEN 'table_slide'
               WHEN len(texts) >= 3 OR length(t) - length(replace(replace(replace(t, '•', ''), '-', ''), '*', '')) >= 3 THEN 'bullet_slide'
               WHEN shapes + tables = 0 THEN 'blank_slide' ELSE 'content_slide' END"""
TYPED = f"(SELECT *, {TYPE} AS slide_type FROM (SELECT *, array_to_string(texts, ' ') AS t FROM ({DECK})))"


@query("classify", f"SELECT file, slide_number, slide_type FROM {TYPED}")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.classified(decks(spark, sf_dir)).select("file", "slide_number", "slide_type")


@query(
    "slide_scores",
    f"""SELECT file, slide_number, (least((shapes + tables) / 5, 1::DOUBLE) + least(n / 500, 1::DOUBLE) + least(tables / 2, 1::DOUBLE)) / 4 AS complexity,
               1 + 0.5::DOUBLE * tables + CASE WHEN n > 200 THEN 0.5::DOUBLE ELSE 0 END AS minutes FROM (SELECT *, list_sum(list_transform(texts, lambda x: length(x)))::DOUBLE AS n FROM ({DECK}))""",
)
def slide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.slide_scores(decks(spark, sf_dir)).select("file", "slide_number", F.col("complexity").cast("double").alias("complexity"), F.col("minutes").cast("double").alias("minutes"))


@query("density_balance", f"""WITH k AS (SELECT file, slide_type, count(*) AS n, sum(shapes + tables) AS objects FROM {TYPED} GROUP BY ALL)
    SELECT file, CASE WHEN sum(objects) / sum(n) <= 3 THEN 'low' WHEN sum(objects) / sum(n) <= 6 THEN 'medium' ELSE 'high' END AS content_density,
           CASE WHEN count(*) >= 4 AND max(n) / sum(n) <= 0.7 THEN 'well_balanced' WHEN count(*) >= 3 AND max(n) / sum(n) <= 0.8 THEN 'balanced' WHEN max(n) / sum(n) >= 0.9 THEN 'monotonous' ELSE 'somewhat_balanced' END AS visual_balance
    FROM k GROUP BY file""")  # fmt: skip
def density_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.insights(decks(spark, sf_dir)).select("file", "content_density", "visual_balance")


@query("title_prefix_groups", r"""WITH p AS (SELECT doc_id, regexp_split_to_array(trim(split_part(text, chr(10), 1)), '\s+') AS w FROM documents)
    SELECT w[1] || ' ' || w[2] AS prefix, count(*) AS occurrences, list_sort(list(doc_id)) AS docs FROM p WHERE len(w) >= 2 GROUP BY 1 HAVING count(*) >= 3""")  # fmt: skip
def title_prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", analysis.title_prefix(F.split("text", "\n")[0]).alias("prefix")).where("prefix IS NOT NULL")
    return rows.groupBy("prefix").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_list("doc_id")).alias("docs")).where("occurrences >= 3")


@query("session_summary", """SELECT user_id, count(*) AS steps, count(*) FILTER (event_type <> 'error') AS successes, count(DISTINCT event_type) AS tools, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE AS seconds,
    (count(*) FILTER (event_type <> 'error') / count(*))::DOUBLE AS success_rate FROM events GROUP BY user_id""")  # fmt: skip
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns({"ok": F.col("event_type") != "error", "cents": F.round(F.col("value") * 100).cast("long").cast("double")})
    return workflow.summary(rows, "user_id", "event_type", "ok", "cents")


@query("top_tools", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def top_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.top(table(spark, sf_dir, "events"), "event_type", 3)


QUERIES |= package_queries.QUERIES | varied_queries.QUERIES | surface_queries.QUERIES
ORACLES |= package_queries.ORACLES | varied_queries.ORACLES | surface_queries.ORACLES
