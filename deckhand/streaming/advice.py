"""Advice for each step of a session as it comes: its context, the workflow it resembles so far, and ways out of errors.

What a session's past matters for is a small state: how far it has come in each known sequence, the tools and parameters
it used, and its last steps. A step moves the state on by a constant amount of work, so the same fold serves a stream, where
Spark keeps the state (``stream``), and a table, whose sessions a task goes through in order (``batch``). Neither ever
holds a session's steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from deckhand.functions.predicates import text
from deckhand.operators.workflow import LEAST_SCORE, WORKFLOWS

#: What errors say, and what helps then, best first; the last helps always.
RECOVERIES = {"broaden_search": ("no results", "empty"), "check_file": ("file not found", "access"), "correct_parameters": ("invalid", "format"), "start_from_overview": ("",)}
MOST_RECOVERIES = 3
#: Steps that a context looks back on.
RECENT = 3
SEQUENCES = [(w, p) for w, (_, _, patterns) in WORKFLOWS.items() for p in patterns]
LONGEST = max(len(p) for _, p in SEQUENCES)
OUT = "context string, workflow string, confidence double, steps_so_far long"


class Progress:
    """The state of one session."""

    def __init__(self, saved: str | None = None):
        self.n, self.last, self.tools, self.parameters, self.at, self.whole = json.loads(saved) if saved else (0, [], [], [], [0] * len(SEQUENCES), [False] * len(SEQUENCES))

    def saved(self) -> str:
        return json.dumps([self.n, self.last, self.tools, self.parameters, self.at, self.whole])

    def step(self, tool: str | None, parameters: list[str]) -> tuple[str, str | None, float, int]:
        """Takes a step; its context, the workflow (None below the least score), the best score, and the number of steps."""
        known = {t for tools, _, _ in WORKFLOWS.values() for t in tools}
        names = {p for _, given, _ in WORKFLOWS.values() for p in given}
        self.n, self.last = self.n + 1, [*self.last, tool][-max(LONGEST, RECENT) :]
        if tool in known and tool not in self.tools:
            self.tools.append(tool)
        self.parameters += [p for p in dict.fromkeys(parameters) if p in names and p not in self.parameters]
        for k, (_, p) in enumerate(SEQUENCES):
            self.at[k] += self.at[k] < len(p) and p[self.at[k]] == tool
            self.whole[k] |= self.last[-len(p) :] == p
        scores = {}
        for w, (tools, given, _) in WORKFLOWS.items():
            best = max(1.0 if self.whole[k] else self.at[k] / len(p) for k, (v, p) in enumerate(SEQUENCES) if v == w)
            scores[w] = 0.4 * (sum(t in self.tools for t in tools) / len(tools)) + 0.3 * (sum(p in self.parameters for p in given) / len(given)) + 0.3 * best
        workflow = max(scores, key=scores.get)
        return self.context(), workflow if scores[workflow] > LEAST_SCORE else None, scores[workflow], self.n

    def context(self) -> str:
        """What the last steps are about; the first rule that fits."""
        recent = self.last[-RECENT:]
        if "get_presentation_overview" in recent:
            return "exploration"
        if "extract_table_data" in recent or "analyze_text_formatting" in recent:
            return "targeted_extraction"
        if "filter_and_aggregate" in recent:
            return "analysis"
        return "optimization" if len(recent) == RECENT and len(set(recent)) == 1 else "targeted_extraction"


def _schema(df: DataFrame, session: str, seq: str) -> T.StructType:
    return T.StructType([T.StructField("session", df.schema[session].dataType), T.StructField("seq", df.schema[seq].dataType), T.StructField("tool", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()), *T.StructType.fromDDL(OUT)])


def _steps(df: DataFrame, session: str, seq: str, tool: str, parameters: str | None, success: str | None, error: str | None) -> DataFrame:
    given = F.coalesce(F.map_keys(parameters), F.array().cast("array<string>")) if parameters else F.array().cast("array<string>")
    return df.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(tool).cast("string").alias("tool"), given.alias("parameters"), (F.coalesce(F.col(success), F.lit(False)) if success else F.lit(True)).alias("success"), (F.col(error) if error else F.lit(None)).cast("string").alias("error"))


def recovery(success: Column, error: Column) -> Column:
    """What to do about a step that failed, best first; nothing for one that didn't."""
    fits = [F.when(F.coalesce(*(F.when(F.lower(text(error)).contains(w), True) for w in says), F.lit(False)), F.lit(name)) for name, says in RECOVERIES.items()]
    return F.when(success, F.array().cast("array<string>")).otherwise(F.slice(F.array_compact(F.array(*fits)), 1, MOST_RECOVERIES))


def batch(df: DataFrame, session: str, seq: str, tool: str, parameters: str | None = None, success: str | None = None, error: str | None = None) -> DataFrame:
    """session, seq, tool, success, error, context, workflow, confidence, steps_so_far, recovery of every step of a table.

    Steps of a session are taken in the order of seq, equal ones by tool; a null session is one session. Without
    ``success`` all steps have succeeded. A session is one task's, which reads it row by row.
    """
    fields = _schema(df, session, seq)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, progress = object(), Progress()
        for b in batches:
            out = []
            for who, tool_, given in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if who != current:
                    current, progress = who, Progress()
                out.append(progress.step(tool_, given))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2, 4, 5)), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[5:]))], schema=arrow)

    ordered = _steps(df, session, seq, tool, parameters, success, error).repartition("session").sortWithinPartitions("session", "seq", "tool")
    return ordered.mapInArrow(run, fields).withColumn("recovery", recovery(F.col("success"), F.col("error")))


class Adviser(StatefulProcessor):
    """Moves each session's state on by the steps of a micro-batch, in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "progress string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(rows)).sort_values(["seq", "tool"], kind="stable")
        progress = Progress(self.state.get()[0] if self.state.exists() else None)
        found = [progress.step(t, list(p)) for t, p in zip(steps["tool"], steps["parameters"])]
        self.state.update((progress.saved(),))
        yield pd.concat([steps[["session", "seq", "tool", "success", "error"]].reset_index(drop=True), pd.DataFrame(found, columns=["context", "workflow", "confidence", "steps_so_far"])], axis=1)

    def close(self) -> None:
        pass


def stream(df: DataFrame, session: str, seq: str, tool: str, parameters: str | None = None, success: str | None = None, error: str | None = None) -> DataFrame:
    """The same for a stream, for each step as it comes; steps of one session must come in order from one micro-batch to the next.

    The session's state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    steps = _steps(df, session, seq, tool, parameters, success, error)
    found = steps.groupBy("session").transformWithStateInPandas(Adviser(), _schema(df, session, seq), "Append", "None")
    return found.withColumn("recovery", recovery(F.col("success"), F.col("error")))


def learnt(steps: DataFrame, most: int = 5) -> DataFrame:
    """kind, name, n, rank: what advised steps teach, of each kind the most frequent.

    patterns: workflow and context of steps that succeeded; tools: their tools; errors: tools of steps that failed. Equal
    numbers rank by name. Steps are counted in their tasks first.
    """
    name = F.concat_ws("_", F.coalesce("workflow", F.lit("unknown")), "context")
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    tool = F.coalesce("tool", F.lit("unknown"))
    taught = F.when(F.col("success"), F.array(entry("patterns", name), entry("tools", tool))).otherwise(F.array(entry("errors", tool)))
    counts = steps.select(F.explode(taught).alias("e")).groupBy("e.kind", "e.name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)
