"""Records given inline or as JSON, as DataFrames; and DataFrames as JSON."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQ = "seq"


def inline(spark: SparkSession, given: Any) -> DataFrame:
    """Records given as a list, as {"data": [...]}, or as JSON text of either, in order of ``seq``; anything else is an error.

    Columns are all keys that occur, with types that fit all their values; a record without a key has null there.
    """
    given = json.loads(given) if isinstance(given, (str, bytes)) else given
    rows = given.get("data") if isinstance(given, dict) else given
    if not isinstance(rows, (list, tuple)) or not all(isinstance(r, dict) for r in rows):
        raise ValueError('records must be a list of objects, or {"data": [...]}')
    if not rows:
        return spark.createDataFrame([], f"{SEQ} long")
    if any(SEQ in r for r in rows):
        raise ValueError(f"a record may not have a key {SEQ}, which orders them")
    texts = spark.createDataFrame([(k, json.dumps(r, ensure_ascii=False)) for k, r in enumerate(rows)], f"{SEQ} long, j string")
    schema = texts.agg(F.schema_of_variant_agg(F.parse_json("j")).alias("s")).first().s
    kinds = schema.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return texts.select(F.from_json("j", kinds).alias("r"), SEQ).select("r.*", SEQ)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, with its nulls."""
    return df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """A line a row, in files below the path, with nulls and with letters as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
