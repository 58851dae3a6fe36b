"""Packages and step logs as streams. The batch operators do the work; these only feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deckhand.sources import ooxml


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parsed rows of packages as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(path)
    return ooxml.parsed(files)


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new in a folder to a Parquet table, once for each file, and ends when all is read."""
    rows = arriving(spark, path)
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sessions(steps: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", time: str = "ts", tool: str = "event_type") -> DataFrame:
    """Sessions of a step log, batch or stream: steps that follow within the gap belong together."""
    return steps.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("steps"), F.size(F.collect_set(tool)).alias("tools"))
