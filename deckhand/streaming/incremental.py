"""A table of parsed packages that is brought up to date by runs, each of which parses only what changed.

A run lists the files without reading them, and opens those whose identity (path, length, time) the table doesn't have.
Of an opened file only slides are parsed whose own parts (the slide, its relations, notes and comments) changed; for the
others the rows of an earlier run are taken over with their new places. Files that are gone are noted as such.

Runs are folders below the table's path. A run counts once Spark has marked it complete, so one that fails leaves nothing
behind that is read, and is written anew by the next; running again over the same files finds nothing to do and adds no run.
One run at a time may write a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deckhand.sources import ooxml, storage

#: Beside a parsed row: its file's identity, the stamp of its parts, the run that parsed it and the run that wrote it.
SCHEMA = f"{ooxml.SCHEMA}, identity string, stamp string, parsed_run int, run int"
PLACE = ("slide_number", "slide_id", "section", "part_number", "width", "height", "modified", "length")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def runs(spark: SparkSession, path: str) -> list[int]:
    """The complete runs of a table, in order."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    found = sorted(int(n.removeprefix("run-")) for n in names if n.startswith("run-") and n[4:].isdigit())
    return [k for k in found if fs.exists(_fs(spark, f"{path}/run-{k:06d}/_SUCCESS")[1])]


def every(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all complete runs."""
    found = [f"{path}/run-{k:06d}" for k in runs(spark, path)]
    return spark.read.schema(SCHEMA).parquet(*found) if found else spark.createDataFrame([], SCHEMA)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all files as of now: of each file those of the last run that wrote it, without files that are gone."""
    rows = every(spark, path)
    last = rows.groupBy(F.col("file").alias("_file")).agg(F.max("run").alias("_run"))
    return rows.join(last, (F.col("file") == F.col("_file")) & (F.col("run") == F.col("_run"))).where("kind <> 'gone'").drop("_file", "_run")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """file, modified, length, identity of all files below a folder; none of them is read."""
    return ooxml.metadata(ooxml.binary(spark, folder)).select("file", "modified", "length", "identity")


def tasks(found: DataFrame) -> int:
    """How many tasks parse the files of a listing: a quarter of those that list them, as many as the session runs at a time at least.

    Names and stamps are few bytes, so that joins leave all of them to one task, which would open all files.
    """
    return max(found.sparkSession.sparkContext.defaultParallelism, found.rdd.getNumPartitions() // 4)


def _parser(arrow: pa.Schema):
    """The task that opens files and parses what isn't known."""
    blank = dict.fromkeys(arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in ooxml.each([batch]):
                own = {k: f[k] for k in ("file", "modified", "length", "identity")}
                data = None
                if f["length"] <= ooxml.MAX_BYTES:
                    fs, name = storage.opened(f["file"])
                    with fs.open_input_file(name) as opened:
                        data = opened.read()
                why = ooxml.problem(f["file"], f["length"], data)
                rows = [{"kind": "reject", "error": why}] if why else ooxml._package(data, dict(f["known"] or ()))
                for some in batched(rows, ooxml.BATCH_ROWS):
                    yield pa.RecordBatch.from_pylist([blank | own | r for r in some], schema=arrow)

    return run


def refresh(spark: SparkSession, folder: str, path: str) -> dict[str, int]:
    """Brings the table at ``path`` up to date with the packages below ``folder``; what the run did, as counts.

    run (0 if nothing had changed), files (changed or new), gone, slides parsed, slides kept.
    """
    done = runs(spark, path)
    number = done[-1] + 1 if done else 1
    prior, now = state(spark, path), listed(spark, folder)
    old = prior.select("file", "identity").distinct()
    changed = now.join(old, ["file", "identity"], "left_anti")
    gone = old.select("file").distinct().join(now.select("file"), "file", "left_anti")
    stamps = prior.where("kind = 'slide' AND error IS NULL").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("part", "stamp"))).alias("known"))
    work = changed.join(stamps, "file", "left").repartition(tasks(now), "file")
    fields = T.StructType([f for f in T.StructType.fromDDL(SCHEMA) if f.name not in ("parsed_run", "run")])
    parsed = work.select("file", "modified", "length", "identity", "known").mapInArrow(_parser(to_arrow_schema(fields)), fields)
    before = prior.where("kind = 'slide'").select(*(F.col(n).alias(f"_{n}") for n in prior.columns))
    joined = parsed.join(before, (F.col("kind") == "kept") & (F.col("file") == F.col("_file")) & (F.col("part") == F.col("_part")), "left")
    kept = F.col("kind") == "kept"
    here = (*PLACE, "file", "identity", "part", "stamp")
    rows = joined.select(
        *(F.col(n) if n in here else F.when(kept, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in fields.names),
        F.when(kept, F.col("_parsed_run")).otherwise(number).alias("parsed_run"), F.lit(number).alias("run"),
    )
    ended = gone.select("file", F.lit("gone").alias("kind"), F.lit(number).alias("parsed_run"), F.lit(number).alias("run"))
    target = f"{path}/run-{number:06d}"
    rows.unionByName(ended, allowMissingColumns=True).write.mode("overwrite").parquet(target)
    own = spark.read.schema(SCHEMA).parquet(target).agg(
        F.count_distinct(F.when(F.col("kind") != "gone", F.col("file"))).alias("files"), F.count_if(F.col("kind") == "gone").alias("gone"),
        F.count_if((F.col("kind") == "slide") & (F.col("parsed_run") == number)).alias("parsed"), F.count_if((F.col("kind") == "slide") & (F.col("parsed_run") < number)).alias("kept"),
    ).first().asDict()
    if not own["files"] and not own["gone"]:
        fs, empty = _fs(spark, target)
        fs.delete(empty, True)
        number = 0
    return {"run": number, **own}
