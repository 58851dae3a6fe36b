"""Files that tasks read and write: the folder that all machines share, file systems by URI, finished files by renaming."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, as a URI. A local session without one gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found or f"file://{tempfile.gettempdir()}/deckhand-{os.getuid()}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/deckhand/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, where their lineage ends."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path within."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file under a name of its own, then renames it, so that attempts of a task leave no half of one behind."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(own, path)
