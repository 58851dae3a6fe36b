"""What the operators share: the shared folder, written tables, files that tasks write, Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Text of about so many bytes is worked on at a time where columns of eight bytes a character arise.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error, as
    a local folder would be a different one on every machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/deckhand-{os.getuid()}"
    if "://" in found or found.startswith("file:"):
        return found.rstrip("/")
    # Without a scheme the path is one of the cluster's default file system, not of each machine's own.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


#: Lists of the paths that open temporary() blocks made, the innermost last.
_made: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Results read from it, so it stays until clean() or the end of a temporary() block."""
    path = f"{shared_dir(spark)}/deckhand/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the scratch paths that a block made when it ends, but those of tables that it passes to what it gets."""
    _made.append([])
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._deckhand_path)
        return table

    try:
        yield keep
    finally:
        for path in _made.pop():
            if path not in kept:
                clean(spark, path)


def others(df: DataFrame, new: Iterable[str]) -> list[str]:
    """Columns of df but those that new ones replace; names are equal as the session sees them, by default without regard to case."""
    fold = str if df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true" else str.lower
    replaced = {fold(n) for n in new}
    return [c for c in df.columns if fold(c) not in replaced]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ddl(df: DataFrame, names: list[str]) -> str:
    """Names and types of columns, for a schema."""
    return ", ".join(f"{quoted(n)} {df.schema[n].dataType.simpleString()}" for n in names)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def clean(spark: SparkSession, path: str | None = None) -> None:
    """Deletes one scratch path, or all of them when no result is read any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path or f"{shared_dir(spark)}/deckhand")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Settings while a table is written: shuffle files go with their job, and a batch for Python is bounded in bytes too.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends there, and a lost executor loses nothing.

    Shuffle files of the job that writes it go when it ends, so that steps don't add up on disk.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    table = spark.read.schema(df.schema).parquet(path)
    table._deckhand_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        clean(table.sparkSession, table._deckhand_path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, on any machine."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Renames a finished file. Attempts of one task write the same bytes, so one that is there already stays."""
    if isinstance(fs, pafs.LocalFileSystem):
        os.replace(temporary, final)
        return
    there = lambda: fs.get_file_info(final).type != pafs.FileType.NotFound
    if not there():
        try:
            fs.move(temporary, final)
            return
        except OSError:
            if not there():
                raise
    fs.delete_file(temporary)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def release() -> None:
    """Gives memory that is free in this worker back to the system.

    Workers live on and serve the next stages, whose own workers and whose JVM need the room.
    """
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task for mapInArrow, which releases its memory when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def frugal_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """The same for a group of applyInArrow."""

    def wrapped(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            release()

    return wrapped


def texts(column: pa.Array) -> list[str]:
    """Strings; null becomes empty."""
    return [t or "" for t in column.to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and len + 1 offsets into them; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes come to about ``most``; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size; 0 if it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if n > 1 << 60 else n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(*parts: bytes) -> bytes:
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unpacked(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    sizes, at, parts = struct.unpack_from(f"<{n}Q", data, 4), 4 + 8 * n, []
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    return parts


def zipped(x: np.ndarray | bytes) -> bytes:
    data = x if isinstance(x, bytes) else x.tobytes()
    return struct.pack("<Q", len(data)) + pa.compress(data, "zstd", asbytes=True)


def unzipped(data: bytes) -> bytes:
    (n,) = struct.unpack_from("<Q", data)
    return pa.decompress(data[8:], n, "zstd", asbytes=True)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges start..start + length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
