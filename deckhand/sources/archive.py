"""Parts of packages as a data source: only what a query asks for is read from the archives.

``spark.read.format("deckhand_parts").load(folder)`` has a row a part. Every archive's directory is read by range, from
its end; a part's own bytes are read only if the schema has ``content`` and the part passes the filters on ``name``,
``ordinal`` and ``file`` that Spark hands over. Filters on ``file`` keep archives from being opened at all.

Small archives share a task; a large one is cut into ranges, and a part belongs to the range that its header starts in.
"""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

from deckhand.sources import storage
from deckhand.sources.ooxml import MAX_BYTES, UNREADABLE

FORMAT = "deckhand_parts"
#: bytes_read: what the task has read of the archive until then, its directory included. length is the archive's.
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("file", T.StringType()), ("ordinal", T.IntegerType()), ("name", T.StringType()), ("size", T.LongType()), ("is_xml", T.BooleanType()), ("content", T.BinaryType()), ("length", T.LongType()), ("bytes_read", T.LongType()))]
)
#: Bytes of archives for a task, and how many tasks there are at most; beyond it tasks take more.
RANGE_BYTES, MOST_TASKS = 64 << 20, 20_000
#: Content for a batch of rows.
BATCH_BYTES = 8 << 20


class Counted(io.RawIOBase):
    """A file that knows how many bytes were read from it."""

    def __init__(self, f, length: int):
        self.f, self.length, self.at, self.read_bytes = f, length, 0, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = max(0, (0, self.at, self.length)[whence] + to)
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.length - self.at if n is None or n < 0 else n
        self.f.seek(min(self.at, self.length))
        data = self.f.read(n)
        self.at += len(data)
        self.read_bytes += len(data)
        return data


@dataclass
class Ranges(InputPartition):
    """What a task reads: path, length, and the range of bytes in which parts start, of each archive."""

    files: list[tuple[str, int, int, int]]


class PackageParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> "PartReader":
        return PartReader(self.options, schema)


def planned(files: Iterable[tuple[str, int]], range_bytes: int = RANGE_BYTES, most: int = MOST_TASKS) -> list[Ranges]:
    """Archives and ranges of them for each task."""
    files = sorted(files)
    size = max(range_bytes, -(-sum(n for _, n in files) // most))
    out, own, held = [], [], 0
    for path, length in files:
        for lo in range(0, max(length, 1), size):
            hi = min(lo + size, max(length, 1))
            if own and held + hi - lo > size:
                out.append(Ranges(own))
                own, held = [], 0
            own.append((path, length, lo, hi))
            held += hi - lo
    return out + [Ranges(own)] * bool(own)


class PartReader(DataSourceReader):
    """Options: path (a folder or file), glob (of file names; *.pptx), range_bytes."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.glob, self.range_bytes = options["path"], options.get("glob", "*.pptx"), int(options.get("range_bytes", RANGE_BYTES))
        self.schema, self.tests = schema, {"name": [], "file": [], "ordinal": []}
        if bad := [c for c in schema.names if c not in SCHEMA.names]:
            raise ValueError(f"unknown columns: {', '.join(bad)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = self._test(f)
            if test is None:
                yield f
            else:
                self.tests[f.attribute[0]].append(test)

    def _test(self, f: Filter) -> Callable | None:
        if getattr(f, "attribute", None) not in [(c,) for c in self.tests]:
            return None
        if isinstance(f, IsNotNull):
            return lambda x: True
        made = {
            EqualTo: lambda v: lambda x: x == v, In: lambda v: frozenset(v).__contains__, StringStartsWith: lambda v: lambda x: x.startswith(v),
            StringEndsWith: lambda v: lambda x: x.endswith(v), StringContains: lambda v: lambda x: v in x,
        }.get(type(f))
        return made(f.value) if made else None

    def passes(self, column: str, value) -> bool:
        return all(t(value) for t in self.tests[column])

    def partitions(self) -> list[Ranges]:
        fs, root = storage.opened(self.path)
        there = fs.get_file_info(root)
        found = [there] if there.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return planned(((f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob) and self.passes("file", self.named(f.path))), self.range_bytes)

    def named(self, path: str) -> str:
        """A file's name in the table: with the scheme and host that the folder was given."""
        uri = self.path.rstrip("/")
        root = storage.opened(uri)[1]
        return uri.removesuffix(root) + path if uri.endswith(root) else path

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = storage.opened(self.path)
        arrow = to_arrow_schema(self.schema)
        rows, held = [], 0
        for path, length, lo, hi in partition.files:
            for row in self.rows(fs, path, length, lo, hi):
                rows.append(row)
                held += len(row.get("content") or b"") + 200
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def rows(self, fs: pafs.FileSystem, path: str, length: int, lo: int, hi: int) -> Iterator[dict]:
        """The parts of one archive that start in a range and pass the filters; one that can't be opened has none."""
        with fs.open_input_file(path) as f:
            own = Counted(f, length)
            try:
                z = zipfile.ZipFile(own)
            except UNREADABLE:
                return
            for k, i in enumerate(z.infolist()):
                if lo <= i.header_offset < hi and self.passes("name", i.filename) and self.passes("ordinal", k):
                    row = {"file": self.named(path), "ordinal": k, "name": i.filename, "size": i.file_size, "is_xml": bool(re.search(r"\.(xml|rels)$", i.filename)), "length": length}
                    if "content" in self.schema.names:
                        try:
                            row["content"] = z.read(i) if i.file_size <= MAX_BYTES else None
                        except UNREADABLE:
                            row["content"] = None
                    yield row | {"bytes_read": own.read_bytes}


def scan(spark: SparkSession, path: str, content: bool = False, **options: str) -> DataFrame:
    """file, ordinal, name, size, is_xml, length, bytes_read of every part below a path; on demand content.

    Without it only the archives' directories are read. Filters on name, file and ordinal that follow go to the source.
    A part over 100 MB, or one that is damaged, has no content; an archive that can't be opened has no parts; a folder
    without archives gives no rows.
    """
    spark.dataSource.register(PackageParts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = T.StructType([f for f in SCHEMA if content or f.name != "content"])
    return spark.read.format(FORMAT).schema(schema).options(**options).load(path)


def write_packages(files: DataFrame, path: str) -> DataFrame:
    """Writes rows of path and content as files of that name below a folder; file, length of each.

    Attempts of a task write the same bytes under the same name. Rows with the same name leave one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage.opened(path)
        for batch in batches:
            names = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = name.rpartition("/")[2]
                fs.create_dir(root, recursive=True)
                storage.put(fs, f"{root}/{name}", content.as_py() or b"")
                names.append((name, len(content.as_py() or b"")))
            yield pa.RecordBatch.from_pydict({"file": pa.array([n for n, _ in names], pa.string()), "length": pa.array([n for _, n in names], pa.int64())})

    return files.select("path", "content").mapInArrow(run, "file string, length long")
