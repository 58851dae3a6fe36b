"""Media columns: payloads stored as lossless images in archives, and a data source that streams them back.

Each task writes one ZIP archive into a folder in the shared storage, and beside it an index of its members'
offsets, sizes and checks. A member is an 8-bit greyscale PNG, 192 samples wide. The data source ``deckhand_archive`` plans
byte ranges over the archives of a folder from their sizes alone; the task of a range finds the members whose
headers lie in its range, by a binary search of the index, or in the archive's directory where there is no
index; it reads each by its offset and streams batches through Arrow. A member that can't be read is tried
again by itself, so a short fault doesn't repeat a whole range.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from deckhand.llm import common

WIDTH = 192
PAD = 32
#: Fixed value: the signature that starts a PNG file.
PNG_START = b"\x89PNG\r\n\x1a\n"
ATTEMPTS = 4
#: Bytes of an archive in one partition, and of the members in one Arrow batch.
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20


def padded(data: bytes) -> bytes:
    """At least one row of samples, filled up with spaces."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, bytes([PAD]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows without a filter, deflated; the same payload gives the same file."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_START + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples, one row each, of an image that to_png() wrote; anything else raises."""
    if not data.startswith(PNG_START):
        raise ValueError("not a PNG file")
    at, width, idat = len(PNG_START), 0, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit greyscale image")
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a filter that isn't written here")
    return raw[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation, and a 64-bit hash of which of 8 x 8 blocks are brighter than the mean."""
    x = samples.astype(np.float64)
    edges = np.linspace(0, len(x), 9).astype(int)[:-1]
    bands = np.add.reduceat(x.reshape(len(x), 8, -1).sum(axis=2), edges, axis=0)
    counts = np.diff(np.append(edges, len(x))).clip(1) * (WIDTH // 8)
    bits = (bands / counts[:, None] > x.mean()).ravel()
    return f"{len(x)}:{x.mean():.4f}:{x.std():.4f}:{np.packbits(bits).tobytes().hex()}"


def write_archives(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores every row's whole text below ``path``, an archive a task.

    A null text is empty, which is one row of spaces; rows that repeat an id are members of their own;
    other columns are ignored; an empty table makes an empty folder. A member's name holds its row's
    id ("null" if none) and number of bytes, so that the media themselves are equal for equal texts.
    """

    @common.frugal
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(path)
        final = f"{root}/media-{TaskContext.get().partitionId():07d}.zip"
        own, archive, index = f"{root}/.{uuid.uuid4().hex}", None, array("Q")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if archive is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(own, buffer_size=1 << 20)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                data = (text.as_py() or "").encode()
                member = zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}_{len(data)}_{len(index) // 3}.png")
                archive.writestr(member, to_png(padded(data)))
                index.extend((member.header_offset, member.compress_size, member.CRC))
        if archive is not None:
            archive.close()
            stream.close()
            with fs.open_output_stream(f"{own}.index") as f:
                f.write(np.array(index, "<u8").tobytes())
            common.publish(fs, f"{own}.index", f"{final}.index")
            common.publish(fs, own, final)
        yield pa.RecordBatch.from_pydict({"members": [len(index) // 3]})

    docs = df.select(F.col(common.quoted(id_col)).cast("long").alias("id"), F.col(common.quoted(text_col)).alias("text"))
    docs.mapInArrow(write, "members long").agg({"members": "sum"}).collect()


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)

    def partitions(self) -> list[ByteRange]:
        """Ranges by the archives' sizes; no archive is opened. A range without members gives no rows."""
        fs, root = common.open_fs(self.folder)
        files = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        found = sorted((f.path, f.size) for f in files if f.path.endswith(".zip"))
        return [ByteRange(p, lo, lo + self.range_bytes) for p, n in found for lo in range(0, n, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = common.open_fs(self.folder)
        rows, size, f = [], 0, fs.open_input_file(partition.path)
        for m in _members(fs, f, partition):
            name, data, f = _member(fs, f, partition.path, m)
            rows.append((partition.path, name, m.header_offset, data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)
        f.close()

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.binary()))], ["archive", "member", "offset", "media"]
        )


@dataclass(frozen=True)
class Member:
    """Of an index or a directory: where a member's header stands, its stored bytes and their check once unpacked."""

    header_offset: int
    compress_size: int
    CRC: int


def _members(fs: pafs.FileSystem, f: pa.NativeFile, part: ByteRange) -> list[Member]:
    """The members whose headers lie in the range."""
    found = fs.get_file_info(f"{part.path}.index")
    if found.type != pafs.FileType.File:
        every = zipfile.ZipFile(f).infolist()
        return [Member(m.header_offset, m.compress_size, m.CRC) for m in every if part.start <= m.header_offset < part.end]
    with fs.open_input_file(f"{part.path}.index") as index:

        def offset(k: int) -> int:
            index.seek(24 * k)
            return struct.unpack("<Q", index.read(8))[0]

        lo, hi = (bisect.bisect_left(range(found.size // 24), at, key=offset) for at in (part.start, part.end))
        index.seek(24 * lo)
        return [Member(*x) for x in np.frombuffer(index.read(24 * (hi - lo)), "<u8").reshape(-1, 3).tolist()]


def _member(fs: pafs.FileSystem, f: pa.NativeFile, path: str, m: Member) -> tuple[str, bytes, pa.NativeFile]:
    """Name and bytes of one member by its offset; a failed read or check opens the file anew and tries this member again."""
    for attempt in range(ATTEMPTS):
        try:
            f.seek(m.header_offset)
            head = f.read(30)
            if head[:4] != zipfile.stringFileHeader:
                raise zipfile.BadZipFile(f"{path}: no member at {m.header_offset}")
            method, name_size, extra = struct.unpack("<8xH16xHH", head)
            name = f.read(name_size).decode()
            f.seek(m.header_offset + 30 + name_size + extra)
            data = f.read(m.compress_size)
            if method == zipfile.ZIP_DEFLATED:
                data = zlib.decompress(data, -15)
            if zlib.crc32(data) != m.CRC:
                raise zipfile.BadZipFile(f"{path}: wrong check at {m.header_offset}")
            return name, data, f
        except (OSError, zipfile.BadZipFile, zlib.error, struct.error, UnicodeDecodeError):
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(0.1 * 2**attempt)
            f = fs.open_input_file(path)
    raise AssertionError


class ArchiveSource(DataSource):
    """``spark.read.format("deckhand_archive").load(folder)``: archive, member, offset, media."""

    @classmethod
    def name(cls) -> str:
        return "deckhand_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("deckhand_archive").load(path)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the stored media, computed from the bytes that were read."""
    for batch in batches:
        rows = []
        for name, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
            doc_id, n, _ = name.split("_")
            samples = from_png(media)
            payload = samples.tobytes()
            rows.append(
                (
                    None if doc_id == "null" else int(doc_id), int(n), len(payload), hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples),
                )
            )
        kinds = [pa.string() if " string" in c else pa.int64() for c in DIGEST.split(", ")]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)], names)


def media_digest(df: DataFrame) -> DataFrame:
    """Stores every text, reads the archives back through the data source, and describes each member."""
    path = common.scratch(df.sparkSession, "media")
    write_archives(df, path)
    return read_archives(df.sparkSession, path).select("member", "media").mapInArrow(common.frugal(digest), DIGEST)
