"""Length-delimited binary records of token ids, with a separate offset index.

A data file is a run of records. Each is framed as

    length   8 bytes, little-endian
    check    4 bytes, masked CRC-32 of the length
    payload  ``length`` bytes
    check    4 bytes, masked CRC-32 of the payload

and the payload is: flags (1 byte; bit 0: the document id is null), document id (8 bytes, signed),
then the ids as little-endian 16-bit integers. The index beside it has for each record its offset
(8 bytes) and number of ids (8 bytes), so that a reader can fetch any record in any order.

The checks are masked as usual for record files (rotate by 15, add a constant), so that a stored
check isn't mistaken for data; the polynomial is zlib's.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckhand.llm import common, vocab

#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8
#: Ended documents get this id.
END_ID = 0
#: Bytes of a data file that one reading task takes.
READ_BYTES = 32 << 20
#: Characters of a text that order rows with the same id.
HEAD = 16


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    payload = struct.pack("<Bq", doc_id is None, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[int | None, np.ndarray]:
    """The record at an offset; a wrong check raises."""
    length = bytes(data[at : at + 8])
    (n,) = struct.unpack("<Q", length)
    payload = bytes(data[at + 12 : at + 12 + n])
    checks = struct.unpack("<I", data[at + 8 : at + 12]) + struct.unpack("<I", data[at + 12 + n : at + 16 + n])
    if checks != (masked_crc(length), masked_crc(payload)):
        raise ValueError(f"damaged record at {at}")
    null, doc_id = struct.unpack_from("<Bq", payload)
    return None if null else doc_id, np.frombuffer(payload, "<u2", offset=9)


def write_records(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes every row's ids below ``path`` in ascending order of id and returns the manifest.

    Rows are range-partitioned by id, so file k holds no larger ids than file k + 1. A null id sorts
    first; rows that repeat an id, or have none, are ordered by the first characters of their text and by
    its hash, by which they are parted too, so that no id makes a task larger than its share. A null text
    counts as empty and has the end id alone. Other columns are ignored. An empty table
    gives no files. A task writes under a name of its own and renames at the end, so repeated or
    speculative attempts do no harm. Manifest, one row a file: file, records, ids, bytes.
    """
    spark = df.sparkSession
    tokenizer = tokenizer or vocab.default_path("byte_bpe_50k.json")
    docs = df.select(F.col(common.quoted(id_col)).cast("long").alias("id"), F.col(common.quoted(text_col)).alias("text"))
    docs = docs.withColumns({"head": F.coalesce(F.left("text", F.lit(HEAD)), F.lit("")), "hash": F.xxhash64("text")})
    parts = max(common.shuffle_partitions(spark), common.input_bytes(df) >> 26)

    @common.frugal
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(path)
        name = f"{root}/records-{TaskContext.get().partitionId():07d}"
        own = f".{uuid.uuid4().hex}"
        encode, end = vocab.encoder(tokenizer, True).packed, struct.pack("<H", END_ID)
        data, index, at, records, ids = None, [], 0, 0, 0
        for batch in batches:
            if data is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                data = fs.open_output_stream(name + own, buffer_size=1 << 20)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = encode(text.as_py() or "") + end
                framed = frame(doc_id, packed)
                data.write(framed)
                index.append((at, len(packed) // 2))
                at, records, ids = at + len(framed), records + 1, ids + len(packed) // 2
        vocab.forget()
        if data is not None:
            data.close()
            with fs.open_output_stream(f"{name}.index{own}") as f:
                f.write(np.array(index, "<u8").tobytes())
            common.publish(fs, f"{name}.index{own}", f"{name}.index")
            common.publish(fs, name + own, f"{name}.data")
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name.rpartition('/')[2]}"], "records": [records], "ids": [ids], "bytes": [at]})

    ordered = docs.repartitionByRange(parts, "id", "head", "hash").sortWithinPartitions("id", "head", "hash")
    manifest = ordered.select("id", "text").mapInArrow(write, "file string, records long, ids long, bytes long")
    # One row a file; the files' number follows from spark.sql.shuffle.partitions, not from the rows.
    rows = sorted(map(tuple, manifest.collect()))
    return spark.createDataFrame(rows, "file string, records long, ids long, bytes long")


def read_records(spark: SparkSession, manifest: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """Every record of the files, checked: doc_id, start (ids of all records before it), n_tokens, ids_crc32, ids.

    ids are little-endian unsigned 32-bit integers. Files are read in ranges of records found in
    their index, so that one large file is shared among tasks.
    """
    ranges, start = [], 0
    for r in manifest.orderBy("file").collect():  # one row a file
        step = max(1, r.records * read_bytes // max(r.bytes, 1))
        ranges += [(r.file, lo, min(lo + step, r.records), start) for lo in range(0, r.records, step)]
        start += r.ids

    @common.frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, name = common.open_fs(r["file"])
                with fs.open_input_file(f"{name}.index") as f:
                    index = np.frombuffer(f.read(16 * r["hi"]), "<u8").reshape(-1, 2).astype(np.int64)
                first = r["base"] + int(index[: r["lo"], 1].sum())
                index = index[r["lo"] :]
                starts = first + np.concatenate([[0], np.cumsum(index[:, 1])])
                with fs.open_input_file(f"{name}.data") as f:
                    f.seek(int(index[0, 0]))
                    data = memoryview(f.read(int(index[-1, 0] - index[0, 0]) + 25 + 2 * int(index[-1, 1])))
                for lo in range(0, len(index), 1024):
                    got = [unframe(data, int(at - index[0, 0])) for at in index[lo : lo + 1024, 0]]
                    ids = [x.astype("<u4").tobytes() for _, x in got]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([d for d, _ in got], pa.int64()),
                            "start": pa.array(starts[lo : lo + len(got)], pa.int64()),
                            "n_tokens": pa.array([len(x) for _, x in got], pa.int64()),
                            "ids_crc32": pa.array(map(zlib.crc32, ids), pa.int64()),
                            "ids": pa.array(ids, pa.binary()),
                        }
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not ranges:
        return spark.createDataFrame([], schema)
    plan = spark.createDataFrame(ranges, "file string, lo long, hi long, base long").repartition(len(ranges))
    return plan.mapInArrow(read, schema)


def record_at(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a data file, found by its index alone, so that records can be read in any order."""
    fs, name = common.open_fs(path)
    with fs.open_input_file(f"{name}.index") as f:
        f.seek(16 * k)
        at, n = struct.unpack("<QQ", f.read(16))
    with fs.open_input_file(f"{name}.data") as f:
        f.seek(at)
        return unframe(f.read(25 + 2 * n), 0)


def record_digest(df: DataFrame) -> DataFrame:
    """Writes the records, reads them back, and returns for each document what the files hold."""
    spark = df.sparkSession
    manifest = write_records(df, common.scratch(spark, "records"))
    return read_records(spark, manifest).drop("ids")
