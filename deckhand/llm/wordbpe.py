"""Byte-level BPE over a global table of distinct words, and decoding by the token-byte table.

Encoding takes three steps.

1. A task goes through its documents in blocks of some megabytes and splits them into pre-tokens.
   Positions are exploded into a sequence of word ranks, which goes to a file of the task in the
   shared folder; the block's distinct words go to the shuffle, dealt by a hash of the word. So a word
   leaves a block once however often it occurs, and no word is hot.
2. The task of a bucket gets all rows of its words, encodes each distinct word once, and joins the
   ids to every block that has it.
3. The ids of a block's words come together with its sequence, and documents are put together again
   by position.

A "word" is a match of the pattern, in any script. Characters that this module's patterns and the encoder's
class differently, such as those of a newer Unicode, are found by asking both for all characters; a run with
one of them stays one word here and is split by the encoder itself. Tasks write under names of their own and rename, and repeat identically, so lost
executors do no harm. The input must be a table or another input that is read alike each time.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckhand.llm import common, vocab
from deckhand.llm.common import packed, ragged, unpacked, unzipped, zipped

BLOCK_BYTES = 6 << 20
#: Bytes of input, as Spark estimates them, for which there is a bucket at least: so few enough words share one.
BUCKET_BYTES = 32 << 20
#: Bytes of ids that make a block for decoding, and ids decoded at a time where columns of eight bytes a byte arise.
IDS_BYTES = 4 << 20
SOME_IDS = 1 << 18


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=vocab.SPACED, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def unlike() -> str:
    """Characters that the two pattern libraries class differently."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs, ours = set(bytes(theirs.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
        found |= theirs ^ ours
        if kind == r"\s" and not all(c.isspace() for c in theirs):
            raise ValueError("the encoder has white space that isn't any here")
    return "".join(sorted(found))


def explode(block: list[str], apart: str = "") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the sequence of their indices through all texts, and each text's number of words.

    Pieces with a character of ``apart`` are left whole.
    """
    odd = frozenset(apart)
    pattern, seen, order, pieces = regex.compile(vocab.SPACED), {}, [], []
    for text in block:
        head, *tail = text.split(" ")
        if any(not c or c[0].isspace() for c in tail):
            head, *tail = re.split(r" (?=\S)", text)
        order.append(seen.setdefault((head,), len(seen)))
        order += [seen.setdefault(c, len(seen)) for c in tail]
        pieces.append(1 + len(tail))
    words: dict[str, int] = {}
    flat, lengths = [], []
    for key in seen:
        piece, spaced = (key[0], key[0]) if isinstance(key, tuple) else (key, " " + key)
        if piece.isascii() or odd.isdisjoint(piece):
            found = [spaced] if piece.isalpha() else pattern.findall(spaced)
        else:
            found = [spaced]
        flat += [words.setdefault(w, len(words)) for w in found]
        lengths.append(len(found))
    lengths, order = np.array(lengths, np.int64), np.array(order, np.int64)
    starts = np.cumsum(lengths) - lengths
    sequence = np.array(flat, np.int64)[ragged(starts[order], lengths[order])]
    ends = np.concatenate([[0], np.cumsum(lengths[order])])
    return list(words), sequence, np.diff(ends[np.concatenate([[0], np.cumsum(pieces)])])


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), as the tiktoken library encodes without special tokens.

    A null text counts as empty and has no ids; null and repeated document ids come back as they are;
    other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    ranks, apart = ranks or vocab.default_path("byte_bpe_multi_50k.tiktoken"), unlike()
    buckets, path = max(common.shuffle_partitions(spark), common.input_bytes(df) // BUCKET_BYTES), common.scratch(spark, "positions")

    @common.frugal
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(path)
        pid = TaskContext.get().partitionId()
        name, own, f, at, k = f"{root}/positions-{pid:07d}", f"{root}/.{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            _, offsets = common.text_bytes(batch.column(1))
            for lo, hi in common.slices(offsets, BLOCK_BYTES):
                ids = batch.column(0)[lo:hi]
                words, sequence, counts = explode(common.texts(batch.column(1)[lo:hi]), apart)
                # The frequent words get the small ranks, so that the high bytes of a sequence are nearly all 0.
                by_rank = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.int64)
                rank[by_rank] = np.arange(len(words))
                sequence = rank[sequence]
                segment = packed(
                    np.array(ids.is_null()).tobytes(), ids.fill_null(0).to_numpy().astype("<i8").tobytes(), counts.astype("<i8").tobytes(),
                    *(zipped((sequence >> s & 0xFF).astype(np.uint8)) for s in (0, 8, 16, 24)),
                )
                if f is None:
                    fs.create_dir(root, recursive=True)
                    f = fs.open_output_stream(own, buffer_size=1 << 20)
                f.write(segment)
                data = [words[w].encode() for w in by_rank]
                bucket = np.array([zlib.crc32(w) % buckets for w in data], np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(k % buckets, at, len(segment), None)]
                for b in np.flatnonzero(np.diff(cuts)):
                    own_words = order[cuts[b] : cuts[b + 1]]
                    lengths = np.array([len(data[w]) for w in own_words], "<u4")
                    rows.append((int(b), None, None, packed(own_words.astype("<u4").tobytes(), zipped(lengths), zipped(b"".join(data[w] for w in own_words)))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pid << 32 | k] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary())))],
                    ["block", "bucket", "at", "size", "words"],
                )
                at, k = at + len(segment), k + 1
        if f is not None:
            f.close()
            common.publish(fs, own, name)

    @common.frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        merge = encoding(ranks).encode_ordinary
        for batch in batches:
            out = []
            for row in batch.column("words").to_pylist():
                if row is None:
                    out.append(None)
                    continue
                own_words, lengths, data = unpacked(row)
                lengths, data = np.frombuffer(unzipped(lengths), "<u4"), unzipped(data)
                got, start = [], 0
                for n in lengths.tolist():
                    word = data[start : start + n]
                    start += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(merge(word.decode()), "<u2").tobytes()
                    got.append(ids)
                out.append(packed(own_words, zipped(np.array(list(map(len, got)), "<u4")), b"".join(got)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "at", "size")), pa.array(out, pa.binary())], ["block", "at", "size", "ids"])

    @common.frugal_group
    def join(key: tuple, table: pa.Table) -> pa.Table:
        fs, root = common.open_fs(path)
        (at, size) = next((a, s) for a, s in zip(table.column("at").to_pylist(), table.column("size").to_pylist()) if a is not None)
        with fs.open_input_file(f"{root}/positions-{key[0].as_py() >> 32:07d}") as f:
            f.seek(at)
            null, doc_ids, counts, *planes = unpacked(f.read(size))
        sequence = sum(np.frombuffer(unzipped(p), np.uint8).astype(np.int64) << 8 * k for k, p in enumerate(planes))
        parts = [unpacked(x) for x in table.column("ids").to_pylist() if x is not None]
        words = np.concatenate([np.frombuffer(p[0], "<u4") for p in parts] or [np.zeros(0, np.uint32)])
        lengths = np.concatenate([np.frombuffer(unzipped(p[1]), "<u4") for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64) // 2
        pool = np.frombuffer(b"".join(p[2] for p in parts), "<u2")
        starts = np.cumsum(lengths) - lengths
        by_rank = np.argsort(words)
        starts, lengths = starts[by_rank][sequence], lengths[by_rank][sequence]
        ids = pool[ragged(starts, lengths)].astype("<u4")
        counts = np.frombuffer(counts, "<i8")
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.table(
            {
                "doc_id": pa.array(np.frombuffer(doc_ids, "<i8"), pa.int64(), mask=np.frombuffer(null, bool)),
                "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
            }
        )

    docs = df.select(F.col(common.quoted(id_col)).cast("long").alias("id"), F.col(common.quoted(text_col)).alias("text"))
    words = docs.mapInArrow(split, "block long, bucket int, at long, size long, words binary").repartition(buckets, "bucket")
    return words.mapInArrow(encode, "block long, at long, size long, ids binary").groupBy("block").applyInArrow(join, "doc_id long, ids binary")


def token_table(spark: SparkSession, ranks: str | None = None) -> DataFrame:
    """The token-byte table: id, bytes. Its size is the vocabulary's, some 50,000 rows, whatever the documents are."""
    ranks = ranks or vocab.default_path("byte_bpe_multi_50k.tiktoken")
    found = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, open(ranks, "rb"))]
    return spark.createDataFrame(pa.table({"id": pa.array([k for k, _ in found], pa.int32()), "bytes": pa.array([t for _, t in found], pa.binary())}))


def decode_documents(df: DataFrame, ranks: str | None = None) -> DataFrame:
    """The bytes of each row's ids: doc_id, ids, decoded. Null ids are empty and decode to nothing.

    A block of rows is exploded into its distinct ids, each with its slot; the first carries the positions, as
    slots. The ids are joined with the token-byte table, which is broadcast: it has a row a token of the
    vocabulary. The join passes a partition's rows on in order, so a block is put together again by position
    as its slots come by, without a shuffle; slots out of order and ids without bytes are errors. Repeated
    and null document ids are rows of their own. Memory is bounded by a block or the longest row.
    """

    @common.frugal
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(1))
            for lo, hi in common.slices(offsets, IDS_BYTES):
                docs = batch.column(0)[lo:hi]
                ids, slots = np.unique(np.frombuffer(data[offsets[lo] : offsets[hi]].tobytes(), "<i4"), return_inverse=True)
                block = packed(np.array(docs.is_null()).tobytes(), docs.fill_null(0).to_numpy().astype("<i8").tobytes(), (np.diff(offsets[lo : hi + 1]) // 4).astype("<i8").tobytes(), slots.astype("<u4").tobytes())
                n = max(len(ids), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(ids)] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(ids if len(ids) else [None], pa.int32()), pa.array([block] + [None] * (n - 1), pa.binary())],
                    ["n", "slot", "id", "block"],
                )

    @common.frugal
    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, have, n = [], 0, 0
        for batch in batches:
            if batch.column("bytes").null_count != batch.column("id").null_count:
                raise ValueError("an id that the token-byte table doesn't have")
            slot, ids = batch.column("slot").to_numpy(), batch.column("id").fill_null(0).to_numpy().astype("<u4")
            data, offsets = common.text_bytes(batch.column("bytes"))
            cuts = sorted({0, *np.flatnonzero(slot == 0).tolist(), len(slot)})
            for lo, hi in zip(cuts, cuts[1:]):
                if slot[lo] == 0 and have == n:
                    block, n, have, parts = batch.column("block")[lo].as_py(), batch.column("n")[lo].as_py(), 0, []
                if not np.array_equal(slot[lo:hi], np.arange(have, have + hi - lo)) or have + hi - lo > max(n, 1):
                    raise ValueError("slots out of order")
                parts.append((ids[lo:hi], np.diff(offsets[lo : hi + 1]), data[offsets[lo] : offsets[hi]]))
                have += hi - lo
                if have >= n:
                    yield _positioned(block, *map(np.concatenate, zip(*parts)))
                    have, n = 0, 0
        if have != n:
            raise ValueError("a block without its last slots")

    rows = df.select("doc_id", "ids").mapInArrow(exploded, "n int, slot int, id int, block binary")
    joined = rows.join(F.broadcast(token_table(df.sparkSession, ranks)), "id", "left")
    return joined.select("n", "slot", "id", "block", "bytes").mapInArrow(together, "doc_id long, ids binary, decoded binary")


def _positioned(block: bytes, ids: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> pa.RecordBatch:
    """The documents of a block, from its positions and each slot's id and bytes."""
    null, docs, sizes, slots = unpacked(block)
    ends = np.cumsum(np.concatenate([[0], np.frombuffer(sizes, "<i8")]))
    slots, starts = np.frombuffer(slots, "<u4"), np.cumsum(lengths) - lengths
    out_ids, out_bytes = [], []
    for a, b in zip(ends, ends[1:]):
        own = slots[a:b]
        out_ids.append(ids[own].tobytes())
        some = (own[k : k + SOME_IDS] for k in range(0, len(own), SOME_IDS))
        out_bytes.append(b"".join(pool[ragged(starts[x], lengths[x])].tobytes() for x in some))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.frombuffer(docs, "<i8"), pa.int64(), mask=np.frombuffer(null, bool)), pa.array(out_ids, pa.binary()), pa.array(out_bytes, pa.binary())], ["doc_id", "ids", "decoded"]
    )


def bpe_digest(df: DataFrame) -> DataFrame:
    found = decode_documents(encode_documents(df))
    return found.selectExpr("doc_id", "CAST(length(ids) DIV 4 AS LONG) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")
