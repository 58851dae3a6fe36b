"""Packing of examples into training sequences, as vector bin packing.

An example is a vector: tokens, segments (one) and loss-bearing tokens; a sequence has a limit on
each. Sequences are filled one after another. Of the examples that still fit, the one with the
largest dot product of its demand and the sequence's remaining capacity, both as shares of the
limits, goes next; so a sequence that is short of one resource takes examples that use little of it.
Where examples may be cut, demands are scaled to length one, since the segment that each needs would
otherwise leave the order to the tokens alone: what goes next has the direction of what is left, so that
tokens and segments run out together. Examples after which the segments left couldn't fill the sequence
wait while others can.

Packing goes through each partition's rows in windows of bounded size, so it needs no shuffle and a
lost task is simply run again with the same result. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckhand.llm import common, vocab

#: Fixed value: the id that ends each document.
END_ID = 2


@dataclass(frozen=True)
class Limits:
    """Of one sequence; a window holds so many examples or tokens at most before it is packed."""

    tokens: int = 4096
    segments: int = 1024
    loss_tokens: int = 4096
    window: int = 2048
    window_tokens: int = 8 << 20


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, length), for examples that each fit a sequence.

    With ``cut``, an example may be cut where a sequence ends, which then has no padding; a cut piece
    counts all its tokens as loss-bearing at most. A sequence that the other limits close before its tokens
    are full, and what is left at the end, are cut to sequences whose lengths are powers of two. Without
    ``cut`` what is left at the end is one last sequence.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
    demand = np.column_stack([tokens, np.ones(len(tokens)), loss]).astype(np.float64)
    ids, start = np.arange(len(tokens)), np.zeros(len(tokens), np.int64)
    # Largest first, so that of equal dot products the first is the largest, then the earliest.
    order = np.lexsort((ids, -demand[:, 0]))
    demand, ids = demand[order], ids[order]
    scaled = _unit if cut else np.asarray
    share = scaled(demand / cap)
    need, bears = demand[:, 0].copy(), demand[:, 2].copy()
    alive = np.ones(len(ids), bool)
    done: list[list[tuple[int, int, int]]] = []
    rest, current = cap.copy(), []
    left = len(ids)
    while left:
        open_to = alive & _fillable(need, alive, rest) if cut else alive
        score = share @ (rest / cap)
        fits = open_to & (need <= rest[0]) & (bears <= rest[2]) & (rest[1] >= 1)
        if fits.any():
            k = int(np.argmax(np.where(fits, score, -1.0)))
            current.append((int(ids[k]), int(start[ids[k]]), int(need[k])))
            rest -= (need[k], 1, bears[k])
            alive[k] = False
            left -= 1
            if rest[0] > 0:
                continue
        elif cut and min(rest) >= 1:
            k = int(np.argmax(np.where(open_to, score, -1.0)))
            n = int(min(rest[0], rest[2]))
            if n < need[k]:
                current.append((int(ids[k]), int(start[ids[k]]), n))
                start[ids[k]] += n
                need[k] -= n
                bears[k] = min(bears[k], need[k])
                share[k] = scaled(np.array([need[k], 1, bears[k]]) / cap)
                rest[0] -= n
        done += powers_of_two(current) if cut and rest[0] > 0 else [current]
        rest, current = cap.copy(), []
        if 8 * left < 7 * len(ids):
            # What is placed need not be looked at again; the order stays.
            need, bears, share, ids = need[alive], bears[alive], share[alive], ids[alive]
            alive = np.ones(left, bool)
    if current:
        done += powers_of_two(current) if cut else [current]
    return [s for s in done if s]


def _fillable(tokens: np.ndarray, alive: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Examples after which the segments that are left can still fill the sequence, if any can; else all."""
    m = int(rest[1])
    most = np.argpartition(np.where(alive, -tokens, 0), min(m, len(tokens)) - 1)[:m] if m else np.zeros(0, int)
    most = most[alive[most]]
    total = tokens[most].sum()
    if not m or total < rest[0]:
        return np.ones(len(tokens), bool)
    found = tokens + total - (tokens[most].min() if len(most) == m else 0) >= rest[0]
    found[most] = True
    return found


def _unit(share: np.ndarray) -> np.ndarray:
    return share / np.linalg.norm(share, axis=-1, keepdims=True)


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same pieces in order, cut into sequences whose lengths are the powers of two of their sum."""
    total, done, pieces = sum(p[2] for p in pieces), [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        room, current = total & 1 << bit, []
        while room:
            e, s, n = pieces.pop()
            take = min(n, room)
            current.append((e, s, take))
            room -= take
            if take < n:
                pieces.append((e, s + take, n - take))
        if current:
            done.append(current)
    return done


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """Places whole examples: example_id, sequence_id, offset, tokens, loss_tokens.

    For instruction data, where an example must not be cut. Null or negative counts are 0; an example
    beyond a limit by itself gets a sequence of its own, so none is lost. Equal rows are placed each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, sequence = TaskContext.get().partitionId(), 0
        for rows in _windows(((i, max(t or 0, 0), max(s or 0, 0)) for b in batches for i, t, s in zip(*(c.to_pylist() for c in b.columns))), limits):
            out: list[tuple] = []
            fit = [r for r in rows if r[1] <= limits.tokens and r[2] <= limits.loss_tokens]
            bins = [[(r, 0, r[1])] for r in rows if r[1] > limits.tokens or r[2] > limits.loss_tokens]
            placed = place(np.array([r[1] for r in fit]), np.array([r[2] for r in fit]), limits, cut=False)
            bins += [[(fit[e], s, n) for e, s, n in b] for b in placed]
            for b in bins:
                at = 0
                for r, _, n in b:
                    out.append((r[0], pid << 32 | sequence, at, n, r[2]))
                    at += n
                sequence += 1
            yield _batch(out, schema)

    ids = df.schema[id_col].dataType
    kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[{"bigint": "long"}.get(ids.simpleString(), ids.simpleString())]
    schema = pa.schema([("example_id", kind), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.int64()), ("loss_tokens", pa.int64())])
    picked = df.select(F.col(common.quoted(id_col)).alias("i"), F.col(common.quoted(tokens_col)).cast("long").alias("t"), F.col(common.quoted(loss_col)).cast("long").alias("s"))
    return picked.mapInArrow(run, f"example_id {ids.simpleString()}, sequence_id long, offset long, tokens long, loss_tokens long")


def _windows(rows: Iterator[tuple], limits: Limits) -> Iterator[list[tuple]]:
    kept, n = [], 0
    for r in rows:
        kept.append(r)
        n += r[1]
        if len(kept) >= limits.window or n >= limits.window_tokens:
            yield kept
            kept, n = [], 0
    if kept:
        yield kept


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: Of sequences made of documents: few enough segments that this limit closes most sequences, beside the tokens.
DOCUMENT_LIMITS = Limits(segments=8)

#: The result's columns; ids are little-endian unsigned 32-bit integers.
PIECES = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
)


def pack_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limits: Limits = DOCUMENT_LIMITS, with_ids: bool = True) -> DataFrame:
    """Encodes every document, ends it with an id, and packs all ids into sequences; documents may be cut.

    One row a piece: doc_id, start (in its document), length, ids_crc32, doc_tokens, sequence_id,
    offset (in its sequence), ids. Every id lies in exactly one piece. Whole multiples of the limit
    fill sequences by themselves; the remainders are packed, so that all sequences but the last few of
    a window are full and those are as long as a power of two; none has more pieces than the limit on segments,
    if the window's documents are all tiny too. A null text is empty and has the end id
    alone; a null id stays null; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored. A document's first token bears no loss, as nothing of it comes before. ``ids``
    is left out on demand, which spares its transfer.
    """
    tokenizer = tokenizer or vocab.default_path("word_bpe_49k.json")
    size = min(limits.tokens, limits.loss_tokens)
    end = np.array([END_ID], "<u2").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = vocab.encoder(tokenizer, False).packed
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = encode(text.as_py() or "") + end
                yield doc_id, len(packed) // 2, packed

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, sequence = TaskContext.get().partitionId(), 0
        for docs in _windows(encoded(batches), limits):
            out: list[tuple] = []
            bins = [[(e, s, size)] for e, d in enumerate(docs) for s in range(0, d[1] - size + 1, size)]
            rest = [(e, d[1] % size) for e, d in enumerate(docs) if d[1] % size]
            lengths = np.array([n for _, n in rest], np.int64)
            loss = lengths - np.array([docs[e][1] == n for e, n in rest], np.int64)
            for b in place(lengths, loss, limits, cut=True):
                bins.append([(rest[k][0], docs[rest[k][0]][1] - rest[k][1] + s, n) for k, s, n in b])
            for b in bins:
                at = 0
                for e, s, n in b:
                    doc_id, total, packed = docs[e]
                    ids = np.frombuffer(packed, "<u2", n, 2 * s).astype("<u4").tobytes()
                    out.append((doc_id, s, n, zlib.crc32(ids), total, pid << 32 | sequence, at, ids)[:width])
                    at += n
                sequence += 1
                if len(out) >= 1024:
                    yield _batch(out, pieces)
                    out = []
            yield _batch(out, pieces)
        vocab.forget()

    width = len(PIECES) if with_ids else len(PIECES) - 1
    pieces = pa.schema(list(PIECES)[:width])
    docs = df.select(F.col(common.quoted(id_col)).cast("long").alias("id"), F.col(common.quoted(text_col)).alias("text"))
    return docs.mapInArrow(run, ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in pieces))


def pack_documents(df: DataFrame) -> DataFrame:
    return pack_tokens(df, with_ids=False)


def conversation_lengths(turns: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """conv_id, tokens, loss_tokens of every conversation: each turn's ids and its end id, of which those of the assistant bear loss.

    A null text is empty and has the end id alone; a turn without a role bears no loss; repeated turns count
    each; turns without a conversation make up one without an id. Turns are encoded where they are, and only
    their sums are shuffled, so that a long conversation is no hot key.
    """
    tokenizer = tokenizer or vocab.default_path("word_bpe_49k.json")

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocab.encoder(tokenizer, False).packed
        for batch in batches:
            sizes = pa.array([len(encode(t.as_py() or "")) // 2 + 1 for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["conv_id", "role", "tokens"])
        vocab.forget()

    picked = turns.select(F.col(common.quoted(conv_col)).alias("conv_id"), F.col(common.quoted(role_col)).alias("role"), F.col(common.quoted(text_col)).alias("text"))
    sized = picked.mapInArrow(run, f"{common.ddl(picked, ['conv_id', 'role'])}, tokens long")
    return sized.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("tokens"))), F.lit(0)).alias("loss_tokens"))


def pack_conversations(turns: DataFrame, limits: Limits = Limits(segments=64, loss_tokens=2048)) -> DataFrame:
    """Instruction data: whole conversations placed under limits on tokens, on conversations and on the assistant's tokens of a sequence."""
    return pack_examples(conversation_lengths(turns), "conv_id", "tokens", "loss_tokens", limits).withColumnRenamed("example_id", "conv_id")
