"""Removal of passages that an earlier document has, byte for byte: blockwise sorting of suffixes around a cover sample.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. Sorting
the suffixes of all texts would settle this, but a corpus has as many suffixes as bytes. So a cover sample is
taken that meets every string of 50 bytes, and suffixes are sorted a bucket at a time, ties by the ranks of
the sampled suffix that they reach:

1. Cover. Of the 35 16-byte strings in every string of 50 bytes the one with the least hash is taken.
   The choice depends on those 50 bytes alone, so two equal strings sample the same place: about one
   suffix in eighteen stands for all. (This takes the place of a periodic difference cover, which meets in
   every pair of strings too, but keeps one suffix in five; the README has what that comes to.)
2. Shared samples. Sampled 16-byte strings are dealt into buckets by hash; a bucket's task finds those
   that two documents share, by 48 bits of the hash. All others are done with.
3. Buckets. A shared sample goes with its 34 bytes before and after into its bucket. There the sampled
   suffixes are sorted, and so are the bytes before them, read backwards; both give ranks, and from the common
   prefixes of neighbours the classes of equal strings of every length. A suffix that starts some bytes before
   a sample is then settled by those bytes and, where they tie, by the rank of the sample: so the strings of
   50 bytes from each of the 35 places fall into classes, and each learns whether a smaller document has it.
4. Strings that occur very often, such as a line of a site's footer, would fill one bucket with all their
   surroundings. Their strings of 50 bytes go to buckets of their own names, of 128 bits, instead.

Documents are kept in blocks, compressed, in files of the shared folder, from which steps 2 and 3 read
them by offset, so that no text is shuffled. Equal surroundings leave a block once, with the least document
of the block that has them, after their bytes have been compared. Files are written under names of their own
and renamed, so lost executors do no harm; the input must be a table or another input that is read alike
each time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from deckhand.llm import common
from deckhand.llm.common import packed, ragged, unpacked, unzipped, zipped

#: Bytes of a string that counts, of a sampled string, and around it.
SPAN, GRAM = 50, 16
SIDE = SPAN - GRAM
WINDOW = SIDE + 1
WIDTH = SIDE + SPAN
BLOCK_BYTES = 8 << 20
#: Places whose hashes are held at a time; positions among them take the low bits of a key.
STEP = (1 << 20) - 64
LOW = np.uint64((1 << 20) - 1)
#: A string that occurs so often, as estimated within a factor of two, gets no bucket of its own.
OFTEN = 1 << 14
#: Contexts that are worked on at a time.
AT_ONCE = 50_000
#: Documents without an id come last.
NO_ID = (1 << 63) - 1

_rng = np.random.default_rng(50)
LETTERS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
ODD = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[4]
    x = (x ^ (x >> np.uint64(29))) * ODD[5]
    return x ^ (x >> np.uint64(32))


def _sliding_least(x: np.ndarray) -> np.ndarray:
    """The least of every WINDOW neighbours."""
    n = len(x) - WINDOW + 1
    wide = np.full(-(-len(x) // WINDOW) * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    wide[: len(x)] = x
    rows = wide.reshape(-1, WINDOW)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[WINDOW - 1 : WINDOW - 1 + n])


def samples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the sampled strings of a block of documents."""
    ends, lengths = offsets[1:], np.diff(offsets)
    whole = np.ones(len(data), bool)
    short = np.minimum(lengths, SPAN - 1)
    whole[ragged(ends - short, short)] = False
    places, hashes = [], []
    for lo in range(0, len(data) - SPAN + 1, STEP):
        x = data[lo : lo + STEP + SPAN - 1]
        h = LETTERS[x]
        for k, d in enumerate((1, 2, 4, 8)):
            h = h[:-d] * ODD[k] + h[d:]
        h = _mix(h)
        least = _sliding_least(h & ~LOW | np.arange(len(h), dtype=np.uint64))
        at = (least & LOW).astype(np.int64)[whole[lo : lo + len(least)]]
        if len(at):
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            places.append(at + lo)
            hashes.append(_mix(h[at] ^ ODD[7]))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _narrow(h: np.ndarray) -> bytes:
    """48 bits of each, in planes."""
    return b"".join((h >> np.uint64(k) & np.uint64(0xFFFF)).astype("<u2").tobytes() for k in (0, 16, 32))


def _wide(data: bytes) -> np.ndarray:
    low, mid, high = np.frombuffer(data, "<u2").astype(np.uint64).reshape(3, -1)
    return low | mid << np.uint64(16) | high << np.uint64(32)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def shared(rows: list[bytes], often_from: int = OFTEN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each block's strings (sorted), those that two documents have, and whether they occur very often.

    A string comes with a byte: whether several documents of the block have it, and twice the logarithm of its number there.
    """
    parts = [unpacked(r) for r in rows]
    hashes = [_wide(p[0]) for p in parts]
    h, notes = np.concatenate(hashes), np.concatenate([np.frombuffer(p[1], np.uint8) for p in parts])
    order = np.argsort(h)
    first = np.concatenate([[True], h[order][1:] != h[order][:-1]])[: len(h)]
    starts = np.flatnonzero(first)
    total = np.add.reduceat(np.exp2(notes[order] >> 1), starts)
    several = np.maximum.reduceat(notes[order] & 1, starts).astype(bool) | (np.diff(np.append(starts, len(h))) > 1)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(first) - 1
    keep, often = several[group], (total >= often_from)[group]
    ends = np.cumsum([len(x) for x in hashes])[:-1]
    return [(x[k], o[k]) for x, k, o in zip(hashes, np.split(keep, ends), np.split(often, ends))]


def contexts(data: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes around each place, how many of them its document has before and after, and its document."""
    doc = np.searchsorted(offsets, places, "right") - 1
    left = np.minimum(places - offsets[doc], SIDE)
    right = np.minimum(offsets[doc + 1] - places - GRAM, SIDE)
    padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SPAN, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[places]
    at = np.arange(WIDTH)
    around = np.where((at >= SIDE - left[:, None]) & (at < SPAN + right[:, None]), around, 0).astype(np.uint8)
    return around, left.astype(np.uint8), right.astype(np.uint8), doc


def names_of(around: np.ndarray) -> np.ndarray:
    total = np.zeros(len(around), np.uint64)
    for k in range(WIDTH):
        total = total * ODD[2] + LETTERS[around[:, k]]
    return _mix(total)


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and the common prefix of each with the one before it."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    order = np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])
    prefix = np.zeros(n, np.int64)
    for lo in range(1, n, 100_000):
        at = order[lo - 1 : lo + 100_000]
        differ = rows[at[1:]] != rows[at[:-1]]
        prefix[lo : lo + 100_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, prefix


def classes(order: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for rows whose first bytes are equal."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(prefix < length) - 1
    return out


def compared(around: np.ndarray, left: np.ndarray, right: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context a mask of the places from which 50 bytes are also in a context of a smaller document.

    Bytes that a context lacks are zeros; they take no part, as only places whose 50 bytes lie in it count.
    """
    by_doc = np.argsort(docs, kind="stable")
    around, left, right, docs = around[by_doc], left[by_doc].astype(np.int64), right[by_doc].astype(np.int64), docs[by_doc]
    masks = np.zeros(len(docs), np.uint64)
    suffixes, prefixes = ranked(around[:, SIDE:]), ranked(around[:, :SIDE][:, ::-1])
    for o in range(WINDOW):
        rows = np.flatnonzero((o >= SIDE - left) & (o <= right))
        n, d = (classes(*prefixes, SIDE - o) * len(docs) + classes(*suffixes, GRAM + o))[rows], docs[rows]
        order = np.argsort(n, kind="stable")
        first = np.concatenate([[True], n[order][1:] != n[order][:-1]])[: len(order)]
        least = d[order][first][np.cumsum(first) - 1]
        masks[rows[order[least < d[order]]]] |= np.uint64(1 << o)
    out = np.empty_like(masks)
    out[by_doc] = masks
    return out


def windows(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each place the contexts that have 50 bytes from there, and their names in two halves."""
    bases = [int(ODD[6]), int(ODD[3])]
    names, last = [], []
    for base in bases:
        name, power = np.zeros(len(around), np.uint64), 1
        for k in range(SPAN):
            name += LETTERS[around[:, k]] * np.uint64(power)
            power = power * base % (1 << 64)
        names.append(name)
        last.append(np.uint64(pow(base, SPAN - 1, 1 << 64)))
    for o in range(WINDOW):
        rows = np.flatnonzero((o >= SIDE - left.astype(np.int64)) & (o <= right))
        yield o, rows, _mix(names[0][rows]), _mix(names[1][rows])
        if o < WINDOW - 1:
            for k, base in enumerate(bases):
                names[k] = (names[k] - LETTERS[around[:, o]]) * np.uint64(pow(base, -1, 1 << 64)) + LETTERS[around[:, o + SPAN]] * last[k]


def repeated(first: np.ndarray, second: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a smaller document has a string of the same name."""
    order = np.lexsort((docs, second, first))
    new = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])[: len(order)]
    out = np.empty(len(docs), bool)
    out[order] = docs[order][new][np.cumsum(new) - 1] < docs[order]
    return out


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", often_from: int = OFTEN) -> DataFrame:
    """df without the repeated bytes, and n_bytes, n_removed, n_spans, spans, kept (the remaining bytes).

    The text column is the remaining bytes as text, without characters that were cut in part; ``kept``
    has them all. A null text counts as empty; texts under 50 bytes never change. Rows that repeat an id
    don't remove each other's text; rows without an id come after all others, and don't remove each
    other's text. Other columns stay; those named as new ones, in any case of letters, are replaced. An
    empty table stays empty.
    """
    spark = df.sparkSession
    new = ["n_bytes long", "n_removed long", "n_spans long", "spans array<struct<start:bigint,length:bigint>>", "kept binary"]
    df = df.select(*map(common.quoted, common.others(df, [x.split()[0] for x in new])))
    buckets, folder = max(common.shuffle_partitions(spark), common.input_bytes(df) >> 26), common.scratch(spark, "suffixes")
    id_at, text_at = df.columns.index(id_col), df.columns.index(text_col)

    def block_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = batch.column(id_at).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        return (*common.text_bytes(batch.column(text_at)), ids)

    def stored(block: int, at: int, size: int) -> pa.RecordBatch:
        fs, root = common.open_fs(folder)
        with fs.open_input_file(f"{root}/blocks-{block >> 32:07d}") as f:
            f.seek(at)
            return pa.ipc.open_stream(f.read(size)).read_next_batch()

    def rows_of(block: int, at: int, size: int, some: list[tuple[int, bytes]]) -> pa.RecordBatch:
        """The first row finds the block; it goes along, so that blocks without anything in common come out too."""
        n = 1 + len(some)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array([block % buckets, *(b for b, _ in some)], pa.int32()), pa.array([at] + [None] * (n - 1), pa.int64()), pa.array([size] + [None] * (n - 1), pa.int64()), pa.array([None, *(p for _, p in some)], pa.binary())],
            ["block", "bucket", "at", "size", "payload"],
        )

    @common.frugal
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(folder)
        pid = TaskContext.get().partitionId()
        own, f, at, k = f"{root}/.{uuid.uuid4().hex}", None, 0, 0
        for whole in batches:
            for lo, hi in common.slices(common.text_bytes(whole.column(text_at))[1], BLOCK_BYTES):
                batch = whole.slice(lo, hi - lo)
                data, offsets, ids = block_of(batch)
                if f is None:
                    fs.create_dir(root, recursive=True)
                    f = fs.open_output_stream(own, buffer_size=1 << 20)
                segment = _to_bytes(batch)
                f.write(segment)
                places, h = samples(data, offsets)
                h &= np.uint64((1 << 48) - 1)
                of = ids[np.searchsorted(offsets, places, "right") - 1]
                order = np.argsort(h, kind="stable")
                h, of = h[order], of[order]
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
                several = np.maximum.reduceat(of, starts) != np.minimum.reduceat(of, starts) if len(h) else np.zeros(0, bool)
                number = np.diff(np.append(starts, len(h)))
                notes = (several + 2 * np.ceil(np.log2(np.maximum(number, 1)))).astype(np.uint8)
                h = h[starts]
                some = [(b, packed(_narrow(h[own_]), notes[own_].tobytes())) for b, own_ in _by_bucket(_bucket(h, buckets), buckets)]
                yield rows_of(pid << 32 | k, at, len(segment), some)
                at, k = at + len(segment), k + 1
        if f is not None:
            f.close()
            common.publish(fs, own, f"{root}/blocks-{pid:07d}")

    @common.frugal_group
    def met(key: tuple, table: pa.Table) -> pa.Table:
        payload = table.column("payload").to_pylist()
        some = [k for k, p in enumerate(payload) if p is not None]
        out: list = [None] * len(payload)
        for k, (h, often) in zip(some, shared([payload[k] for k in some], often_from) if some else ()):
            out[k] = packed(_narrow(h), often.tobytes()) if len(h) else None
        return table.set_column(4, "payload", pa.array(out, pa.binary()))

    @common.frugal_group
    def gather(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        rows = table.to_pylist()
        at, size = next((r["at"], r["size"]) for r in rows if r["at"] is not None)
        parts = [unpacked(r["payload"]) for r in rows if r["payload"] is not None]
        wanted, often = [_wide(p[0]) for p in parts], [_wide(p[0])[np.frombuffer(p[1], bool)] for p in parts]
        data, offsets, ids = block_of(stored(block, at, size))
        places, h = samples(data, offsets) if wanted else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        h &= np.uint64((1 << 48) - 1)
        keep = np.isin(h, np.concatenate(wanted)) if wanted else np.zeros(0, bool)
        places, h, some = places[keep], h[keep], []
        fs, root = common.open_fs(folder)
        kind, least = np.zeros(len(places), np.int64), np.zeros(0, np.int64)
        if len(places):
            names, of = np.empty(len(places), np.uint64), np.empty(len(places), np.int64)
            for lo in range(0, len(places), AT_ONCE):
                around, left, right, doc = contexts(data, offsets, places[lo : lo + AT_ONCE])
                names[lo : lo + AT_ONCE] = names_of(around) + _mix(left.astype(np.uint64) << np.uint64(8) | right)
                of[lo : lo + AT_ONCE] = ids[doc]
            order = np.lexsort((of, names))
            first = np.concatenate([[True], names[order][1:] != names[order][:-1]])
            kind[order] = np.cumsum(first) - 1
            chosen, least = order[first], of[order[first]]
            like, unlike = order[~first], []
            for lo in range(0, len(like), AT_ONCE):
                x, y = (contexts(data, offsets, places[at[lo : lo + AT_ONCE]])[:3] for at in (like, chosen[kind[like]]))
                unlike.append(like[lo : lo + AT_ONCE][(x[0] != y[0]).any(axis=1) | (x[1] != y[1]) | (x[2] != y[2])])
            if unlike and len(unlike := np.concatenate(unlike)):  # equal names of different bytes
                kind[unlike] = len(chosen) + np.arange(len(unlike))
                chosen, least = np.append(chosen, unlike), np.append(least, of[unlike])
            dealt = np.isin(h[chosen], np.concatenate(often))
            plain = np.flatnonzero(~dealt)
            for b, own_ in _by_bucket(_bucket(h[chosen[plain]], buckets), buckets):
                own_ = plain[own_]
                around, left, right, _ = contexts(data, offsets, places[chosen[own_]])
                some.append((b, packed(b"c", own_.astype("<u4").tobytes(), least[own_].astype("<i8").tobytes(), left.tobytes(), right.tobytes(), zipped(around))))
            dealt = np.flatnonzero(dealt)
            for lo in range(0, len(dealt), AT_ONCE):
                own_ = dealt[lo : lo + AT_ONCE]
                around, left, right, _ = contexts(data, offsets, places[chosen[own_]])
                found = [(own_[rows], np.full(len(rows), o, np.uint8), n1, n2) for o, rows, n1, n2 in windows(around, left, right)]
                kinds, at_, n1, n2 = (np.concatenate(x) for x in zip(*found))
                for b, w in _by_bucket(_bucket(n1, buckets), buckets):
                    some.append((b, packed(b"w", kinds[w].astype("<u4").tobytes(), least[kinds[w]].astype("<i8").tobytes(), at_[w].tobytes(), n1[w].tobytes(), n2[w].tobytes())))
        note, own = f"{root}/places-{block}", f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(packed(zipped(places.astype("<u4")), zipped(kind.astype("<u4")), zipped(least.astype("<i8"))))
        common.publish(fs, own, note)
        return pa.Table.from_batches([rows_of(block, at, size, some)])

    @common.frugal_group
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        payload = [p and unpacked(p) for p in table.column("payload").to_pylist()]
        out: list = [None] * len(payload)
        of = lambda kind: [(k, p[1:]) for k, p in enumerate(payload) if p and p[0] == kind]
        column = lambda some, k, t: np.frombuffer(b"".join(p[k] for _, p in some), t)
        if some := of(b"c"):
            around = np.frombuffer(b"".join(unzipped(p[4]) for _, p in some), np.uint8).reshape(-1, WIDTH)
            masks = compared(around, column(some, 2, np.uint8), column(some, 3, np.uint8), column(some, 1, "<i8"))
            for (k, p), m in zip(some, np.split(masks, np.cumsum([len(p[2]) for _, p in some])[:-1])):
                out[k] = packed(b"c", p[0], zipped(m))
        if some := of(b"w"):
            gone = repeated(column(some, 3, np.uint64), column(some, 4, np.uint64), column(some, 1, "<i8"))
            for (k, p), g in zip(some, np.split(gone, np.cumsum([len(p[2]) for _, p in some])[:-1])):
                out[k] = packed(b"w", np.frombuffer(p[0], "<u4")[g].tobytes(), np.frombuffer(p[2], np.uint8)[g].tobytes()) if g.any() else None
        return table.set_column(4, "payload", pa.array(out, pa.binary()))

    @common.frugal_group
    def remove(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        rows = table.to_pylist()
        at, size = next((r["at"], r["size"]) for r in rows if r["at"] is not None)
        batch = stored(block, at, size)
        data, offsets, ids = block_of(batch)
        fs, root = common.open_fs(folder)
        with fs.open_input_file(f"{root}/places-{block}") as f:
            places, kind, least = (np.frombuffer(unzipped(p), t).astype(np.int64) for p, t in zip(unpacked(f.read()), ("<u4", "<u4", "<i8")))
        masks = np.zeros(len(least), np.uint64)
        for r in rows:
            if r["payload"] is not None:
                what, kinds, m = unpacked(r["payload"])
                kinds = np.frombuffer(kinds, "<u4")
                if what == b"c":
                    masks[kinds] = np.frombuffer(unzipped(m), np.uint64)
                else:
                    np.bitwise_or.at(masks, kinds, np.uint64(1) << np.frombuffer(m, np.uint8).astype(np.uint64))
        edges = np.zeros(len(data) + 1, np.int32)
        if len(places):
            doc = np.searchsorted(offsets, places, "right") - 1
            left = np.minimum(places - offsets[doc], SIDE)
            right = np.minimum(offsets[doc + 1] - places - GRAM, SIDE)
            later = (ids[doc] > least[kind]) & (left + right >= SIDE)
            np.add.at(edges, (places - left)[later], 1)
            np.add.at(edges, (places + right + GRAM)[later], -1)
            others = np.flatnonzero((ids[doc] <= least[kind]) & (masks[kind] != 0))
            for o in range(WINDOW):
                starts = places[others[masks[kind[others]] >> np.uint64(o) & np.uint64(1) == 1]] - SIDE + o
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + SPAN, -1)
        gone = np.cumsum(edges[:-1]) > 0
        before = np.concatenate([[False], gone[:-1]])
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        starts = np.flatnonzero(gone & ~before)
        after = np.concatenate([gone[1:], [False]])
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        ends = np.flatnonzero(gone & ~after) + 1
        cuts = np.searchsorted(starts, offsets)
        totals = np.concatenate([[0], np.cumsum(gone)])
        kept = data[~gone].tobytes()
        kept_at = offsets - totals[offsets]
        kept = [kept[a:b] for a, b in zip(kept_at[:-1], kept_at[1:])]
        doc = np.repeat(np.arange(len(ids)), np.diff(cuts))
        spans = pa.ListArray.from_arrays(
            pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - offsets[doc], pa.int64()), pa.array(ends - starts, pa.int64())], ["start", "length"])
        )
        columns = [c if k != text_at else pa.array([b.decode(errors="ignore") for b in kept], pa.string()) for k, c in enumerate(batch.columns)]
        columns += [pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(totals[offsets]), pa.int64()), pa.array(np.diff(cuts), pa.int64()), spans, pa.array(kept, pa.binary())]
        return pa.table(columns, names=[*batch.schema.names, *(x.split()[0] for x in new)])

    schema = "block long, bucket int, at long, size long, payload binary"
    rows = df.mapInArrow(cover, schema).groupBy("bucket").applyInArrow(met, schema).groupBy("block").applyInArrow(gather, schema)
    masks = rows.groupBy("bucket").applyInArrow(compare, schema)
    return masks.groupBy("block").applyInArrow(remove, ", ".join([common.ddl(df, df.columns), *new]))


def repeat_digest(df: DataFrame) -> DataFrame:
    return remove_repeats(df.select("doc_id", "text")).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")
