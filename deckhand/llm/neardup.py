"""Near-duplicates: MinHash signatures, joined by a multi-index search in Hamming space.

A document's set of five-word shingles gets a signature of 120 slots of 16 bits, each the low bits of one
minimum hash, so the share of equal slots estimates the sets' similarity. The signature is cut into 20
chunks of six slots. Two signatures that differ in at most 39 slots have, by the pigeonhole principle, a
chunk with one error at most; so each chunk is filed six times, each time without one slot, and every
such pair meets under one key at least. A pair at similarity 0.75 misses all 20 chunks with probability
2.4e-7, however far its signatures are apart; pairs that share a passage only, at 0.2, rarely meet.

Documents with equal sets, by 128-bit names, are one node from the start. Pairs that meet are confirmed on
the full sets in rounds, so that a group of n copies costs about n comparisons and not n squared:

1. a node with the weightiest node of its keys (of those the one it shares most keys with). A node weighs
   as much as all its keys have nodes; in a group of copies that is the text they were made from, or near;
2. a node that wasn't like that one with all nodes that are linked to it by now, for it was near them;
3. where a key still holds several components: signatures of nodes outside its largest one are compared with
   those of other components, and where some are within 56 slots (30 are expected at similarity 0.75, and 5.5
   deviations more are 56) a node is confirmed with the nearest of each component;
4. nodes that are still apart from a component that they came near to with all nodes of it. After this no
   pair that meets within the distance is left out.

Nodes that share a template but are not alike cost a comparison of signatures where they share a key, in
tiles of bounded size, and never make up a family that is compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckhand.llm import common
from deckhand.llm.components import components, merged, rooted

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
CHUNKS, CHUNK = 20, 6
SLOTS = CHUNKS * CHUNK
#: Slots that may differ in the last round.
DISTANCE = 56
REMEMBERED = 300_000
#: Nodes and shingles in a tile at most, as far as dealing by hash keeps to it; a larger set stands for itself.
TILE, TILE_SHINGLES = 1000, 1 << 20
#: Pairs of signatures compared at a time, and bytes of text.
AT_ONCE, SLICE_BYTES = 50_000, 2 << 20

_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
#: Multipliers for the words of a shingle, in order.
PLACES = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For keys: multipliers of a chunk's slots, and what tells apart the chunks and the slots left out.
PLACED = _rng.integers(1, 1 << 63, CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WAYS = _rng.integers(0, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64)
WAY_BITS = np.uint64(127)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes; fewer words than five are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_words.__getitem__, words)), np.uint64)
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(h))):
        total += _mix(h[k : k + n] * PLACES[k])
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(SLOTS, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(s), 2048):
        np.minimum(least, (s[None, lo : lo + 2048] * MULTIPLIERS[:, None] + ADDENDS[:, None]).min(axis=1), out=least)
    # The high bits of a minimum are small; bits from the middle are even.
    return (_mix(least) >> np.uint64(20) & np.uint64(0xFFFF)).astype("<u2")


def _names(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell apart sets."""
    first, second = _mix(s + np.uint64(0x9E3779B97F4A7C15)), _mix(s * MULTIPLIERS[0] + ADDENDS[0])
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (first, second))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(common.quoted(id_col)).cast("long").alias("id"), F.col(common.quoted(text_col)).alias("text"))


def describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, f1, f2 (equal for equal sets; null for empty ones), signature."""

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in common.slices(common.text_bytes(whole.column(1))[1], SLICE_BYTES):
                sets = [shingles(t.as_py()) for t in whole.column(1)[lo:hi]]
                names = [_names(s) if len(s) else (None, None) for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([n[k] for n in names], pa.int64()) for k in (0, 1))]
                columns.append(pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays([whole.column(0)[lo:hi], *columns], ["doc_id", "n_shingles", "f1", "f2", "signature"])
        _words.clear()

    return _documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, signature binary")


def keys(nodes: DataFrame) -> DataFrame:
    """key, node: each chunk without each of its slots, as a name of the other slots whose low bits say which chunk and slot."""

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                data, _ = common.text_bytes(batch.column(1))
                chunks = data.view("<u2").reshape(-1, CHUNKS, CHUNK).astype(np.uint64) * PLACED
                whole_chunk = chunks.sum(axis=2, dtype=np.uint64)
                out = _mix(whole_chunk[:, :, None] - chunks + WAYS) & ~WAY_BITS | np.arange(SLOTS, dtype=np.uint64).reshape(CHUNKS, CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out.ravel().astype(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), SLOTS))], ["key", "node"]
                )

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def sets(df: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, hashes (sorted, 48 bits in three 16-bit planes) of wanted: node, f1, f2, wanted (an id that has this set)."""

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in common.slices(common.text_bytes(whole.column(1))[1], SLICE_BYTES):
                found = [shingles(t.as_py()) for t in whole.column(1)[lo:hi]]
                found = [(*_names(s), _planes(s)) for s in found if len(s)]
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["f1", "f2", "hashes"])
        _words.clear()

    docs = _documents(df, id_col, text_col)
    made = docs.join(wanted.select("wanted"), docs.id.eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(run, "f1 long, f2 long, hashes binary")
    return made.join(wanted.select("f1", "f2", "node"), ["f1", "f2"]).dropDuplicates(["f1", "f2"]).select("node", "hashes")


def _planes(s: np.ndarray) -> bytes:
    h = s >> np.uint64(16)
    return b"".join((h >> np.uint64(k) & np.uint64(0xFFFF)).astype("<u2").tobytes() for k in (0, 16, 32))


def _unplaned(data: bytes) -> np.ndarray:
    low, mid, high = np.frombuffer(data, "<u2").astype(np.uint64).reshape(3, -1)
    return low | mid << np.uint64(16) | high << np.uint64(32)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common_ = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common_ >= percent * (len(both) - common_)


def confirmed(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """Those of the written pairs (a, b) whose full sets are similar enough.

    A node's set goes once to all its partners and not to each, and partners of one node are parted where
    they are many.
    """

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, None
        for batch in batches:
            a, chunk, b = (c.to_pylist() for c in batch.columns[:3])
            keep = []
            for k, (x, c, y) in enumerate(zip(a, chunk, b)):
                data = batch.column(3)[k].as_py()
                if y is None:
                    of, own = (x, c), _unplaned(data)
                elif of == (x, c) and linked(own, _unplaned(data), percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for k in keep], pa.int64()) for v in (a, b)], ["a", "b"])

    many = common.written(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > TILE).selectExpr("a", f"CAST(ceil(n / {TILE}) AS INT) AS chunks"), "many")
    parted = pairs.select("a", "b").join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "chunks").cast("int"), F.lit(0)).alias("chunk"))
    partners = parted.join(hashes.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "hashes")
    owners = parted.select("a", "chunk").distinct().join(hashes.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "hashes")
    dealt = owners.union(partners).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _open_keys(star: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root, and of its key major (the largest component), n and asks (its nodes, and those outside it), where a key holds several components."""
    rows = rooted(star.select("key", "node"), roots, "node", "root")
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    several = common.written(several.selectExpr("key", "major", "n", "n - most AS asks"), "open")
    return rows.join(several, "key")


def links(df: DataFrame, nodes: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, root of all linked nodes. nodes: node, f1, f2, wanted, n_shingles, signature."""
    filed = keys(nodes)
    several = common.written(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    star = common.written(filed.join(several, "key"), "star")
    weights = star.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = common.written(star.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub")), "hubs")
    shared = star.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    pairs = common.written(shared.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")), "pairs")
    met = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
    hashes = common.written(sets(df, nodes.join(met, "node", "left_semi").select("node", "f1", "f2", "wanted"), id_col, text_col), "sets")
    common.dropped(several, hubs)

    first = common.written(confirmed(pairs.selectExpr("hub AS a", "node AS b"), hashes, percent), "links")
    roots = common.written(components(first), "roots")

    tried = rooted(rooted(pairs, roots, "node", "own"), roots, "hub", "family")
    tried = common.written(tried.select("node", "own", F.when(F.col("own") != F.col("family"), F.col("family")).alias("family")), "tried")
    joined = common.written(_with_families(tried.where("family IS NOT NULL"), roots, nodes, hashes, percent), "links")
    roots2 = merged(roots, joined)

    # Of a node: its root after the first round, and the component that it has been compared with.
    past = nodes.select("node", "signature").join(tried.select("node", "own", "family"), "node", "left")
    near = common.written(_near(_open_keys(star, roots2).join(past, "node")), "near")
    last = roots2
    if not near.isEmpty():
        last = merged(roots2, common.written(confirmed(near.select("a", "b"), hashes, percent), "links"))
        apart = rooted(rooted(near.select("a", "family"), last, "a", "p"), last, "family", "q").where("p <> q")
        rest = common.written(apart.select(F.col("a").alias("node"), "family"), "rest")
        if not rest.isEmpty():
            alone = rest.select("family").distinct().join(roots2.select(F.col("root").alias("family")), "family", "left_anti").select(F.col("family").alias("node"), F.col("family").alias("root"))
            last = merged(last, common.written(_with_families(rest, roots2.union(alone), nodes, hashes, percent), "links"))
        common.dropped(rest)
    common.dropped(star, pairs, tried, near, hashes)
    return last


def _with_families(asking: DataFrame, roots: DataFrame, nodes: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between a node and the component, its family, that it asks to join; one at most for each.

    asking: node, family. A family is cut into tiles, and so are those who ask; a pair of tiles is one task,
    and each set goes to its tiles once.
    """
    size = nodes.select("node", "n_shingles")
    wanted = asking.join(size, "node").groupBy("family").agg(F.count("*").alias("asks"), F.sum("n_shingles").alias("asked"))
    members = roots.withColumnRenamed("root", "family").join(wanted.select("family"), "family", "left_semi").join(size, "node")
    held = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    tiles = lambda n, shingles: F.ceil(F.greatest(F.col(n) / TILE, F.col(shingles) / TILE_SHINGLES)).cast("int")
    plan = common.written(wanted.join(held, "family").select("family", tiles("n", "shingles").alias("tiles"), tiles("asks", "asked").alias("probes")), "families")
    tile = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = members.select("family", "node").join(plan, "family").join(hashes, "node").select("node", "family", "hashes", tile("tiles", 1).alias("tile"), every("probes").alias("probe"), F.lit(False).alias("asks"))
    asks = asking.select("family", "node").join(plan, "family").join(hashes, "node").select("node", "family", "hashes", every("tiles").alias("tile"), tile("probes", 2).alias("probe"), F.lit(True).alias("asks"))

    @common.frugal_group
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        asking_ = table.column("asks").to_numpy()
        nodes_ = table.column("node").to_numpy()
        here, a, b = np.flatnonzero(~asking_), [], []
        if len(here) and asking_.any():
            found = [_unplaned(table.column("hashes")[int(k)].as_py()) for k in here]
            sizes = np.array([len(x) for x in found], np.int64)
            all_, owner = np.concatenate(found), np.repeat(np.arange(len(here)), sizes)
            order = np.argsort(all_, kind="stable")
            all_, owner = all_[order], owner[order]
            for k in np.flatnonzero(asking_):
                own = _unplaned(table.column("hashes")[int(k)].as_py())
                lo, hi = np.searchsorted(all_, own, "left"), np.searchsorted(all_, own, "right")
                both = np.bincount(owner[common.ragged(lo, hi - lo)], minlength=len(here))
                near = 100 * both >= percent * (len(own) + sizes - both)
                if near.any():
                    a.append(int(nodes_[k]))
                    b.append(int(nodes_[here][near].min()))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return kept.union(asks).groupBy("family", "tile", "probe").applyInArrow(meet, "a long, b long")


def _near(rows: DataFrame) -> DataFrame:
    """Of a node a and another component, its family, that come within the distance under an open key, the nearest node b at d.

    Pairs that have been compared don't count. rows: key, node, root, major, n, asks, signature, own, family. A node outside its key's largest component
    asks all others of the key; keys are cut into tiles as families are.
    """
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    tile = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), tiles(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), tiles(n) - 1))
    one, asking = (tiles("n") == 1) & (tiles("asks") == 1), F.col("root") != F.col("major")
    columns = ["key", "node", "root", "major", "signature", F.coalesce("own", "node").alias("own"), F.coalesce("family", F.lit(-1)).alias("family")]
    # Role: 0 is asked, 1 asks, 2 does both, which only keys of one tile need.
    kept = rows.select(*columns, every("asks").alias("i"), tile("n", 3).alias("j"), F.when(one & asking, 2).otherwise(0).alias("role"))
    asks = rows.where(asking & ~one).select(*columns, tile("asks", 4).alias("i"), every("n").alias("j"), F.lit(1).alias("role"))

    def nearest(found: np.ndarray) -> np.ndarray:
        found = found[:, np.lexsort(found[::-1])]
        return found[:, np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0)])[: found.shape[1]]]

    def compared(t: pa.Table) -> pa.RecordBatch:
        key, i, j, node, root, major, own, family, role = (t.column(c).to_numpy() for c in ("key", "i", "j", "node", "root", "major", "own", "family", "role"))
        sig = common.text_bytes(t.column("signature"))[0].view("<u2").reshape(-1, SLOTS)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(key))
        group = np.cumsum(new) - 1
        asking_ = np.flatnonzero(role > 0)
        lo, size = starts[group[asking_]], (ends - starts)[group[asking_]]
        upto, out, at = np.cumsum(size), [], 0
        while at < len(asking_):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            x, y = np.repeat(asking_[at:to], size[at:to]), common.ragged(lo[at:to], size[at:to])
            some = (role[y] != 1) & (root[x] != root[y]) & ((root[y] == major[y]) | (node[x] < node[y])) & (own[y] != family[x]) & (own[x] != family[y])
            x, y = x[some], y[some]
            errors = (sig[x] != sig[y]).reshape(-1, CHUNKS, CHUNK)
            by_chunk = np.count_nonzero(errors, axis=2)
            d = by_chunk.sum(axis=1)
            # A pair meets under many keys; it counts under the first of them only.
            c = (by_chunk <= 1).argmax(axis=1)
            way = c * CHUNK + errors[np.arange(len(c)), c].argmax(axis=1)
            close = (d <= DISTANCE) & (key[x] & int(WAY_BITS) == way)
            out.append(nearest(np.stack([node[x], root[y], d, node[y]])[:, close]))
            at = to
        found = nearest(np.concatenate(out, axis=1)) if out else np.zeros((4, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in found], ["a", "family", "d", "b"])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups stand one after another; the last one of a batch may go on in the next."""
        left: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
            last = [t.column(c)[-1] for c in ("key", "i", "j")] if t.num_rows else None
            if last is None:
                continue
            same = np.logical_and.reduce([t.column(c).to_numpy() == v.as_py() for c, v in zip(("key", "i", "j"), last)])
            n = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if n:
                yield compared(t.slice(0, n).combine_chunks())
            left = t.slice(n).combine_chunks()
        if left is not None:
            yield compared(left)

    dealt = kept.unionByName(asks).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.mapInArrow(run, "a long, family long, d long, b long")
    return found.groupBy("a", "family").agg(F.min(F.struct("d", "b")).alias("n")).select("a", "family", F.col("n.b").alias("b"))


def near_duplicates(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept.

    Words are runs of anything but ASCII white space, after lower-casing A-Z. A null or empty text has
    no shingles and is linked with nothing; fewer than five words are one shingle. Rows that repeat an
    id get a row each; a null id counts as no id, so a component of such rows only has a null id. Of a
    component the document with its id is kept. Other columns are ignored; an empty table gives no rows.
    """
    described = common.written(describe(df, id_col, text_col), "signatures")
    nodes = described.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("wanted"), F.max("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labelled = rooted(nodes.select("node", "f1", "f2", "wanted"), links(df, nodes, percent, id_col, text_col), "node", "root")
    labelled = common.written(labelled, "labelled")
    least = common.written(labelled.groupBy("root").agg(F.min("wanted").alias("least")), "least")
    named = labelled.join(least, "root").select("f1", "f2", "least")
    found = described.drop("signature").join(named, ["f1", "f2"], "left")
    found = found.selectExpr("doc_id", "n_shingles", "CASE WHEN f1 IS NULL THEN doc_id ELSE least END AS component_id")
    return found.selectExpr("*", "doc_id <=> component_id AS kept")
