"""Ranked lexical search by Fagin's threshold algorithm over an index in shards.

``index`` writes one row a document: its number of terms, its distinct terms and how often each occurs. That is the
forward index, and the table that all statistics come from. A search then takes the queries' terms and weights to the
shards, each some millions of postings of those terms, which a task reads:

1. The shard's postings become one list a term, sorted by impact, largest first.
2. For a query the task goes down its lists side by side, a block of each at a time. Every document that turns up is
   looked up in the forward index and scored in full.
3. No document that hasn't turned up yet can score more than the threshold, the weighted sum of the impacts at which
   the lists stand; one whose list has ended adds nothing. Once the threshold is strictly below the k-th best score, the
   shard's k best are known, ties included. Blocks grow, so that lists which won't stop are soon read to their end.

A shard hands on k documents a query at most, and the best of all shards are ranked in two steps. Statistics are exact
and over all documents; weights and impacts are integers, so every shard scores alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckhand.llm import common

#: What stands between terms becomes a space, and A to Z small letters; all other bytes of UTF-8 belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Postings of the queries' terms in a shard, which bound a task's memory; and how many of a query's terms go to tasks at once.
SHARD_POSTINGS, BLOCK_TERMS = 1 << 21, 200_000
#: Postings of each list in the first round; every round goes as deep again as all before it.
DEPTH = 32
#: Groups in which the shards' best are ranked before all of a query's come together.
SALTS = 32


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms, counts: the forward index, without a shuffle.

    Terms are runs of digits, letters of ASCII in small form, and all other characters beyond ASCII. A null text
    has none; rows are taken each for itself; other columns are ignored; an empty table gives no rows.
    """

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(1))
            for lo, hi in common.slices(offsets, 4 * common.SLICE_BYTES):
                sizes, distinct, terms, counts = [], [0], [], []
                for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1]):
                    found = Counter(data[a:b].tobytes().translate(FOLD).split())
                    sizes.append(found.total())
                    distinct.append(distinct[-1] + len(found))
                    terms += found
                    counts += found.values()
                ends = pa.array(distinct, pa.int32())
                columns = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *columns], ["doc_id", "n", "terms", "counts"])

    docs = df.select(F.col(common.quoted(id_col)).cast("long").alias("id"), F.col(common.quoted(text_col)).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n long, terms array<string>, counts array<long>")


class Shard:
    """Documents' postings of some terms, as a forward index and as lists by impact.

    ids: of the documents, with None for null; rows, terms, impacts: of every posting, by row.
    """

    def __init__(self, ids: list[int | None], rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.terms, self.impacts = ids, terms, impacts
        self.starts = np.searchsorted(rows, np.arange(len(ids) + 1))
        order = np.lexsort((-impacts, terms))
        self.list_rows, self.list_impacts = rows[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        # Documents in the order that settles equal scores; null comes last.
        by_id = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0))
        self.place = np.empty(len(ids), np.int64)
        self.place[by_id] = np.arange(len(ids))

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The forward look-up: full scores of documents."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = common.ragged(self.starts[rows], sizes)
        sums = np.concatenate([[0], np.cumsum(weight[self.terms[at]] * self.impacts[at])])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return sums[ends[1:]] - sums[ends[:-1]]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k best documents with a score, in order, and how deep the lists were read.

        weight: scratch of a zero for each term, which is left so.
        """
        begin, end = self.lists[terms], self.lists[terms + 1]
        weight[terms] = weights
        seen = np.zeros(len(self.ids), bool)
        rows, scores, depth = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while True:
            low, depth = depth, 2 * depth or DEPTH
            a, b = np.minimum(begin + low, end), np.minimum(begin + depth, end)
            found = self.list_rows[common.ragged(a, b - a)]
            found = np.unique(found[~seen[found]])
            seen[found] = True
            rows, scores = np.concatenate([rows, found]), np.concatenate([scores, self.scores(found, weight)])
            order = np.lexsort((self.place[rows], -scores))[:k]
            rows, scores = rows[order], scores[order]
            open_ = b < end
            threshold = int((weights[open_] * self.list_impacts[b[open_] - 1]).sum())
            if not open_.any() or len(rows) == k and threshold < scores[-1]:
                break
        weight[terms] = 0
        return rows[scores > 0], scores[scores > 0], depth


def impacts(counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """What a term's occurrences in a document of some size are worth, in whole numbers."""
    m = 75 + 25 * sizes * n_docs // n_all
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def weighted(indexed: DataFrame, queries: DataFrame, id_col: str, text_col: str, n_docs: int) -> DataFrame:
    """item_id, term, weight of every query's terms that documents have; repeats in the query count.

    Terms are counted in each task before they are shuffled, so frequent ones weigh no more than others.
    """
    terms = index(queries, id_col, text_col).select(F.col("doc_id").alias("item_id"), F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    terms = terms.groupBy("item_id", F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("times"))
    held = indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1)))
    return terms.join(held, "term").select("item_id", "term", (F.col("times") * weight).cast("long").alias("weight"))


def search(indexed: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents for each query; fewer if fewer have a score.

    ``indexed`` is a written table of ``index``. Equal scores rank by ascending doc_id, a null one last; rows that
    repeat a doc_id are documents of their own. Rows of queries that repeat an id are one query of all their terms, a
    null id among them; a query without terms, or with none that a document has, has no rows; with an empty table on
    either side there are none. Queries go to the tasks in blocks of some BLOCK_TERMS terms, which bounds what
    the driver holds and sends.
    """
    spark = indexed.sparkSession
    n_docs, n_all = indexed.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = "item_id long, doc_id long, score long"
    if not n_docs:
        return ranked(spark.createDataFrame([], schema), k)
    with common.temporary(spark):
        weights = common.written(weighted(indexed, queries, id_col, text_col, n_docs), "weights")
        sizes = weights.groupBy("item_id").agg(F.count("*").alias("n"))
        # Queries dealt by hash to blocks of about equal size.
        blocks = 1 + (sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK_TERMS)
        tables = [weights.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow() for b in range(blocks)]
    found = [indexed.where("n > 0").select("doc_id", "n", "terms", "counts").mapInArrow(_searcher(t, k, n_docs, n_all), schema) for t in tables if t.num_rows]
    best = spark.createDataFrame([], schema) if not found else found[0]
    for other in found[1:]:
        best = best.union(other)
    return ranked(best, k)


def _searcher(weights: pa.Table, k: int, n_docs: int, n_all: int):
    """The task that searches shards for a block of queries."""
    weights = weights.sort_by("item_id")
    vocabulary = pc.unique(weights["term"])
    codes = pc.index_in(weights["term"], value_set=vocabulary).to_numpy().astype(np.int64)
    worth = weights["weight"].to_numpy()
    items = weights["item_id"].to_pylist()
    cuts = [0, *(i for i in range(1, len(items)) if items[i] != items[i - 1]), len(items)]

    def searched(parts: list[tuple]) -> pa.RecordBatch:
        ids = [i for own, *_ in parts for i in own]
        first = np.cumsum([0, *(len(own) for own, *_ in parts)])
        rows = np.concatenate([r + f for (_, r, _, _), f in zip(parts, first)])
        shard = Shard(ids, rows, *(np.concatenate(c) for c in list(zip(*parts))[2:]), len(vocabulary))
        scratch, out = np.zeros(len(vocabulary), np.int64), ([], [], [])
        for a, b in zip(cuts[:-1], cuts[1:]):
            found, scores, _ = shard.best(codes[a:b], worth[a:b], k, scratch)
            out[0].extend([items[a]] * len(found))
            out[1].extend(ids[r] for r in found)
            out[2].extend(scores.tolist())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["item_id", "doc_id", "score"])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            of = pc.list_parent_indices(terms).to_numpy()
            code = pc.index_in(terms.flatten(), value_set=vocabulary)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            of, own = of[known], counts.flatten().to_numpy()[known]
            parts.append((batch.column(0).to_pylist(), of, code.drop_null().to_numpy().astype(np.int64), impacts(own, batch.column(1).to_numpy()[of], n_docs, n_all)))
            held += len(of)
            if held >= SHARD_POSTINGS:
                yield searched(parts)
                parts, held = [], 0
        if parts:
            yield searched(parts)

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's documents; in groups by the document's hash first, so that no query's all meet in one task."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return few.select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The documents' index, written, and the queries' answers from it."""
    return search(common.written(index(docs), "index"), queries, k)
