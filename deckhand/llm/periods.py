"""Periodic runs of words, found by comparing a text with itself at every lag, all words at once.

Word ids stand in bit planes: plane k is one big integer whose bit i is bit k of word i's id. Shifted by a lag
q and XORed with itself a plane shows where words q apart differ in that bit; the OR over planes shows where
they differ at all. A run with period q and length n is a stretch of n - q places without a difference, so
stretches of at least m = max(LEAST - q, (TIMES - 1) * q) places are wanted. ANDing the agreeing places with
themselves shifted by 1, 2, 4, ... leaves a bit at just those places from which m agreeing ones follow.

A run repeats with the multiples of its period too. Runs of TIMES periods or more that have a multiple of
their smallest period as period are the same stretch of words, so going through lags in ascending order the
first one to find a stretch has its smallest period.

Trying all lags would take time that grows with the square of the text, so only lags that can belong to a run
are tried. Take a run with smallest period q and a power of two n with n / 2 < q <= n, or n = LEAST_STRING if q is
smaller. The n words at its start stand again q words later, still within the run, and nowhere between: an
earlier copy would give the run a smaller period. So q is the distance from some string of n words to its next
copy. Ranks of the strings of 2, 4, 8, ... words, each from two ranks of half the length, give these distances.
A text has in the order of sqrt(words) such lags at most, and prose mostly none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckhand.llm import common

#: Runs have so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: The largest power of two for which all runs hold a string of so many words and its next copy.
LEAST_STRING = 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "struct<start:long,length:long,period:long>"


def lags(ids: np.ndarray) -> list[int]:
    """The lags that can belong to a run, ascending."""
    n, length, found, strings = len(ids), 1, set(), ids
    while 2 * length < n:
        rank = int(strings.max()) + 1
        pairs = strings[:-length].astype(np.int64) * rank + strings[length:]
        length *= 2
        order = np.argsort(pairs, kind="stable")
        ordered = pairs[order]
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            break
        if length >= LEAST_STRING:
            gaps = np.unique(np.diff(order)[same])
            low = 0 if length == LEAST_STRING else length // 2
            found.update(gaps[(gaps > low) & (gaps <= length)].tolist())
        strings = np.empty(len(pairs), np.int64)
        strings[order] = np.concatenate([[0], np.cumsum(~same)])
    return sorted(q for q in found if TIMES * q <= n)


def planes(ids: np.ndarray) -> list[int]:
    """Plane k has bit k of every id, the first word's in its lowest bit."""
    bits = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(bits)]


def stretches(agree: int, least: int) -> list[tuple[int, int]]:
    """Start and length of all maximal stretches of ones with at least so many of them."""
    done = 1
    while done < least and agree:
        step = min(done, least - done)
        agree &= agree >> step
        done += step
    if not agree:
        return []
    bits = np.unpackbits(np.frombuffer(agree.to_bytes((agree.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8)))
    return [(a, b - a + least - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def runs(words: list[str]) -> list[tuple[int, int, int]]:
    """start, length and smallest period of all runs, by start and period."""
    n, known = len(words), {}
    if n < LEAST:
        return []
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found: dict[tuple[int, int], int] = {}
    own = None
    for q in lags(ids):
        own = own or planes(ids)
        differ = 0
        for p in own:
            differ |= p ^ p >> q
        agree = ~differ & (1 << n - q) - 1
        for start, places in stretches(agree, max(LEAST - q, (TIMES - 1) * q)):
            found.setdefault((start, places + q), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed (the words that stay, joined by spaces).

    A null or empty text has no words, no runs and is collapsed to an empty one. Rows are taken each for itself, so
    null and repeated ids come back as they are; other columns are ignored, whatever their names; an empty table gives no
    rows. A text is one row of one task; time grows with its words times the square root of their number at worst.
    """

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = common.text_bytes(batch.column(1))
            for lo, hi in common.slices(offsets):
                sizes, found, left = [], [], []
                for text in common.texts(batch.column(1)[lo:hi]):
                    words = WORD.findall(text)
                    own = runs(words)
                    sizes.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), x)) for x in own])
                    left.append(" ".join(w for w, k in zip(words, kept(len(words), own)) if k) if own else " ".join(words))
                kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sizes, pa.int64()), pa.array(found, kinds), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    docs = df.select(F.col(common.quoted(id_col)).cast("long").alias("id"), F.col(common.quoted(text_col)).alias("text"))
    return docs.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def planted(df: DataFrame) -> DataFrame:
    """doc_id and text, with a repetition in every tenth text: from some word on, the words of one period over and over.

    Which text, from where and with which period follows from a checksum of the id; such a text becomes its words,
    joined by spaces. A null id counts as checksum 0.
    """
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    g = F.floor(h / 10).cast("long")
    split = df.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD.pattern})"))).alias("words"))
    n = F.size("words").cast("long")
    start = F.when(n > 0, F.col("g") % n)
    with_start = split.select("*", n.alias("n"), start.alias("a"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    with_period = with_start.select("*", period.alias("p"))
    rest = (F.col("n") - F.col("a")).cast("int")
    times = (F.floor(rest / F.col("p")) + 1).cast("int")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p")), times)), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), cycle), " ")
    return with_period.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def strongest(found: Column) -> Column:
    """Of an array of runs the one with most periods; of equals the first one, and the one with the smallest period."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"].cast("decimal(19,0)") * b["period"], b["length"].cast("decimal(19,0)") * a["period"]
        return F.when(a.isNull() | (y > x), b).otherwise(a)  # runs come by start and period, so the earlier of equals stays

    return F.aggregate(found, F.lit(None).cast(RUN), better)


def run_digest(df: DataFrame) -> DataFrame:
    """The runs of all texts with planted repetitions, and checksums of them and of what is left of the text."""
    found = periodic_runs(planted(df))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length DIV best.period")
    return best.select("doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
