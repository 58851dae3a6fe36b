"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

A text is a sequence of lines, each described by a few features. Viterbi decoding finds the best
sequence of labels, and the share of words in content lines decides whether the document stays.
Plain rules on its words come first.

The field is trained here on a bounded sample of documents with a quality label. Lines have no labels
of their own: those of good documents are content; those of bad documents start as boilerplate and are
labelled anew by the field itself, some rounds, as bad documents hold good lines too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckhand.llm import common

SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:"
N_FEATURES = 12
#: Documents on which the field is fitted, at most.
SAMPLE = 1500
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20
#: A document stays if this share of its words is in content lines.
CONTENT_SHARE = 0.5


@dataclass(frozen=True)
class Field:
    """Scores of a line's features for content over boilerplate, and of neighbouring labels."""

    weights: np.ndarray
    pairs: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.zeros(len(x)), x @ self.weights])


def line_features(lines: list[bytes], counts: list[int], distinct: list[int]) -> np.ndarray:
    """One row a line; the features are shares, so that length alone says little."""
    out, seen = np.zeros((len(lines), N_FEATURES)), set()
    for k, (line, n, d) in enumerate(zip(lines, counts, distinct)):
        size = max(len(line), 1)
        some = max(n, 1)
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        upper = len(line) - len(line.translate(None, UPPER))
        out[k] = (
            1.0,
            min(symbols / some, 3.0),
            min(upper / some, 8.0) / 2,
            min(line.count(b"!") / some, 3.0),
            (len(line) - len(line.translate(None, DIGITS))) / size * 4,
            3 * line.count(b"|") / some,
            (1 - d / some) * (n >= 4),
            n > 0 and line in seen,
            line.rstrip()[-1:] in (b".", b"?", b"!"),
            n <= 3,
            n > 40,
            (len(line) - len(line.translate(None, STOPS))) / some,
        )
        seen.add(line)
    return out


def _by_step(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Steps with the documents that have a line there; documents are in order of falling length."""
    n = len(lengths)
    for t in range(int(lengths[0]) if n else 0):
        n = int(np.searchsorted(-lengths[:n], -t, "left"))
        yield t, n


def viterbi(field: Field, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of all lines; ``lengths`` lines each, one document after another. Ties: content."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    back = np.zeros((len(emissions), 2), np.int8)
    score = np.zeros((len(order), 2))
    for t, n in _by_step(lengths):
        at = starts[:n] + t
        if t:
            ways = score[:n, :, None] + field.pairs
            best = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
            back[at] = best
            score[:n] = np.where(best, ways[:, 1], ways[:, 0])
        score[:n] += emissions[at]
    labels, current = np.zeros(len(emissions), np.int8), (score[:, 1] >= score[:, 0]).astype(np.int8)
    for t, n in reversed(list(_by_step(lengths))):
        at = starts[:n] + t
        labels[at] = current[:n]
        current[:n] = back[at, current[:n]]
    return labels


def _log_add(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[..., 0], a[..., 1])


def gradient(field: Field, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood by forward-backward, for weights and pairs; documents by falling length."""
    e, starts = field.emissions(x), np.cumsum(lengths) - lengths
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    steps = list(_by_step(lengths))
    for t, n in steps:
        at = starts[:n] + t
        forward[at] = e[at] + (_log_add((forward[at - 1][:, :, None] + field.pairs).swapaxes(1, 2)) if t else 0)
    for t, n in reversed(steps[1:]):
        at = starts[:n] + t
        backward[at - 1] = _log_add(field.pairs + (backward[at] + e[at])[:, None, :])
    z = _log_add(forward[starts + lengths - 1])
    content = np.exp(forward[:, 1] + backward[:, 1] - np.repeat(z, lengths))
    pairs = np.zeros((2, 2))
    inner = np.ones(len(e), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    joint = forward[at - 1][:, :, None] + field.pairs + (backward[at] + e[at])[:, None, :] - np.repeat(z, lengths)[at, None, None]
    np.add.at(pairs, (labels[at - 1], labels[at]), 1.0)
    return x.T @ (labels - content), pairs - np.exp(joint).sum(axis=0)


def fit(docs: list[bytes], good: list[bool], rounds: int = 2, steps: int = 80) -> Field:
    """The field for documents of known quality; one that takes all for content if there are none."""
    read = [(_lines(d), g) for d, g in zip(docs, good)]
    read = sorted(((r, g) for r, g in read if r[0]), key=lambda r: -len(r[0][0]))
    field = Field(np.eye(1, N_FEATURES)[0], np.zeros((2, 2)))
    if not read or all(g for _, g in read):
        return field
    x = np.concatenate([line_features(*r) for r, _ in read])
    lengths = np.array([len(r[0]) for r, _ in read])
    of_good = np.repeat([g for _, g in read], lengths)
    labels = of_good.astype(np.int64)
    for _ in range(rounds):
        params, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
        for t in range(1, steps + 1):  # Adam
            field = Field(params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2))
            w, p = gradient(field, x, lengths, labels)
            g = np.concatenate([w, p.ravel()]) / len(x) - 1e-4 * params
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            params = params + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        field = Field(params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2))
        labels = np.where(of_good, 1, viterbi(field, field.emissions(x), lengths)).astype(np.int64)
    return field


def _lines(text: bytes) -> tuple[list[bytes], list[int], list[int]]:
    lines = text.split(b"\n") if text else []
    words = [line.split() for line in lines]
    return lines, list(map(len, words)), [len(set(w)) for w in words]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    k = len(ids)
    if k == n:
        return 0
    pair = w[:-1] * k + w[1:]
    if k >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * k + w[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    if not same.any():
        return 0
    covered = np.zeros(n, bool)
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    for d in range(3):
        covered[at + d] = True
    return int(covered.sum())


def describe(text: bytes) -> tuple[int, int, int, int, int, tuple]:
    """The rules' counts, and the lines for the field."""
    lines, counts, distinct = _lines(text)
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    worded = [line for line, n in zip(lines, counts) if n]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(worded) - len(set(worded)), repeated_words(words), (lines, counts, distinct)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits the field on the ``sample`` labelled documents whose ids have the smallest hashes.

    Labels without an id or a quality don't count; an id with several labels has the least of them, and one
    with several texts the least of those, so that the sample is the same each time. Labels of documents
    that aren't there, and empty tables, leave fewer documents or none; see fit().
    """
    picked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = F.broadcast(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows
    found = documents.select("doc_id", "text").join(picked, "doc_id")
    rows = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()  # at most ``sample`` rows
    rows = sorted((r.doc_id, r.text or "", r.quality) for r in rows)
    return fit([t.encode() for _, t, _ in rows], [q > 0 for *_, q in rows])


def assess(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Adds the rules' counts and the verdict to every row, and keeps all its columns.

    A null text counts as empty: no words, so the rules fail it. Texts of any length are read whole, some
    megabytes at a time. Repeated rows get equal verdicts; an empty table stays empty; columns of df with the
    names of new ones, in any case of letters, are replaced.
    """
    added = [c.split()[0] for c in COLUMNS.split(", ")]
    own = common.others(df, added)
    at = own.index(text_col)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in common.slices(common.text_bytes(whole.column(at))[1], SLICE_BYTES):
                batch = whole.slice(lo, hi - lo)
                found = [describe((t or "").encode()) for t in batch.column(at).to_pylist()]
                lengths = np.array([len(f[5][0]) for f in found], np.int64)
                lines = np.concatenate([line_features(*f[5]) for f in found] or [np.zeros((0, N_FEATURES))])
                content = viterbi(field, field.emissions(lines), lengths)
                words = np.array([n for f in found for n in f[5][1]], np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                inside = np.concatenate([[0], np.cumsum(words * content)])
                share = (inside[ends[1:]] - inside[ends[:-1]]) / np.maximum([f[0] for f in found], 1)
                failed = np.array([f[0] < 50 or 100 * f[4] > 50 * f[0] for f in found], bool)
                new = [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
                new += [pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE)), pa.array(share)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*own, *added])

    return df.select(*map(common.quoted, own)).mapInArrow(run, f"{common.ddl(df, own)}, {COLUMNS}")


def quality_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return assess(documents.select("doc_id", "text"), train(documents, labels)).drop("text")
