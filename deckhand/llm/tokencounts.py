"""Token counts without encoding: most words are one token, which a table proves once for all.

A vocabulary string that the merges turn back into just its own token counts as proved. The proof runs before
any text is read, over the vocabulary alone; a string may be in the vocabulary and still come out as several
tokens, as other merges take its parts first. A pre-token that is a proved string counts as one, and only the
others go through the merges.

Texts are first cut at the tokenizer's special strings, which count as one each, then at spaces before visible
characters, where a pre-token always starts. Each distinct piece between is split into pre-tokens and counted once
for as long as the worker remembers it. The library itself splits pieces with characters that pattern libraries may
class differently, so that both agree on every script.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deckhand.llm import common, vocab

#: Pieces that each of a worker's two generations holds; longer ones than PIECE characters aren't remembered.
CACHE_PIECES, PIECE = 300_000, 64
#: Texts with more tokens are over the limit.
LIMIT = 1024


def prove(tokenizer: Tokenizer) -> frozenset[str]:
    """The vocabulary strings that encode as one token, in the tokenizer's own letters, by running the merges on each."""
    merges = tokenizer.model.tokenize
    return frozenset(t for t in tokenizer.get_vocab(with_added_tokens=False) if len(merges(t)) == 1)


class _Unsafe(Exception):
    """The piece can't stand alone."""


#: One token that took merging, beside those of the proof in a count.
MERGED = 1 << 32


class _Pieces(dict):
    """Piece to its pre-tokens that are proved strings, plus MERGED for each token of its others.

    With a space before it, which isn't in the key, a piece must start with a visible character. Pieces not seen for a
    generation are forgotten.
    """

    def __init__(self, prefix: str, proved: frozenset[bytes], merge, split):
        self.prefix, self.proved, self.merge, self.split = prefix, proved, merge, split
        self.pattern, self.old = regex.compile(vocab.SPACED), {}
        self.marks = {m: self.word(m) for m in vocab.MARKS}

    def word(self, word: str) -> int:
        """Of a pre-token."""
        own = word.encode()
        return 1 if own in self.proved else MERGED * len(self.merge(own))

    def piece(self, piece: str) -> int:
        """The library splits what holds characters that others may class differently."""
        stem, mark = (piece[:-1], self.marks[piece[-1]]) if piece[-1] in self.marks else (piece, 0)
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
            return self.word(self.prefix + stem) + mark
        own = self.prefix + piece
        if vocab.PLAIN.fullmatch(piece):
            return sum(map(self.word, self.pattern.findall(own)))
        return sum(self.word(own[a:b]) for _, (a, b) in self.split(own))

    def __missing__(self, piece: str) -> int:
        if self.prefix and (not piece or piece[0].isspace()):
            raise _Unsafe
        found = self.old.get(piece) or self.piece(piece)
        if len(piece) <= PIECE:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Counts:
    """Counts whole texts by a tokenizer file."""

    def __init__(self, path: str):
        made = json.loads(Path(path).read_text())
        if made["normalizer"] or made["pre_tokenizer"]["type"] != "ByteLevel" or made["pre_tokenizer"]["add_prefix_space"] or made["model"]["dropout"]:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        special = made["added_tokens"]
        if any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: special strings that take in what stands beside them")
        tokenizer = Tokenizer.from_file(path)
        letters = {c: b for b, c in vocab.byte_letters().items()}
        self.proved = frozenset(bytes(map(letters.__getitem__, t)) for t in prove(tokenizer))
        shared = self.proved, vocab.merges(path)[0]._core_bpe.encode_single_piece, tokenizer.pre_tokenizer.pre_tokenize_str
        self.first, self.rest = _Pieces("", *shared), _Pieces(" ", *shared)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(special, key=lambda t: -len(t["content"])))) if special else None

    def forget(self) -> None:
        for pieces in (self.first, self.rest):
            pieces.clear()
            pieces.old = {}

    def part(self, text: str) -> int:
        head, *tail = text.split(" ")
        try:
            found = sum(map(self.rest.__getitem__, tail))
        except _Unsafe:
            head, *tail = re.split(r" (?=\S)", text)
            found = sum(map(self.rest.__getitem__, tail))
        return found + self.first[head] if head else found

    def count(self, text: str) -> tuple[int, int]:
        """Tokens that the proof gives and special strings, and tokens that took merging."""
        parts = self.special.split(text) if self.special else [text]
        merged, whole = divmod(sum(map(self.part, parts)), MERGED)
        return whole + len(parts) - 1, merged


@functools.cache
def counter(path: str) -> Counts:
    """One for each worker process."""
    return Counts(path)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, n_whole (tokens that the proof gave), as the library counts without begin or end.

    A special string within a text is one token, the library's default. A null text counts as empty and has no tokens;
    rows are taken each for itself, so null and repeated ids come back as they are; other columns are ignored; an empty
    table gives no rows. No shuffle; a worker remembers a bounded number of pieces.
    """
    tokenizer = tokenizer or vocab.default_path("byte_bpe_50k.json")

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in batches:
            text = batch.column(1).fill_null("")
            found = [counts.count(t.as_py()) for t in text]
            columns = [batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array([a + b for a, b in found], pa.int64()), pa.array([a for a, _ in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "n_whole"])
        counts.forget()

    docs = df.select(F.col(common.quoted(id_col)).cast("long").alias("id"), F.col(common.quoted(text_col)).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_whole long")


def count_digest(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    return count_tokens(df).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")
