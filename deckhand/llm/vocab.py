"""Tokenizers with a bounded cache of pieces.

Prose repeats its words, so a text is cut at spaces where no token can cross, each distinct piece is
encoded once as the tokenizers library does and kept as packed little-endian 16-bit ids, and a text's ids
are the joined bytes. Where the cut isn't safe the piece simply stays longer.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from pathlib import Path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import regex
import tiktoken
from tokenizers import Tokenizer

#: Pieces in one of the two generations that a worker keeps, about 30 MB each.
CACHE_PIECES = 200_000
#: Pieces of these characters, on whose classes, case and form all libraries agree, are split here.
PLAIN = re.compile("[\\n!-~\u00a1-\u012f\u0131-\u024f]+")
#: The patterns in the two kinds of tokenizer files.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that are tokens of their own after a word.
MARKS = frozenset(".,;:!?")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Unsafe(Exception):
    """The piece can't stand alone."""


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Pieces(dict):
    """Piece to packed ids, by ``prefix`` + piece; with a prefix, a piece must start with a visible character.

    A plain word needs only the merges; whatever else a piece holds takes the tokenizer's whole path.
    Pieces not seen for a generation are forgotten.
    """

    def __init__(self, tokenizer: Tokenizer, merge: tiktoken.Encoding, prefix: str, lower: bool, end: bytes):
        self.tokenizer, self.prefix, self.lower, self.end = tokenizer, prefix, lower, end
        self.merge = merge._core_bpe.encode_single_piece
        self.marks = {m: self.ids(m) for m in MARKS}
        self.pattern = regex.compile(WORDS if lower else SPACED)
        self.old: dict[str, bytes] = {}

    def ids(self, word: str) -> bytes:
        return array("H", self.merge(word.encode() + self.end)).tobytes()

    def word(self, word: str) -> bytes | None:
        """None if it isn't made of letters only, of the Latin blocks whose case and form are plain."""
        if self.lower:
            word = word.lower()
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self.ids(self.prefix + word)
        return None

    def __missing__(self, piece: str) -> bytes:
        if self.prefix and (not piece or piece[0].isspace()):
            raise _Unsafe
        found = self.old.get(piece)
        if found is None:
            found = self.word(piece)
        if found is None and piece[-1:] in self.marks and len(piece) > 1:
            stem = self.get(piece[:-1]) or self.word(piece[:-1])
            if stem and piece[:-1].isalpha():
                self.keep(piece[:-1], stem)
                found = stem + self.marks[piece[-1]]
        if found is None and PLAIN.fullmatch(piece):
            found = b"".join(map(self.ids, self.pattern.findall(piece.lower() if self.lower else self.prefix + piece)))
        if found is None:
            found = array("H", self.tokenizer.encode(self.prefix + piece, add_special_tokens=False).ids).tobytes()
        self.keep(piece, found)
        return found

    def keep(self, piece: str, ids: bytes) -> None:
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = ids


def merges(path: str) -> tuple[tiktoken.Encoding, bytes]:
    """The file's merges as ranks, and what stands for its end-of-word suffix.

    Ranks and merges agree: before a token's own merge, all earlier merges within its span have been
    made in either, in the same order, so the same two parts meet. The suffix becomes byte 0xFF, which
    UTF-8 never has; its merges with single bytes have the lowest ranks, so they come first.
    """
    model = json.loads(Path(path).read_text())["model"]
    suffix = model.get("end_of_word_suffix") or ""
    letters = {c: b for b, c in byte_letters().items()}
    made, ranks = {"".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]}, {}
    for token, k in model["vocab"].items():
        stem, end = (token[: -len(suffix)], b"\xff") if suffix and token.endswith(suffix) else (token, b"")
        if token in made or len(stem) == 1:
            data = bytes(letters[c] for c in stem)
            if b"\xff" not in data or data == b"\xff" and not end:
                ranks[data + end] = k
    return tiktoken.Encoding("merges", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}), b"\xff" if suffix else b""


_encoders: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """Encodes whole texts to packed 16-bit ids, as the tokenizers library does without special tokens."""

    def __init__(self, path: str, keeps_space: bool):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids must fit in 16 bits")
        merge, end = merges(path)
        self.first = _Pieces(tokenizer, merge, "", not keeps_space, end)
        self.rest = _Pieces(tokenizer, merge, " ", False, end) if keeps_space else self.first

    def forget(self) -> None:
        for pieces in (self.first, self.rest):
            pieces.clear()
            pieces.old = {}

    def packed(self, text: str) -> bytes:
        """A space before a visible character always starts a new token, or is dropped by the tokenizer."""
        head, space, tail = text.partition(" ")
        if not space:
            return self.first[head] if head else b""
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail.split(" ")))
        except _Unsafe:
            head, *tail = re.split(r" (?=\S)", text)
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


def forget() -> None:
    """Empties the caches of this worker's encoders; a task does so when it ends, as other stages need the room."""
    for e in _encoders.values():
        e.forget()


@functools.cache
def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder for each worker process. keeps_space: whether tokens carry the space before a word."""
    found = _encoders[path, keeps_space] = Encoder(path, keeps_space)
    return found
