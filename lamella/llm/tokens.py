"""Texts to token ids with the tokenizers library, one piece between spaces at a time, pieces remembered.

A piece boundary is only set where no pre-token can cross it, so the ids equal those of the whole text:
* byte-level BPE: in front of a space that a non-space follows, because that space opens the next pre-token;
* word BPE: at any space, because white space is dropped and no pre-token contains it.
"""
from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from .text import Memo, caches, own_memory

_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_WORD_SPACE = re.compile(r" (?=\S)")


def space_pieces(text: str) -> list[str]:
    """The text cut at each single space that a word follows; that space opens every piece but the first and is left out here."""
    return text.split(" ") if not _ODD_SPACE.search(text) else _WORD_SPACE.split(text)


def bare_pieces(text: str) -> list[str]:
    """Parts between spaces, lower-cased where that is plain ASCII."""
    return (text.lower() if text.isascii() else text).split(" ")


#: Pieces whose pre-tokens are plain to see: Latin letters, then marks that are neither letter nor digit nor apostrophe.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:*$%&#|]*)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others,
    in order, for the code points from 256 on."""
    plain = [chr(b).isprintable() and chr(b) != " " for b in range(256)]
    free = iter(range(256, 512))
    return [chr(b) if plain[b] else chr(next(free)) for b in range(256)]


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes. `opening` stands before every piece but the first. Memory: two generations of `cap`
    remembered pieces. A new plain piece goes to the library's BPE model at once, any other through its whole pipeline."""

    def __init__(self, path: str, pieces, opening: str, fold: bool, cap: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, str.maketrans({b: c for b, c in enumerate(byte_letters())})
        self.pieces, self.opening, self.fold = pieces, opening, fold
        self.known, self.marks = Memo(self._fresh, cap), Memo(self._whole, 10_000)
        self.spelled_opening = opening.translate(self.letters)

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.known.__getitem__, []
        for text in texts:
            first, *rest = self.pieces(text)
            out.append(self._whole(first) + b"".join(map(known, rest)))
        return out

    def _fresh(self, piece: str) -> bytes:
        plain = PLAIN.fullmatch(piece)
        if plain is None:
            return self._whole(self.opening + piece)
        word, marks = plain.groups()
        if marks:
            return self.known[word] + self.marks[marks]
        if self.fold:
            word = word.lower()
        spelled = self.spelled_opening + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""


def encoder(path: str, kind: str, held: int = 700_000) -> PieceEncoder:
    """One per worker process; `kind` is "byte" or "word". It remembers twice `held` pieces at most, about 130 bytes each."""
    own_memory(f"encoder {kind} {path}")
    return _encoder(path, kind, held)


@lru_cache(maxsize=2)
def _encoder(path: str, kind: str, held: int = 700_000) -> PieceEncoder:
    return PieceEncoder(path, *{"byte": (space_pieces, " ", False), "word": (bare_pieces, "", True)}[kind], held)


caches.append(_encoder.cache_clear)
