"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It accepts a token sequence exactly if that sequence is the BPE encoding of the bytes it spells. It
starts as one state with an arc for every byte. Each merge (u, v), in order, is one gadget: the state that u leads to is split, the
copy loses its v arc, all u arcs lead to the copy, and every state with a u arc gets an arc for the new token, which leads
where v led. All arcs of one token lead to one state, so a state is named by the last token read. A gadget stores only
the arc it takes away and its number; whether a state still has an arc follows from these marks and is put into the transition
table on first use.

A pre-split word is encoded by walking from state to state: exactly one walk spells the word. Decoding emits the byte labels of the arcs.

Nulls and empty texts have no ids and decode to the empty text. Text is never cut. Repeated rows are encoded each on its own.
"""
from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SLICE, Memo, caches, own_memory
from .tokens import byte_letters, space_pieces

TABLE_CAP = 200_000
#: Token lengths to try where no token of four bytes or more begins.
SHORT = (3, 2, 1)
#: Pieces whose pre-tokens are plain to see: Latin letters after a space or none, then marks that are neither letter nor digit.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:*$%&#|]*)")
#: What a plain piece cannot hold; an added token with such a character is in none.
_OTHER = re.compile(r"[^A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f.,!?;:*$%&#|]")


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.added = {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
        self.label = arc_labels(path)
        self.size = max(self.label) + 1
        self.tokenizer = Tokenizer.from_file(path)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left, self.right, self.birth, self.gadget = {}, {}, {}, {}
        for number, (a, b) in enumerate(pairs):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            if t in self.birth:
                raise ValueError(f"token {a + b!r} is the result of two merges")
            self.gadget[u, v] = number
            self.left[t], self.right[t], self.birth[t] = u, v, number
        self.table: dict[int, bool] = {}
        self.ids = {bytes([b]): vocab[c] for b, c in enumerate(letters) if c in vocab}
        for t, number in self.birth.items():
            if self._has_arc(self.left[t], self.right[t], number):
                self.ids[self.label[t]] = t
        sizes: dict[bytes, set[int]] = {}
        for spelled in self.ids:
            if len(spelled) >= 4:
                sizes.setdefault(spelled[:4], set()).add(len(spelled))
        self.by_start = {start: (*sorted(found, reverse=True), *SHORT) for start, found in sizes.items()}
        self.plain_pieces = not any(_PLAIN.search(c.decode()) and not _OTHER.search(c.decode()) for c in self.added.values())
        self.cores = Memo(self._core, 100_000)
        self.words = Memo(lambda piece: self._word(" " + piece), 300_000)

    def _has_arc(self, state: int, token: int, until: int) -> bool:
        """Does the state that `state` leads to have a `token` arc before gadget `until`? It lost the arc if a gadget took it, or took
        the arc of the left part before `token` was made of it; the marks of its ancestors count up to the split."""
        y, y_until = state, until
        while True:
            x, made = token, y_until
            while True:
                number = self.gadget.get((y, x))
                if number is not None and number < y_until and number <= made:  # a merge of u with u takes the arc before it adds its own
                    return False
                if x not in self.left:
                    break
                made = min(made, self.birth[x])
                x = self.left[x]
            if y not in self.right:
                return True
            y_until = min(y_until, self.birth[y])
            y = self.right[y]

    def arc(self, state: int, token: int) -> bool:
        key = state * self.size + token
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_CAP:
                self.table.clear()
            known = self.table[key] = self._has_arc(state, token, len(self.birth) + 1)
        return known

    def word(self, b: bytes) -> list[int]:
        """Ids of one pre-split word: a straight walk along arcs, longest token first; if it gets stuck, the search."""
        ids, table, by_start, size = self.ids, self.table, self.by_start, self.size
        whole = ids.get(b)
        if whole is not None:
            return [whole]
        path, at, left, last = [], 0, len(b), -1
        while left:
            for n in by_start.get(b[at : at + 4], SHORT):
                if n > left:
                    continue
                t = ids.get(b[at : at + n])
                if t is None:
                    continue
                if last >= 0:
                    known = table.get(last * size + t)
                    if not (self.arc(last, t) if known is None else known):
                        continue
                path.append(t)
                last, at, left = t, at + n, left - n
                break
            else:
                return self._search(b)
        return path

    def _search(self, b: bytes) -> list[int]:
        """The walk that reaches the end. A pair of place and last token from which none does is not tried again, so the steps
        stay in proportion to the word."""
        ids, n, dead = self.ids, len(b), set()
        path, ends, tries, at = [], [0], [iter(self.by_start.get(b[:4], SHORT))], 0
        while at < n:
            for size in tries[-1]:
                t = ids.get(b[at : at + size]) if at + size <= n else None
                if t is not None and (not path or self.arc(path[-1], t)) and (at + size, t) not in dead:
                    path.append(t)
                    at += size
                    ends.append(at)
                    tries.append(iter(self.by_start.get(b[at : at + 4], SHORT)))
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add((at, path.pop()))
                ends.pop()
                tries.pop()
                at = ends[-1]
        return path

    def _core(self, part: str) -> bytes:
        return array("i", self.word(part.encode())).tobytes()

    def _word(self, piece: str) -> bytes:
        """Ids of one piece between spaces, as little-endian 32-bit integers: special tokens out, pre-split, then the automaton."""
        plain = _PLAIN.fullmatch(piece)
        if plain and self.plain_pieces:
            head, tail = plain.groups()
            return self.cores[head] + self.cores[tail] if tail else self.cores[head]
        out: list[int] = []
        for part, special in self._cut_specials(piece):
            if special is not None:
                out.append(special)
            else:
                for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    out += self.word(self._bytes(w))
        return array("i", out).tobytes()

    def _bytes(self, letters: str) -> bytes:
        return letters.translate(_BACK).encode("latin-1")

    def _cut_specials(self, piece: str):
        known, start = {c.decode(): i for i, c in self.added.items()}, 0
        ahead = {c: piece.find(c) for c in known}
        while found := [(at, -len(c), c) for c, at in ahead.items() if at >= 0]:
            at, minus, c = min(found)
            if at > start:
                yield piece[start:at], None
            yield "", known[c]
            start = at - minus
            ahead = {c: piece.find(c, start) if 0 <= at < start else at for c, at in ahead.items()}
        if start < len(piece):
            yield piece[start:], None

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = space_pieces(text)
        return self._word(pieces[0]) + b"".join(map(self.words.__getitem__, pieces[1:]))

    def decode(self, ids) -> str:
        return spelled(self.label, ids)


def spelled(label: dict[int, bytes], ids) -> str:
    return b"".join(map(label.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def arc_labels(path: str) -> dict[int, bytes]:
    """The bytes of each token; of an added one its text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    code = {c: b for b, c in enumerate(byte_letters())}
    added = {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    return {i: bytes(code[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added} | added


_BACK = {ord(c): b for b, c in enumerate(byte_letters())}


def automaton(path: str) -> Automaton:
    """One per worker process."""
    own_memory(f"automaton {path}")
    return _automaton(path)


@lru_cache(maxsize=1)
def _automaton(path: str) -> Automaton:
    return Automaton(path)


caches.append(_automaton.cache_clear)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `ids`, the token ids of the whole text. A null or empty text has an empty list."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        a = automaton(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                enc = [a.encode(t) for t in part.column(len(keep)).to_pylist()]
                ends = np.cumsum([0, *(len(e) // 4 for e in enc)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(enc), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), ids], [*keep, "ids"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text_")).mapInArrow(run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `decoded`, the text that the ids spell."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)

    def run(batches):
        label = arc_labels(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                col = part.column(len(keep))
                texts = [spelled(label, x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in col]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "decoded"])

    return encoded.select(*keep, F.col(ids).alias("_ids_")).mapInArrow(run, f"{fields}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's row per document, derived from the ids and from the text decoded out of them."""
    enc = encode(docs, path)
    dec = decode(enc, path, keep=("doc_id", "ids"))
    return dec.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
