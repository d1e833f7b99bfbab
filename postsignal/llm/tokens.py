"""Token ids of whole texts with a public tokenizer, inside Arrow batches.

A tokenizer that drops white space and works word by word (``word_bpe_49k``)
gives a text the concatenated ids of its white-space separated words.  So only
the distinct words of a chunk of documents are encoded and their ids gathered
back; words seen before come from a bounded cache of the worker process.

Plain words (ASCII and Latin-1 letters, no ``<|``) are cut into the letter runs,
digits and sign runs of the tokenizer's own pattern and given to its model
directly, which saves most of the time of its general entry; all other words
take the general entry.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

from .textkit import Words, distinct

CACHE_WORDS = 200_000          # words in each of the cache's two generations

# The tokenizer's split pattern, narrowed to the plain words' characters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"(?!.*<\|)[\x21-\x7e\xc0-\xff]+")


def _byte_signs() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``start[i] .. start[i] + length[i]``, one after another."""
    to = np.cumsum(length)
    total = int(to[-1]) if len(to) else 0
    out = np.repeat(start - (to - length), length)
    out += np.arange(total)
    return out


class Cache:
    """A map of at most two generations of ``CACHE_WORDS`` entries; words in use outlive the others."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[key] = value


def of_process(key: str, make):
    """One object per Python worker process, kept over its tasks."""
    home = sys.modules.setdefault("_worker_objects", types.ModuleType("_worker_objects"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]


class WordTokenizer:
    """Ids of texts by ``path`` (a ``tokenizers`` file); ``end_id`` is put after every text."""

    def __init__(self, path: str, end_id: int | None = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = of_process(f"tokenizer {path}", lambda: Tokenizer.from_file(path))
        self.words = of_process(f"words {path}", Cache)
        self.pieces = of_process(f"pieces {path}", Cache)
        self.signs = _byte_signs()
        self.end_id = end_id

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            sign = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(sign)], dtype=np.uint32).tobytes()
            self.pieces.put(piece, ids)
        return ids

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            return b"".join([self._piece(x) for x in _PIECES.findall(word.lower())])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32, ends): the ids of text ``d`` are ``ids[ends[d]:ends[d + 1]]``."""
        w = Words(buf, offsets, fold=False)
        at, word = distinct(w.hash)
        hashes = w.hash[at].tolist()
        cells = list(map(self.words.young.get, hashes))
        missing = [k for k, ids in enumerate(cells) if ids is None]
        if missing:
            data = buf.tobytes()
            for k, s, e in zip(missing, w.start[at[missing]].tolist(), w.end[at[missing]].tolist()):
                ids = self.words.get(hashes[k])
                if ids is None:
                    ids = self._word(data[s:e].decode("utf-8", "replace"))
                    self.words.put(hashes[k], ids)
                cells[k] = ids
        first = w.first
        if self.end_id is not None:                       # one more "word" after every text
            cells.append(np.array([self.end_id], dtype=np.uint32).tobytes())
            word = np.insert(word, first[1:], len(at))
            first = first + np.arange(len(first))
        length = np.fromiter(map(len, cells), dtype=np.int64, count=len(cells)) >> 2
        flat = np.frombuffer(b"".join(cells), dtype=np.uint32)
        each = length[word]
        ids = flat[ragged((np.cumsum(length) - length)[word], each)]
        return ids, np.concatenate([[0], np.cumsum(each)])[first]
