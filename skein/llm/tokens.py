"""Whole-text tokenisation of Arrow batches with a public byte-level BPE vocabulary.

A piece of text that begins with a single space or line feed before a visible character always begins
a pre-token of the byte-level BPE pattern, whatever stands before it. Texts are therefore cut at those
places, each different piece is encoded once, and the ids of a text are the ids of its pieces. A text
that holds the string of one of the vocabulary's special tokens goes to the library whole, which gives
that token's id for it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skein.llm import textscan

#: Bytes that may follow the cut: visible ASCII, and lead bytes whose characters are never white space.
_SAFE = textscan.byte_class((0x21, 0x7E), (0xC3, 0xDF), (0xE4, 0xED), (0xF0, 0xF4))
_CUT = textscan.byte_class((0x20, 0x20), (0x0A, 0x0A))
#: Punctuation after an ASCII letter begins a pre-token of its own.
_LETTER = textscan.byte_class((0x41, 0x5A), (0x61, 0x7A))
_MARK = textscan.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Pieces that keep their ids when they stand after any other piece.
_JOINS = re.compile(r"[ \n]\S").match
CACHE_PIECES = 400_000
CHUNK_BYTES = 3 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Token ids of text columns. Pieces seen before come from a bounded cache."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.cache_pieces = cache_pieces
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.pool = np.zeros(1 << 20, dtype=np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int64)

    def _add(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Take in pieces whose ids stand one after another in ``ids``, each up to its end."""
        slot, n = len(self.slots), len(self.slots) + len(pieces)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), dtype=np.int32)])
        if n > len(self.starts):
            more = np.zeros(max(len(self.starts), len(pieces)), dtype=np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.pool[self.used : self.used + len(ids)] = ids
        begins = np.append(0, ends[:-1])
        self.starts[slot:n], self.lengths[slot:n] = self.used + begins, ends - begins
        self.used += len(ids)
        self.slots.update(zip(pieces, range(slot, n), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; those that can stand after one another go through the encoder together."""
        joined = [p for p in pieces if _JOINS(p)]
        if len(joined) < len(pieces):
            alone = [p for p in pieces if not _JOINS(p)]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            self._add(alone, np.concatenate([np.asarray(x, dtype=np.int32) for x in found]), np.cumsum([len(x) for x in found]))
        if joined:
            parts = ["".join(joined[k : k + 200]) for k in range(0, len(joined), 200)]
            ids = np.concatenate([np.asarray(x.ids, dtype=np.int32) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
            sizes = pc.binary_length(pa.array(joined, pa.large_string())).to_numpy()
            self._add(joined, ids, np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes), side="left") + 1)

    def _rows_with_special(self, offsets: np.ndarray, data: np.ndarray) -> list[int]:
        raw, rows = data.tobytes(), set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    rows.add(row)
                at = raw.find(token, at + 1)
        return sorted(rows)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows: (first row, row after the last, ids, where each row's ids begin and end)."""
        for lo, hi, offsets, data in textscan.chunks(column, CHUNK_BYTES):
            done = 0
            for row in [*self._rows_with_special(offsets, data), hi - lo]:
                if row > done:
                    ids, ends = self._encode_run(offsets[done : row + 1] - offsets[done], data[offsets[done] : offsets[row]])
                    yield lo + done, lo + row, ids, ends
                if row < hi - lo:
                    text = data[offsets[row] : offsets[row + 1]].tobytes().decode()
                    ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
                    yield lo + row, lo + row + 1, ids, np.array([0, len(ids)])
                done = row + 1

    def _encode_run(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each row's ids begin and end) of texts without special tokens."""
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        begins = np.zeros(len(data), dtype=bool)
        begins[:-1] = _CUT[data[:-1]] & _SAFE[data[1:]]
        begins[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        # a cut byte that ends its text has no visible character after it
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        lone = last[~np.isin(last, offsets[:-1])]
        begins[lone] = False
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        pieces = pieces.dictionary_encode()
        different = pieces.dictionary.to_pylist()
        if len(self.slots) + len(different) > self.cache_pieces:
            self._clear()
        new = [p for p in different if p not in self.slots]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, different), dtype=np.int64, count=len(different))
        slot = slot[pieces.indices.to_numpy()]
        lengths = self.lengths[slot]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) + np.repeat(self.starts[slot] - (ends - lengths), lengths)
        rows = np.searchsorted(starts, offsets)
        return self.pool[where], np.append(0, ends)[rows]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    return PieceEncoder(path)
