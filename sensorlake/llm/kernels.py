"""Vectorised text kernels that run inside Spark tasks on Arrow string buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All separators are ASCII, so
splitting the UTF-8 bytes splits the code points in the same places.  The distinct words of a buffer are
found by comparing bytes (a dictionary), and each gets two independent 64-bit hashes (SipHash under two keys),
which unlike a polynomial hash has no texts that are known to agree in it.  Word sequences get a hash of
their words' hashes, or (`gram_codes`) exact numbers within a buffer.  Buffers are cut into chunks of whole
documents so that the working arrays stay small whatever the Arrow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2 << 20

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of sequence hashes over the two word hashes.
SEQ_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Keys of the two word hashes (SipHash takes 16 bytes).
KEYS = ("sensorlake-words", "second-word-hash")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs give unrelated outputs."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA3B195354A39B70D)
    x ^= x >> U64(32)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@dataclass
class Chunk:
    """Some consecutive documents: their bytes and where each document and each word lies."""

    first_row: int
    data: np.ndarray  # uint8
    bounds: np.ndarray  # document i is data[bounds[i]:bounds[i + 1]]
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    word_bounds: np.ndarray  # document i has words word_bounds[i]:word_bounds[i + 1]

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    _known: dict = field(default_factory=dict, repr=False)

    def codes(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """The number of each word among the distinct words of the chunk, and these."""
        if lower not in self._known:
            inside = self.data[_WORD[self.data]]
            inside = _LOWER[inside] if lower else inside
            offsets = np.zeros(len(self.starts) + 1, dtype=np.int64)
            np.cumsum(self.ends - self.starts, out=offsets[1:])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])
            found = words.dictionary_encode()
            self._known[lower] = found.indices.to_numpy(zero_copy_only=False), found.dictionary
        return self._known[lower]

    def word_hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        codes, words = self.codes(lower)
        if (which, lower) not in self._known:
            own = pd.util.hash_array(words.to_numpy(zero_copy_only=False), hash_key=KEYS[which], categorize=False)
            self._known[which, lower] = own[codes]
        return self._known[which, lower]

    def gram_codes(self, k: int, lower: bool = False) -> np.ndarray:
        """A number of every run of k consecutive words; two are equal exactly if the words are (document borders are the caller's)."""
        ones = self.codes(lower)[0].astype(np.int64)
        if len(ones) < k:
            return ones[:0]
        out, length = ones, 1
        for bit in bin(k)[3:]:
            out, length = _paired(out[:-length], out[length:]), 2 * length
            if bit == "1":
                out, length = _paired(out[:-1], ones[length:]), length + 1
        return out


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (x, y)."""
    return pd.factorize(x * (int(y.max(initial=0)) + 1) + y)[0].astype(np.int64)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, bounds


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column (null: empty) into chunks of whole documents."""
    if not len(column):
        return
    raw, bounds = _buffer(column)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(bounds, bounds[row] + max_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield spans(raw[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row], row)
        row = stop


def whole(column: pa.Array) -> Chunk:
    """A string column as one chunk."""
    raw, bounds = _buffer(column)
    return spans(raw[bounds[0] : bounds[-1]], bounds - bounds[0])


def spans(data: np.ndarray, bounds: np.ndarray, first_row: int = 0) -> Chunk:
    word = _WORD[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[bounds[bounds < len(data)]] = False
    after[bounds[bounds > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return Chunk(first_row, data, bounds, starts, ends, np.searchsorted(starts, bounds))


def sequence_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive entries of words (document borders are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    multiplier = U64(SEQ_MULTIPLIERS[which])
    out = words[:n].copy()
    for j in range(1, k):
        out *= multiplier
        out += words[j : j + n]
        if j % 64 == 63:  # long runs are no polynomials modulo 2**64 of their words
            out = mix64(out)
    return mix64(out)


def short_sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a document of fewer words than a shingle; the length is part of it."""
    value = U64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            value = value * U64(SEQ_MULTIPLIERS[1]) + w
    return mix64(np.array([value], dtype=U64))


def shingle_sets(chunk: Chunk, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a shorter document is one shingle, an empty one none."""
    words = chunk.word_hashes(lower=lower)
    grams = sequence_hashes(words, k)
    for i in range(chunk.n_docs):
        a, b = chunk.word_bounds[i], chunk.word_bounds[i + 1]
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield short_sequence_hash(words[a:b])
        else:
            yield words[:0]


def exact_sets(chunk: Chunk, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The same sets as numbers that stand for the words themselves; they compare within the chunk only."""
    grams, short = chunk.gram_codes(k, lower), {}
    codes = chunk.codes(lower)[0]
    for i in range(chunk.n_docs):
        a, b = chunk.word_bounds[i], chunk.word_bounds[i + 1]
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield np.array([-1 - short.setdefault(codes[a:b].tobytes(), len(short))])
        else:
            yield grams[:0]


def winnow(chunk: Chunk, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of words that lies in one document: its first word, its document's place in the
    chunk and the place of its leftmost minimal gram; equal windows have equal minimal grams.  And all grams."""
    words = chunk.word_hashes()
    sizes = np.diff(chunk.word_bounds)
    n_windows = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(chunk.n_docs), n_windows)
    first = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = first + chunk.word_bounds[:-1][doc]
    grams = sequence_hashes(words, gram)
    if not len(at):
        return at, doc, at, grams
    width = window - gram + 1
    best, place = grams.copy(), np.arange(len(grams))
    for j in range(1, width):  # strict comparison keeps the leftmost
        shifted = grams[j:]
        less = shifted < best[: len(shifted)]
        best[: len(shifted)][less] = shifted[less]
        place[: len(shifted)][less] = np.flatnonzero(less) + j
    return at, doc, place[at], grams
