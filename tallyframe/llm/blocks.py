"""Numpy views of Arrow text columns: bounded blocks, words, word hashes and word shingles.

Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]``. All arithmetic is on whole blocks;
a block holds at most ``BLOCK_BYTES`` of text unless one single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 4096
SHINGLE_WORDS = 5

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (three xor-shifts, two odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = salts(256, 11)
_STEP = int(salts(1, 12)[0]) | 1
_PLACE = salts(SHINGLE_WORDS + 1, 13) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the odd step modulo 2**64, at least ``n`` of them."""
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        out = np.full(size, _STEP, dtype=np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers


@dataclass
class Block:
    """Some rows of a batch: the bytes of their texts, and where each text begins and ends."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks. A null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, where, raw = texts.buffers()
        offsets = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(texts), first + BLOCK_ROWS)
            at = offsets[first : last + 1]
            yield Block(batch.slice(first, last - first), data[at[0] : at[-1]], at - at[0])
            first = last


@dataclass
class Words:
    """Words of a block in order: byte ranges, their text's number, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    bounds: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    n = len(data)
    if not n:
        return Words(*(np.zeros(0, dtype=np.int64) for _ in range(3)), np.zeros(len(offsets), dtype=np.int64))
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    return Words(starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds)


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hash of each word's bytes: sum of byte salts times powers of an odd step, then mixed with its length."""
    if not len(words.starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = words.ends - words.starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    value = _BYTE[data[place + np.repeat(words.starts, lengths)]] * powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, after lower-casing A-Z.

    A shingle is ``k`` consecutive words; a text of fewer words has its whole sequence as the only one, a text
    without words has none.
    """
    low = LOWER[data]
    words = split_words(low, offsets)
    h = hash_words(low, words)
    out = []
    size = np.diff(words.bounds)
    if len(h) >= k:
        runs = sum((h[i : len(h) - k + 1 + i] * _PLACE[i] for i in range(1, k)), h[: len(h) - k + 1] * _PLACE[0])
        runs = mix64(runs)
    for i, n in enumerate(size):
        a = words.bounds[i]
        if n >= k:
            out.append(np.unique(runs[a : a + n - k + 1]))
        elif n:
            parts = np.append(h[a : a + n] * _PLACE[:n], _PLACE[k:] * np.uint64(n))
            out.append(mix64(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
