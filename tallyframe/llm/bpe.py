"""Byte-level BPE by backtracking, in time linear in the text.

An Aho-Corasick automaton gives the longest token at every place of a word. Tokens are tried longest first; a
neighbour is accepted if the pair is compatible, that is if merging by rank would never join across the two. As each
prefix of a word has one valid last token, a place that fails is never tried again, and the result equals that of the
merge rules. Compatible pairs are kept in a table that grows as pairs are met. Decoding gathers bytes by an offset
table. Words met before are looked up in a bounded cache.

The vocabulary file is read once by the driver and broadcast (its size is that of the vocabulary, not of the data).

Defined results: a null or empty text has no tokens; repeated rows are encoded each for itself; a text of one very
long word is one word; existing columns named ``n_tokens``, ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.llm.blocks import blocks

# Fixed value: how the byte-level vocabulary cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 300_000
CACHE_PAIRS = 1_000_000
NEVER = 1 << 62


@dataclass
class Vocabulary:
    """Token bytes by id, merges as (left id, right id, merged id) in order of rank, and the special tokens."""

    tokens: list[bytes]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]
    key: str = ""


def byte_letters() -> dict[str, int]:
    """Printable letters that stand for bytes in a byte-level vocabulary: Latin-1 ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    letters = byte_letters()
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for word, i in ids.items():
        tokens[i] = bytes(letters[c] for c in word)
    for word, i in special.items():
        tokens[i] = word.encode()
    merges = []
    for pair in spec["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((ids[a], ids[b], ids[a + b]))
    return Vocabulary(tokens, merges, special, hashlib.sha256(raw).hexdigest())


class Encoder:
    """Tables of one vocabulary in one Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.special = vocabulary.special
        self.length = [len(t) for t in vocabulary.tokens]
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = [-1] * len(vocabulary.tokens)
        for r, (a, b, t) in enumerate(vocabulary.merges):
            self.merged[a, b] = r
            if t not in self.parts:
                self.parts[t], self.rank[t] = (a, b), r
        marks = set(vocabulary.special.values())
        ordinary = {t.decode("latin-1"): i for i, t in enumerate(vocabulary.tokens) if t and i not in marks}
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        usable = {i for i in ordinary.values() if self._stands(i)}
        self.automaton = ahocorasick.Automaton()
        for text, i in ordinary.items():
            if i in usable:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(vocabulary.tokens)
        for text, i in ordinary.items():
            for n in range(len(text) - 1, 0, -1):
                j = ordinary.get(text[:n])
                if j is not None and j in usable:
                    self.shorter[i] = j
                    break
        self.words = regex.compile(WORDS)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = np.frombuffer(b"".join(vocabulary.tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.cache = Cache(self)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces at one end of a token while it is built, each with the rank at which a larger piece takes it up."""
        known = self._spines.get((token, side))
        if known is None:
            known, until = [], NEVER
            while True:
                known.append((token, until))
                if token not in self.parts:
                    break
                until, token = self.rank[token], self.parts[token][side]
            self._spines[known[0][0], side] = known
        return known

    def _apart(self, left: int, right: int, limit: int = NEVER) -> bool:
        """Whether no merge of rank under ``limit`` joins the end of ``left`` with the beginning of ``right``.

        Of equal ranks the left one merges first, so a piece on the left is gone at its own rank, one on the right is not.
        """
        for a, until_a in self._spine(left, 1):
            for b, until_b in self._spine(right, 0):
                r = self.merged.get((a, b))
                if r is not None and r < until_a and r <= until_b and r < limit:
                    return False
        return True

    def _stands(self, token: int) -> bool:
        """Whether the merge rules make this token from its own bytes."""
        stack = [token]
        while stack:
            t = stack.pop()
            if t in self.parts:
                a, b = self.parts[t]
                if not self._apart(a, b, self.rank[t]):
                    return False
                stack += (a, b)
        return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(left, right)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        length, shorter, n = self.length, self.shorter, len(word)
        longest = [-1] * n
        for end, token in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        place, token = 0, longest[0]
        while place < n:
            end = place + length[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                place = end
                token = longest[place] if place < n else -1
                continue
            token = shorter[token]
            while token < 0:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_at[place] = 0
                last = out.pop()
                place -= length[last]
                token = shorter[last]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.cache.__getitem__
        if self.marks is None or not any(m in text for m in self.special):
            return b"".join(map(get, self.words.findall(text)))
        out = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
            else:
                out += map(get, self.words.findall(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and how many each id has."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.offsets[ids] - (ends - size), size)
        return self.bytes[source], size


class Cache(dict):
    """Word to the bytes of its ids; emptied when it has ``CACHE_WORDS`` entries."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encoder.encode_word(word.encode()), dtype="<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    key = shared.value[-1]
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(*shared.value))
    return _encoders[key]


def put_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added; existing ones of these names go."""
    keep = [n for n in batch.schema.names if n not in new]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in keep]
    return pa.RecordBatch.from_arrays([*arrays, *new.values()], names=[*keep, *new])


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit); with ``decoded`` also the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(read_vocabulary(vocabulary)))
    new = ["n_tokens", "ids", *["decoded"] * decoded]
    kinds = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType()}
    schema = T.StructType([f for f in docs.schema.fields if f.name not in new] + [T.StructField(n, kinds[n]) for n in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for block in blocks(batches, text_col):
            ids = [encoder.encode(block.text(i).decode()) for i in range(len(block))]
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            columns = {"n_tokens": pa.array(counts), "ids": pa.array(ids, pa.binary())}
            if decoded:
                data, size = encoder.decode(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64))
                token_ends = np.concatenate([[0], np.cumsum(size)])
                ends = token_ends[np.concatenate([[0], np.cumsum(counts)])]
                columns["decoded"] = pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())
            yield put_columns(block.rows, columns)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids in ``ids_col``. Null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(astuple(read_vocabulary(vocabulary)))
    schema = T.StructType([f for f in tokens.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist():
                data, _ = encoder.decode(np.frombuffer(x or b"", dtype="<u4").astype(np.int64))
                out.append(data.tobytes().decode("utf-8", "replace"))
            yield put_columns(batch, {"decoded": pa.array(out, pa.string())})

    return tokens.mapInArrow(run, schema)
