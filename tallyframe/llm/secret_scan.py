"""Secret scan: fixed patterns, and a battery of randomness tests on every other long token.

A token is a run of 20 or more of ``[A-Za-z0-9+/_=-]`` that mixes digits with letters. Its encoding is inferred from
its letters (hex, base32, base36, base64), and three tests are made against a uniform alphabet of that encoding:
chi-squared of the letter counts, runs above and below the middle of the alphabet, and lag-1 serial correlation. Their
p-values are combined by Fisher's rule. The null is the running text of all documents: what stands outside of such
tokens, without the letters that the encoding lacks, cut into windows of nine lengths and tested alike. A
token's p-value is the share of windows of its encoding and length (with shorter ones, until there are
``NULL_WINDOWS``) that look as random or more. Where fewer than ``TAIL`` do, it is read from an exponential tail through
the ``TAIL`` most random windows, so it has no floor by their number. Benjamini-Hochberg over all tokens
of the corpus then gives the flagged classes (encoding by length by evidence). Both tables have a fixed number of
cells, so they are of the same size for any input; counts cover all documents.

Defined results: null text counts as empty; each row is scanned for itself; a document without finds has zero counts,
empty spans and the hash of the empty text; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.blocks import Block, blocks
from tallyframe.session import cut_lineage

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINT = re.compile(rb"passw|secret|token|api_?key")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

TOKEN_BYTES = 20
LENGTHS = 32
GRADES = 128
RATE = 0.01
NULL_WINDOWS = 200
TAIL = 25

_HEX, _TOKEN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

ENCODINGS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
# The running text that an encoding is held against; where case is folded, one text serves both.
NULLS = {"hex": 0, "base32": 1, "lower": 2, "upper": 2, "base36": 3, "base64": 4}
_NULL_NAMES = ("hex", "base32", "lower", "base36", "base64")


def _values(name: str) -> np.ndarray:
    """Place in the alphabet of each byte of running text, -1 for bytes left out."""
    out = np.full(256, -1, dtype=np.int16)
    for v, c in enumerate(ENCODINGS[name]):
        out[ord(c)] = v
        if name != "base64":
            out[ord(c.swapcase())] = v
    if name == "base64":
        out[[ord("-"), ord("_")]] = out[[ord("+"), ord("/")]]
    return out


_VALUES = {name: _values(name) for name in _NULL_NAMES}
_KINDS = np.array([0, 21, 1, 13, 2, 31, 3, 8, 5])  # length classes of windows; others use the next below
_SPANS = TOKEN_BYTES + 4 * _KINDS
_ROUND = int(_SPANS.sum())
_BEGINS = np.stack([np.cumsum(x) - x for x in (np.roll(_SPANS, -k) for k in range(len(_KINDS)))])

SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
CELL = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def infer_encoding(token: str) -> str:
    """The smallest alphabet that holds the token's letters; case is folded where it is uniform."""
    letters = set(token.rstrip("=").replace("-", "+").replace("_", "/"))
    if letters <= _SETS["hex"] or {c.lower() for c in letters} <= _SETS["hex"] and not any(c.islower() for c in letters):
        return "hex"
    for name in ("lower", "upper", "base32", "base36"):
        if letters <= _SETS[name]:
            return name
    if letters <= _SETS["base36"] | {c.upper() for c in _SETS["base36"]} and not any(c.islower() for c in letters):
        return "base36"
    return "base64"


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(token: str) -> float:
    """Combined p-value that the token is uniform over its inferred alphabet; small for ordinary text."""
    encoding = infer_encoding(token)
    alphabet = ENCODINGS[encoding]
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if encoding == "hex" or encoding == "base36":
        body = body.lower()
    values = [v for v in map(alphabet.find, body) if v >= 0]
    n, k = len(values), len(alphabet)
    if n < 8:
        return 0.0
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    df = k - 1
    p_chi = _normal_tail(((max(chi, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [2 * v >= k for v in values]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    mid = sum(values) / n
    spread = sum((v - mid) ** 2 for v in values)
    serial = sum((x - mid) * (y - mid) for x, y in zip(values, values[1:])) / spread if spread else 1.0
    p_serial = 2 * _normal_tail(abs(serial * math.sqrt(n)))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def _normal_tails(z: np.ndarray) -> np.ndarray:
    """``_normal_tail`` of many values, to a relative error of 2e-7 (rational Chebyshev approximation of erfc)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = np.zeros_like(t)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = t * np.exp(-x * x + poly) / 2
    return np.where(z < 0, 1 - tail, tail)


def uniformities(values: np.ndarray, k: int) -> np.ndarray:
    """``uniformity`` of windows of one length, one a row, given as places in an alphabet of ``k``."""
    m, n = values.shape
    counts = np.bincount((np.arange(m)[:, None] * k + values).ravel(), minlength=m * k).reshape(m, k)
    chi = np.einsum("ij,ij->i", counts, counts) * (k / n) - n
    df = k - 1
    p_chi = _normal_tails(((np.maximum(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = 2 * values >= k
    a = high.sum(axis=1)
    b = n - a
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / max(1, n - 1)
    p_runs = np.where(var > 0, 2 * _normal_tails(np.abs(runs - mean) / np.sqrt(np.where(var > 0, var, 1))), 1.0)
    p_runs = np.where((a == 0) | (b == 0), 2.0 ** (1 - n), p_runs)
    off = values - values.mean(axis=1, keepdims=True)
    spread = np.einsum("ij,ij->i", off, off)
    serial = np.where(spread > 0, np.einsum("ij,ij->i", off[:, 1:], off[:, :-1]) / np.where(spread > 0, spread, 1), 1.0)
    p_serial = 2 * _normal_tails(np.abs(serial * math.sqrt(n)))
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return np.exp(-half) * (1 + half + half * half / 2)


def grade(p: float) -> int:
    """Evidence classes, 0 the most random."""
    return min(GRADES - 1, int(-4 * math.log10(max(p, 1e-300))))


def window_counts(data: np.ndarray, offsets: np.ndarray, tokens: np.ndarray) -> dict[int, int]:
    """Windows of the running text by cell. ``tokens`` marks the bytes that do not belong to it."""
    out: dict[int, int] = {}
    for e, name in enumerate(_NULL_NAMES):
        stream = _VALUES[name][data]
        stays = (stream >= 0) & ~tokens
        bounds = np.concatenate([[0], np.cumsum(stays)])[offsets]
        stream = stream[stays]
        begins: list[list[np.ndarray]] = [[] for _ in range(LENGTHS)]
        sizes = np.diff(bounds)
        phase = sizes % len(_KINDS)
        # windows follow each other through a text in rounds of all lengths; the text's size says with which a round begins
        for j in range(len(_KINDS)):
            c = _KINDS[(j + phase) % len(_KINDS)]
            first = _BEGINS[phase, j]
            fit = np.maximum(0, (sizes - first - TOKEN_BYTES - 4 * c) // _ROUND + 1)
            own = np.repeat(np.arange(len(sizes)), fit)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(fit) - fit, fit)
            at, kind = bounds[own] + first[own] + nth * _ROUND, c[own]
            for k in np.unique(kind):
                begins[k].append(at[kind == k])
        for c in range(LENGTHS):
            if begins[c]:
                at = np.concatenate(begins[c])
                p = uniformities(stream[at[:, None] + np.arange(TOKEN_BYTES + 4 * c)].astype(np.int64), len(ENCODINGS[name]))
                grades = np.minimum(GRADES - 1, (-4 * np.log10(np.maximum(p, 1e-300))).astype(np.int64))
                for g, n in zip(*np.unique(np.maximum(grades, 0), return_counts=True)):
                    out[(e * LENGTHS + c) * GRADES + int(g)] = int(n)
    return out


def _length_class(n: int) -> int:
    return min(LENGTHS - 1, (n - TOKEN_BYTES) // 4)


def token_cell(word: str) -> int:
    """Encoding, length and evidence of a token as one number."""
    return (NULLS[infer_encoding(word)] * LENGTHS + _length_class(len(word))) * GRADES + grade(uniformity(word))


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of runs of true within texts, of at least ``least`` bytes."""
    if not len(mask):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cut = np.zeros(len(mask) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], mask[:-1]]) & ~cut[:-1]
    after = np.concatenate([mask[1:], [False]]) & ~cut[1:]
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def scan_block(block: Block) -> tuple[list[list[dict]], list[list[dict]], dict[int, int]]:
    """Base spans and graded tokens of each text, and the block's null windows by cell."""
    data, offsets = block.data, block.offsets
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    base: list[list[dict]] = [[] for _ in range(len(block))]
    tokens: list[list[dict]] = [[] for _ in range(len(block))]
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    low = data.tobytes().lower()
    raw = data.tobytes()
    for i in sorted({int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in HINT.finditer(low)}):
        for m in ASSIGN.finditer(raw[offsets[i] : offsets[i + 1]].decode()):
            if len(m.group(2)) >= ASSIGN_CHARS:
                base[i].append({"kind": 0, "start": m.start(), "end": m.end()})
    if b"AKIA" in raw:
        for i in range(len(block)):
            for m in ACCESS.finditer(raw[offsets[i] : offsets[i + 1]].decode()):
                if m.end() - m.start() >= ACCESS_CHARS:
                    base[i].append({"kind": 1, "start": m.start(), "end": m.end()})
    for a, b in zip(*_runs(_HEX[data], offsets, HEX_CHARS)):
        i = int(np.searchsorted(offsets, a, side="right")) - 1
        base[i].append({"kind": 2, "start": int(points[a] - points[offsets[i]]), "end": int(points[b] - points[offsets[i]])})
    for spans in base:
        spans.sort(key=lambda s: (s["start"], s["kind"]))
    for a, b in zip(*_runs(_TOKEN[data], offsets, TOKEN_BYTES)):
        word = raw[a:b].decode()
        digits = any(c.isdigit() for c in word)
        if digits and any(c.isalpha() for c in word):
            inside[a] += 1
            inside[b] -= 1
            i = int(np.searchsorted(offsets, a, side="right")) - 1
            start, end = int(points[a] - points[offsets[i]]), int(points[b] - points[offsets[i]])
            if not any(s["start"] < end and start < s["end"] for s in base[i]):
                tokens[i].append({"cell": token_cell(word), "start": start, "end": end})
    return base, tokens, window_counts(data, offsets, np.cumsum(inside[:-1]) > 0)


def null_shares(counts: np.ndarray) -> np.ndarray:
    """Share of null windows that look as random as each grade or more; 1 without enough windows."""
    seen = counts.cumsum()
    total = int(seen[-1])
    if total < TAIL:
        return np.ones(len(counts))
    share = (1 + seen) / (1 + total)
    level = int(np.searchsorted(seen, TAIL))
    beyond = level - np.arange(level)
    # mean distance of the most random windows from the level, at least a grade; from the last grade on it is not known
    scale = max(1 + float((counts[:level] * beyond).sum()) / seen[level], level / 16)
    share[:level] = np.maximum(share[level] * np.exp(-beyond / scale), seen[:level] / (1 + total))
    return share


def flagged_cells(tokens: dict[int, int], null: dict[int, int], rate: float = RATE) -> list[int]:
    """Benjamini-Hochberg over all tokens, given how many tokens and null windows each cell has (encoding by length by grade)."""
    table = np.zeros((len(_NULL_NAMES), LENGTHS, GRADES), dtype=np.int64)
    for cell, n in null.items():
        table.reshape(-1)[cell] = n
    p = np.ones(table.shape)
    for e in range(len(_NULL_NAMES)):
        for c in range(LENGTHS):  # windows of this length, and of shorter ones until there are enough
            low = c
            while low and table[e, low : c + 1].sum() < NULL_WINDOWS:
                low -= 1
            p[e, c] = null_shares(table[e, low : c + 1].sum(axis=0))
    p = p.reshape(-1)
    order = sorted(tokens, key=lambda c: p[c])
    total, seen, cut = sum(tokens.values()), 0, -1.0
    for cell in order:
        seen += tokens[cell]
        if p[cell] <= rate * seen / total:
            cut = p[cell]
    return sorted(c for c in tokens if p[c] <= cut)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: ``id_col``, base and random, each an array of (kind, start, end) in code points, end exclusive."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        rows.schema["_id"], T.StructField("base", T.ArrayType(SPAN)), T.StructField("tokens", T.ArrayType(CELL)),
        T.StructField("null_cells", T.MapType(T.IntegerType(), T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        cells = pa.list_(pa.struct([("cell", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for block in blocks(batches):
            base, tokens, null = scan_block(block)
            nulls = [list(null.items())] + [None] * (len(block) - 1)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(base, spans), pa.array(tokens, cells), pa.array(nulls, pa.map_(pa.int32(), pa.int64()))],
                names=["_id", "base", "tokens", "null_cells"],
            )

    found = cut_lineage(rows.mapInArrow(run, schema))
    null = found.where("null_cells is not null").select(F.explode("null_cells").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n"))
    seen = found.select(F.explode("tokens").alias("t")).groupBy(F.col("t.cell").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = flagged_cells({r.cell: r.n for r in seen.collect()}, {r.cell: r.n for r in null.collect()}, rate)  # at most as many rows as cells
    flags = F.array(*[F.lit(c) for c in cells]).cast("array<int>")
    random = F.transform(
        F.filter("tokens", lambda t: F.array_contains(flags, t["cell"])),
        lambda t: F.struct(F.lit(3).alias("kind"), t["start"].alias("start"), t["end"].alias("end")),
    )
    return found.select(F.col("_id").alias(id_col), "base", random.alias("random"))
