"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and every run of other characters becomes one boundary. The n-grams of one to ``LONGEST``
characters that hold no boundary inside (one may stand at either end) are hashed into ``BUCKETS`` columns. Counts per
language and bucket are sums over all training rows; smoothed log-probabilities form a matrix of languages by buckets
that is broadcast for ``LANGUAGES_PER_PASS`` languages at a time (at most 2 MB), and each pass scores whole blocks of
texts as sparse rows against it. A language wins if its score is the highest, ties go to the smaller name.

``score`` is the posterior of the predicted language among all learned ones.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned; a null
language teaches nothing; a null id is outside the held-out fold; an empty table gives an empty table; rows that
repeat are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.blocks import Block, blocks, mix64, salts
from tallyframe.session import cut_lineage

LONGEST = 4
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
LANGUAGES_PER_PASS = 16
CHARS_AT_ONCE = 1 << 19
SMOOTHING = 0.5
UNKNOWN = "und"
_STEPS = salts(LONGEST, 31) | np.uint64(1)

_letters = np.full(0x110000, -1, dtype=np.int32)  # lower-cased letter, 0 for anything else; filled when first met


def folded(points: np.ndarray) -> np.ndarray:
    """Lower-cased letters, 0 for other characters."""
    out = _letters[points]
    if (out < 0).any():
        for p in np.unique(points[out < 0]).tolist():
            c = chr(p)
            _letters[p] = ord(c.lower()[0]) if c.isalpha() else 0
        out = _letters[points]
    return out


def letter_stream(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single boundaries (0) around every run, and where each text begins."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])  # code points before each byte
    at = heads[block.offsets]
    n = len(at) - 1
    # a boundary before every text, so that none runs into the next
    line = np.zeros(len(points) + n + 1, dtype=np.int32)
    line[np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = folded(points)
    starts = at + np.arange(n + 1)
    kept = line != 0
    kept[1:] |= line[:-1] != 0
    kept[starts] = True
    return line[kept], np.concatenate([[0], np.cumsum(kept)])[starts]


def grams(stream: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and bucket of the n-grams of each length, a bounded part of the stream at a time."""
    for first in range(0, max(len(stream), 1), CHARS_AT_ONCE):
        part = stream[first : first + CHARS_AT_ONCE + LONGEST - 1].astype(np.uint64)
        own = min(CHARS_AT_ONCE, len(stream) - first)
        if own <= 0:
            return
        letter = part != 0
        h = np.zeros(own, dtype=np.uint64)
        whole = np.ones(own, dtype=bool)  # no boundary inside so far
        for n in range(LONGEST):
            reach = min(own, len(part) - n)
            if reach <= 0:
                break
            h = (h[:reach] + part[n : n + reach] + np.uint64(1)) * _STEPS[n]
            whole = whole[:reach] & letter[n - 1 : n - 1 + reach] if n >= 2 else whole[:reach]
            begin = np.flatnonzero(whole if n >= 2 else letter[:reach] | letter[n : n + reach])
            yield begin + first, (mix64(h[begin]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def count_grams(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows with a language; bucket -1 counts the rows themselves."""
    known = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flushed():
            for name, counts in held.items():
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(seen)), pa.array((seen - 1).astype(np.int32)), pa.array(counts[seen])], names=["lang", "bucket", "n"])
            held.clear()

        for block in blocks(batches):
            names = block.rows.column(0).to_pylist()
            here = sorted(set(names))
            place = {name: i for i, name in enumerate(here)}
            own = np.array([place[name] for name in names], dtype=np.int64)
            stream, starts = letter_stream(block)
            counts = np.zeros((len(here), BUCKETS + 1), dtype=np.int64)
            counts[:, 0] = np.bincount(own, minlength=len(here))
            for begin, bucket in grams(stream):
                text = np.searchsorted(starts, begin, side="right") - 1
                key = own[text] * (BUCKETS + 1) + bucket + 1
                counts += np.bincount(key, minlength=counts.size).reshape(counts.shape)
            for i, name in enumerate(here):
                held[name] = held[name] + counts[i] if name in held else counts[i]
            if len(held) > LANGUAGES_PER_PASS:
                yield from flushed()
        yield from flushed()

    return known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_matrix(language: np.ndarray, bucket: np.ndarray, count: np.ndarray, languages: int, rows: int) -> np.ndarray:
    """Log-probabilities of the buckets per language; the last column is that of the language itself."""
    n = np.zeros((languages, BUCKETS + 1))
    n[language, np.where(bucket < 0, BUCKETS, bucket)] = count
    seen = n[:, :BUCKETS]
    p = np.log(seen + SMOOTHING) - np.log(seen.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    prior = np.log(np.maximum(n[:, BUCKETS:], 1) / max(rows, 1))
    return np.concatenate([p, prior], axis=1).astype(np.float32)


def block_scores(block: Block, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text whether it has a letter, and its log score for every language."""
    stream, starts = letter_stream(block)
    n = len(block)
    total = np.repeat(matrix[:, BUCKETS].astype(np.float64)[None, :], n, axis=0)
    letters = np.diff(np.concatenate([[0], np.cumsum(stream != 0)])[starts]) > 0
    for begin, bucket in grams(stream):
        if not len(begin):
            continue
        text = np.searchsorted(starts, begin, side="right") - 1
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        own = text[first]
        for i in range(len(matrix)):
            total[own, i] += np.add.reduceat(matrix[i][bucket], first, dtype=np.float64)
    return letters, total


def _pass(rows: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """Rows with _best, _name and _sum (log of the summed scores) brought up to these languages."""
    held = rows.sparkSession.sparkContext.broadcast((names, matrix))  # LANGUAGES_PER_PASS languages at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, model = held.value
        for block in blocks(batches):
            letters, total = block_scores(block, model)
            here = total.argmax(axis=1)
            top = total[np.arange(len(block)), here]
            part = block.rows
            best = np.array(part.column(2).to_numpy(zero_copy_only=False), dtype=np.float64)
            before = part.column(3).to_pylist()
            summed = np.logaddexp(part.column(4).to_numpy(zero_copy_only=False), top + np.log(np.exp(total - top[:, None]).sum(axis=1)))
            better = letters & (top > best)
            name = [languages[h] if b else o for h, b, o in zip(here.tolist(), better.tolist(), before)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.where(better, top, best)), pa.array(name, pa.string()), pa.array(summed)],
                schema=part.schema)

    return rows.mapInArrow(run, rows.schema)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Written table of the counts of every learned language."""
    return cut_lineage(count_grams(rows, text_col, lang_col))


def _groups(counts: DataFrame, size: int) -> Iterator[tuple[list[str], pa.Table]]:
    """Languages in order of their names, ``size`` at a time, with their counts."""
    last = None
    names = counts.where("bucket = -1")
    while True:
        left = names if last is None else names.where(F.col("lang") > last)
        group = [r.lang for r in left.orderBy("lang").limit(size).collect()]  # ``size`` names
        if not group:
            return
        last = group[-1]
        held = counts.where(F.col("lang").between(group[0], last)).toArrow()  # ``size`` x BUCKETS rows at most
        yield group, held


def predict(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_pass: int = LANGUAGES_PER_PASS) -> DataFrame:
    """One row per document: ``id_col``, lang_pred, score."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.lit(-math.inf).alias("_best"),
        F.lit(None).cast("string").alias("_name"), F.lit(-math.inf).alias("_sum"),
    )
    learned = counts.where("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    for names, held in _groups(counts, per_pass):
        place = {name: i for i, name in enumerate(names)}
        language = np.array([place[x] for x in held.column("lang").to_pylist()])
        matrix = log_matrix(language, held.column("bucket").to_numpy(), held.column("n").to_numpy(), len(names), learned)
        rows = _pass(rows, names, matrix)
    sure = F.when(F.col("_name").isNull(), F.lit(0.0)).otherwise(F.least(F.exp(F.col("_best") - F.col("_sum")), F.lit(1.0)))
    return rows.select(F.col("_id").alias(id_col), F.coalesce("_name", F.lit(UNKNOWN)).alias("lang_pred"), sure.alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Learn outside the held-out fold, then judge every document: ``id_col``, held_out, lang_pred, score."""
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = train(named.where(F.col("_id").isNotNull() & ~held_out("_id", folds)))
    judged = predict(named, counts, "_id")
    return judged.select(F.col("_id").alias(id_col), held_out("_id", folds).alias("held_out"), "lang_pred", "score")
