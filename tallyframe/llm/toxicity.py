"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are first mapped to classes: insult, threat, target, negation, report. Insults are stems with weights learned
from labelled texts (how often a stem's words stand in toxic and in other texts); the other classes are fixed lists.
A clause is then read by one hand-written machine with a single reading (not a composition of transducers): negation turns the next insult's weight down for
three words, reported speech does so for the rest of the clause, a target turns insults up, a threat followed by a
target counts by itself. The weight of a clause is the sum over its insults and threats; line ends do not end a clause. A text's evidence is the sum over
matched clauses and their number per thousand words, turned into a probability by a logistic fit on the labels.

Stems are learned, and the curve is fitted, on at most ``FIT_ROWS`` labelled texts (those of smallest hash), a bound
that keeps the training set broadcastable; all documents are scored.

Defined results: a null or empty text scores as a text without matches; a doc_id with several labels is toxic if any
says so; without labels of both kinds every text scores ``NO_LABELS``; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.blocks import LOWER, Block, Words, blocks, hash_words, split_words
from tallyframe.session import cut_lineage

FIT_ROWS = 20_000
STEMS = 400
STEM_LENGTHS = (4, 5, 6, 7, 8)
NO_LABELS = 0.1

# Word classes of the grammar.
THREAT = "kill hurt destroy burn beat crush töten schlagen tuer frapper matar golpear".split()
TARGET = "you your he she they them this these du ihr dich er sie vous tu toi il elle usted ellos".split()
NEGATION = "not never no isn't aren't nicht kein nie pas jamais ne nunca".split()
REPORT = "said says called wrote claimed quoted sagte schrieb dit écrit dijo escribió".split()
INSULT, IS_THREAT, IS_TARGET, IS_NEGATION, IS_REPORT = range(1, 6)

CLAUSE_END = np.zeros(256, dtype=bool)
CLAUSE_END[list(b".,;:!?|")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True

# Weights of the composed machine's arcs.
NEGATED, REPORTED, TARGETED, THREATENED = 0.25, 0.4, 1.25, 1.0
REACH = 3


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 capitals in UTF-8."""
    out = LOWER[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    """Folded bytes with everything but letters blanked, and their words."""
    folded = fold(data)
    folded[~_LETTER[data]] = 32
    return folded, split_words(folded, offsets)


def hash_texts(words: list[bytes]) -> np.ndarray:
    """The hash that ``hash_words`` gives each of these."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return hash_words(data, Words(np.concatenate([[0], ends[:-1]]), ends, np.zeros(len(words), dtype=np.int64), np.zeros(2, dtype=np.int64)))


def stem_hashes(folded: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each stem length, numbers of the words that have it and the hashes of their stems; whole words last."""
    # a stem's length counts code points: byte ends are found from the running number of code points
    points = np.concatenate([[0], np.cumsum((folded & 0xC0) != 0x80)])
    where = np.flatnonzero((folded & 0xC0) != 0x80)
    where = np.concatenate([where, [len(folded)]])
    size = points[words.ends] - points[words.starts]
    for n in STEM_LENGTHS:
        has = np.flatnonzero(size >= n)
        cut = where[points[words.starts[has]] + n]
        yield has, hash_words(folded, Words(words.starts[has], cut, words.text[has], words.bounds))
    yield np.arange(len(words.starts)), hash_words(folded, words) ^ np.uint64(0x5555)


class Grammar:
    """Word classes by hash and the composed machine."""

    def __init__(self, stems: dict[int, float], whole: dict[int, float]):
        self.tables = [self._table(stems), self._table(whole)]
        fixed = [(w, c) for c, words in ((IS_THREAT, THREAT), (IS_TARGET, TARGET), (IS_NEGATION, NEGATION), (IS_REPORT, REPORT)) for w in words]
        hashes = hash_texts([w.encode() for w, _ in fixed])
        order = np.argsort(hashes)
        self.fixed = hashes[order]
        self.fixed_class = np.array([c for _, c in fixed], dtype=np.int8)[order]

    @staticmethod
    def _table(weights: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(weights), dtype=np.uint64)
        return keys, np.array([weights[int(k)] for k in keys], dtype=np.float64)

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def insults(self, folded: np.ndarray, words: Words) -> np.ndarray:
        """Weight of the longest matching stem of each word, a whole word before any stem."""
        weight = np.zeros(len(words.starts))
        parts = list(stem_hashes(folded, words))
        for i, (has, h) in enumerate(parts):
            keys, values = self.tables[i == len(parts) - 1]
            at, hit = self._find(keys, h)
            if hit.any():
                weight[has[hit]] = values[at[hit]]
        return weight

    def classes(self, folded: np.ndarray, words: Words) -> np.ndarray:
        at, hit = self._find(self.fixed, hash_words(folded, words))
        out = np.zeros(len(words.starts), dtype=np.int8)
        out[hit] = self.fixed_class[at[hit]]
        return out


def clause_weight(symbols: list[tuple[int, float]]) -> float:
    """Weight of one clause: (class, weight) per word, 0 for other words.

    The state is (words for which negation still reaches, reported or not, target seen or not, threat open or not);
    arcs multiply the weight of the insult read, and the machine sums over the insults of the clause.
    """
    negated, reported, target, threat, total = 0, False, False, False, 0.0
    for kind, weight in symbols:
        if kind == INSULT:
            total += weight * (NEGATED if negated else 1) * (REPORTED if reported else 1) * (TARGETED if target else 1)
        elif kind == IS_NEGATION:
            negated = REACH + 1
        elif kind == IS_REPORT:
            reported = True
        elif kind == IS_THREAT:
            threat = not negated
        elif kind == IS_TARGET:
            if threat:
                total += THREATENED * (REPORTED if reported else 1)
                threat = False
            target = True
        negated = max(0, negated - 1)
    return total


def evidence(block: Block, grammar: Grammar) -> np.ndarray:
    """For each text: sum of clause weights, best clause, matched clauses, matched clauses per thousand words."""
    folded, words = letter_words(block.data, block.offsets)
    out = np.zeros((len(block), 4))
    if not len(words.starts):
        return out
    weight = grammar.insults(folded, words)
    kinds = grammar.classes(folded, words)
    kinds[weight > 0] = INSULT
    # clause numbers: a word begins a new clause if an end mark or a new text lies between it and the word before
    marks = np.concatenate([[0], np.cumsum(CLAUSE_END[block.data])])
    change = np.concatenate([[True], (marks[words.starts[1:]] > marks[words.ends[:-1]]) | (np.diff(words.text) > 0)])
    clause = np.cumsum(change) - 1
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(clause)]])
    for c in np.unique(clause[(kinds == INSULT) | (kinds == IS_THREAT)]):
        a, b = first[c], last[c]
        w = clause_weight(list(zip(kinds[a:b].tolist(), weight[a:b].tolist())))
        if w > 0:
            row = out[words.text[a]]
            row[0] += w
            row[1] = max(row[1], w)
            row[2] += 1
    out[:, 3] = out[:, 2] * 1000 / np.maximum(np.diff(words.bounds), 1)
    return out


def features(e: np.ndarray) -> np.ndarray:
    """Inputs of the logistic curve."""
    return np.column_stack([np.ones(len(e)), np.log1p(e[:, 0]), e[:, 1], np.log1p(e[:, 3]), np.minimum(e[:, 2], 3)])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def in_fold(id_col, fold: int = 2, folds: int = 4):
    """Whether crc32 of the id as text leaves ``fold``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", limit: int = FIT_ROWS) -> DataFrame:
    """Texts with label outside the held-out fold: at most ``limit`` ids, those of smallest hash."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~in_fold(id_col))
    ids = ids.groupBy(id_col).agg(F.max("toxic").cast("int").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(limit)
    return docs.select(F.col(id_col), F.col("text")).join(F.broadcast(ids), id_col).select("text", "_y")  # limit ids at most


def learn_stems(rows: DataFrame, stems: int = STEMS) -> tuple[dict[int, float], dict[int, float]]:
    """Weights of stems and whole words: how much likelier texts with it are toxic, kept where this is clear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            folded, words = letter_words(block.data, block.offsets)
            y = np.array(block.rows.column(1).to_pylist(), dtype=np.int64)
            if not len(words.starts):
                continue
            parts = list(stem_hashes(folded, words))
            for i, (has, h) in enumerate(parts):
                if not len(h):
                    continue
                order = np.lexsort((words.text[has], h))
                hs, ts = h[order], words.text[has][order]
                new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])])
                hs, ts = hs[new], ts[new]
                begin = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begin), i == len(parts) - 1)), pa.array(hs[begin].view(np.int64)),
                     pa.array(np.full(len(begin), STEM_LENGTHS[i] if i < len(STEM_LENGTHS) else 99, dtype=np.int32)),
                     pa.array(np.add.reduceat(y[ts], begin)), pa.array(np.diff(np.concatenate([begin, [len(hs)]])))],
                    names=["whole", "h", "size", "bad", "n"],
                )

    counts = cut_lineage(rows.mapInArrow(run, "whole boolean, h long, size int, bad long, n long")
                         .groupBy("whole", "h", "size").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("bad")).first()
    if not whole.bad or whole.bad == whole.n:
        return {}, {}
    rate = whole.bad / whole.n
    odds = F.log((F.col("bad") + rate) / (F.col("n") - F.col("bad") + 1 - rate)) - math.log(rate / (1 - rate))
    excess = (F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    clear = counts.withColumn("w", odds).withColumn("z", excess).where("bad >= 3 and z >= 5 and w >= 1")
    best = clear.orderBy(F.desc("z"), "h").limit(stems).collect()  # at most ``stems`` rows
    return {r.h % (1 << 64): r.w for r in best if not r.whole}, {r.h % (1 << 64): r.w for r in best if r.whole}


def gather_evidence(rows: DataFrame, grammar, column: str = "text") -> DataFrame:
    """``rows`` without the text, with the columns e0 .. e3 of ``evidence``."""
    others = [c for c in rows.columns if c != column]
    schema = T.StructType([rows.schema[c] for c in others] + [T.StructField(f"e{i}", T.DoubleType()) for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Grammar(*grammar.value)
        for block in blocks(batches, column):
            e = evidence(block, machine)
            kept = [block.rows.column(block.rows.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(np.ascontiguousarray(e[:, i])) for i in range(4)]], names=[*others, *[f"e{i}" for i in range(4)]])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, held_out, score, clauses (matched)."""
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = training_rows(named.withColumnRenamed("_id", id_col), labels, id_col)
    stems = learn_stems(rows)
    grammar = docs.sparkSession.sparkContext.broadcast(stems)
    seen = gather_evidence(rows, grammar).toPandas()  # at most FIT_ROWS ids
    if not stems[0] and not stems[1] or seen["_y"].nunique() < 2:
        curve = [math.log(NO_LABELS / (1 - NO_LABELS)), 0.0, 0.0, 0.0, 0.0]
    else:
        curve = fit_curve(features(seen[[f"e{i}" for i in range(4)]].to_numpy()), seen["_y"].to_numpy(dtype=float)).tolist()
    out = gather_evidence(named, grammar)
    z = (F.lit(curve[0]) + F.log1p("e0") * curve[1] + F.col("e1") * curve[2] + F.log1p("e3") * curve[3]
         + F.least(F.col("e2"), F.lit(3.0)) * curve[4])
    return out.select(
        F.col("_id").alias(id_col), F.coalesce(in_fold("_id"), F.lit(False)).alias("held_out"),
        (F.lit(1.0) / (1 + F.exp(-z))).alias("score"), F.col("e2").cast("long").alias("clauses"),
    )
