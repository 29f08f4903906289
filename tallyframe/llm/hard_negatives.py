"""Hard negatives by slot-decomposed selection.

A row's score is its integer inner product with an anchor, components being ``floor(256 * x)``. The ``positives`` best
rows of the anchor's own label are its positives; each asks for the best rows of other labels whose scores lie between
``low`` and ``high`` hundredths of its own. The upper limits of an anchor's positives cut the scores into disjoint slots:

* every task keeps the best few rows of each slot (a combiner), then slots are merged across tasks;
* in descending order the slots of one anchor form one list, of which a positive's window is a suffix from its own
  slot on, cut at its lower limit: overlapping windows are all answered from the same few rows.

Anchors are read in groups of ``ANCHORS_PER_PASS``, in order of their place in the table; a group is sent to all tasks
(its size is bounded by that number), and the rows themselves never shuffle. All pairs of anchors and rows are scored.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; of vectors of
unequal length the shorter counts as ended by zeros; a null id is the largest in ties and marks no anchor; rows that
repeat an id, whole or in part, are rows of their own (so a copy of an anchor may be its positive); positives
whose window is empty give no row; an empty table gives an empty table; extra columns are ignored. A score beyond 64 bits is
an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

SCALE = 256.0
ANCHORS_PER_PASS = 16_384
ROWS_AT_ONCE = 1024
ANCHORS_AT_ONCE = 2048
NO_ID = (1 << 63) - 1
LEAST = np.iinfo(np.int64).min
FOUND = "anchor long, list int, row long, id long, score long"


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, is_anchor: Column) -> DataFrame:
    """Rows that take part: _row (fixed by the write), _id, _label, _v and whether they are anchors."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return cut_lineage(
        vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
            F.monotonically_increasing_id().alias("_row"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
            F.col(label_col).cast("long").alias("_label"),
            F.col(vector_col).cast("array<double>").alias("_v"),
            F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("_anchor"),
        )
    )


def _column(data, name: str) -> np.ndarray:
    column = data.column(data.schema.get_field_index(name))
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _matrix(data, name: str = "_v") -> np.ndarray:
    """Scaled components, one row per vector; shorter vectors end in zeros."""
    lists = data.column(data.schema.get_field_index(name))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * width < 2.0**53:  # every partial sum is exact in a double
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object) for m in (a, b)]
    return np.dot(whole[0], whole[1].T).astype(np.int64)  # raises beyond 64 bits


class Best:
    """The ``k`` best entries of each list: higher scores first, then smaller ids, then earlier rows."""

    def __init__(self, k: int, lists: int):
        self.k = k
        self.kth = np.full(lists, LEAST)
        self.entries = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        near = score >= self.kth[which]
        new = [x[near] for x in (which, score, ids, rows)]
        which, score, ids, rows = (np.concatenate([a, b]) for a, b in zip(self.entries, new))
        order = np.lexsort((rows, ids, ~score, which))
        which = which[order]
        begin = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(which)) - np.repeat(begin, np.diff(np.append(begin, len(which))))
        kept = order[place < self.k]
        self.entries = which[place < self.k], score[kept], ids[kept], rows[kept]
        full = place == self.k - 1
        self.kth[which[full]] = score[order[full]]


class Anchors:
    """A group of anchors, held by every task."""

    def __init__(self, table: pa.Table):
        self.rows = _column(table, "_row").astype(np.int64)
        self.labels = _column(table, "_label").astype(np.int64)
        self.vectors = _matrix(table)
        his = table.column("_his").to_pylist() if "_his" in table.column_names else []
        self.slots = max(map(len, his), default=0)
        self.his = np.full((len(his), self.slots), LEAST)  # descending upper limits
        for i, x in enumerate(his):
            self.his[i, : len(x)] = x
        self.low = _column(table, "_low").astype(np.int64) if his else None

    def pieces(self, batches: Iterator[pa.RecordBatch]):
        """First anchor, scores, and ids, rows and labels of some rows of the table."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                v = _matrix(part)
                names = [_column(part, c).astype(np.int64) for c in ("_id", "_row", "_label")]
                for first in range(0, len(self.rows), ANCHORS_AT_ONCE):
                    yield first, scores(self.vectors[first : first + ANCHORS_AT_ONCE], v), *names

    def found(self, best: Best, per: int) -> pa.RecordBatch:
        which, score, ids, rows = best.entries
        columns = [pa.array(self.rows[which // per]), pa.array((which % per).astype(np.int32)), pa.array(rows), pa.array(ids), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "list", "row", "id", "score"])

    def positives(self, batches, k: int) -> Iterator[pa.RecordBatch]:
        best = Best(k, len(self.rows))
        for first, s, ids, rows, labels in self.pieces(batches):
            own = slice(first, first + len(s))
            fits = (self.labels[own, None] == labels) & (self.rows[own, None] != rows)
            bar = best.kth[own]
            if s.shape[1] > k:
                bar = np.maximum(bar, np.partition(np.where(fits, s, LEAST), -k, axis=1)[:, -k])
            a, r = np.nonzero(fits & (s >= bar[:, None]))
            best.add(a + first, s[a, r], ids[r], rows[r])
        yield self.found(best, 1)

    def negatives(self, batches, k: int) -> Iterator[pa.RecordBatch]:
        best = Best(k, len(self.rows) * self.slots)
        for first, s, ids, rows, labels in self.pieces(batches):
            own = slice(first, first + len(s))
            fits = (self.labels[own, None] != labels) & (s <= self.his[own, :1]) & (s >= self.low[own, None])
            a, r = np.nonzero(fits)
            score = s[a, r]
            slot = (score[:, None] <= self.his[a + first]).sum(axis=1) - 1
            best.add((a + first) * self.slots + slot, score, ids[r], rows[r])
        yield self.found(best, max(self.slots, 1))


def _search(rows: DataFrame, group: pa.Table, kind: str, k: int) -> DataFrame:
    """The ``k`` best of every list of the group, over all rows."""
    held = rows.sparkSession.sparkContext.broadcast(group)  # ANCHORS_PER_PASS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from getattr(Anchors(held.value), kind)(batches, k)

    found = rows.select("_row", "_id", "_label", "_v").mapInArrow(run, FOUND)
    place = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop("_place")


def _groups(rows: DataFrame, size: int) -> Iterator[pa.Table]:
    """Anchors in order of their rows, ``size`` at a time."""
    last = -1
    while True:
        group = rows.where(F.col("_anchor") & (F.col("_row") > last)).orderBy("_row").limit(size).drop("_anchor", "_id").toArrow()
        if not group.num_rows:
            return
        last = group.column("_row")[-1].as_py()
        yield group


def _limits(score: Column, low: int, high: int) -> tuple[Column, Column]:
    """Least and greatest score within ``low`` and ``high`` hundredths of ``score``."""
    wide = score.cast("decimal(20,0)")
    return F.ceil(wide * low / 100).cast("long"), F.floor(wide * high / 100).cast("long")


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchors_per_pass: int = ANCHORS_PER_PASS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = usable_rows(vectors, id_col, vector_col, label_col, is_anchor)
    least, most = _limits(F.col("score"), low, high)
    parts = []
    for group in _groups(rows, anchors_per_pass):
        own = cut_lineage(_search(rows, group, "positives", positives).withColumn("_lo", least).withColumn("_hi", most))
        limits = own.where("_lo <= _hi").groupBy("anchor").agg(
            F.sort_array(F.collect_set("_hi"), asc=False).alias("_his"), F.min("_lo").alias("_low")
        )
        asked = {r.anchor: (r._his, r._low) for r in limits.toLocalIterator()}  # an entry per anchor of the group
        keep = pa.array([r in asked for r in group.column("_row").to_pylist()], pa.bool_())
        searched = group.filter(keep)
        if not searched.num_rows:
            continue
        order = searched.column("_row").to_pylist()
        searched = searched.append_column("_his", pa.array([asked[r][0] for r in order], pa.list_(pa.int64())))
        searched = searched.append_column("_low", pa.array([asked[r][1] for r in order], pa.int64()))
        slots = _search(rows, searched, "negatives", negatives)
        down = F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("down"), "id", "row", "score")))
        lists = slots.groupBy("anchor").agg(down.alias("_all"))  # slots x negatives entries at most
        window = F.filter("_all", lambda x: (x["score"] <= F.col("_hi")) & (x["score"] >= F.col("_lo")))
        answered = own.join(lists, "anchor").select("anchor", "id", "score", F.posexplode(F.slice(window, 1, negatives)).alias("_at", "_n"))
        parts.append(cut_lineage(answered))
    if not parts:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = reduce(DataFrame.unionByName, parts)
    anchors = rows.where("_anchor").select(F.col("_row").alias("anchor"), F.col("_id").alias("anchor_id"))

    def named(c):
        return F.when(c != NO_ID, c)

    return found.join(anchors, "anchor").select(
        "anchor_id", named(F.col("id")).alias("positive_id"), (F.col("_at") + 1).cast("int").alias("rank"),
        named(F.col("_n.id")).alias("negative_id"), F.col("score").alias("positive_score"), F.col("_n.score").alias("negative_score"),
    )
