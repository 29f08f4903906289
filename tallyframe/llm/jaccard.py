"""N-gram Jaccard join: documents whose shingle sets overlap in 75 of 100 parts, and their components.

1. Shingle sets are made per text and equal sets become one class; the rest concerns classes only.
2. Each class puts the first ``n - T + 1`` of its shingles (T: the least overlap with any partner) into inverted lists,
   in a common order that has frequent shingles last, by their counts over all texts. Lists of up to ``LIST`` classes give
   candidate pairs, counted over all lists; a pair goes on if its count and what may follow reach the required overlap.
   A longer list links its classes to one of them without a test, so candidates grow with the list and none is lost.
3. Components of candidates are clusters. The sets of a cluster meet in one task, up to ``BLOCK`` of them, and are
   searched by T-occurrence with DivideSkip: a query's short lists are merged and counted, candidates that can still
   reach T are probed in its long lists by binary search. Candidates already linked with the query are skipped, as
   only components are asked for.
4. Larger clusters are searched in blocks: each block by itself and against the first, then whatever is still
   apart from the largest component against all blocks. This is exact and linear unless much stays apart.

Which shingles count as frequent only orders the lists: any choice gives the same links. Sets are compared by 64-bit
shingle hashes, classes by 128 bits of their sets and the size.

Defined results: null and empty texts, and texts of white space, have an empty set and are linked with nothing; a text
of fewer words than a shingle has one element, the whole sequence; rows without id belong to no component (null)
but are counted; rows that repeat an id and text are one document, rows that
repeat an id with another text are another; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import bloom
from tallyframe.llm.blocks import blocks, mix64, shingle_sets
from tallyframe.llm.components import components
from tallyframe.llm.prefix import spread_count
from tallyframe.operators.skew import spread_join
from tallyframe.session import cut_lineage

LIST = 64
WINDOW = 1 << 20
OFTEN = 8
HOT_KEYS = 1 << 21
COUNT_BITS = 40
COUNT_SHARD = 1 << 22  # shingles per shard of the counts
BLOCK = 4096
PROBES = 64
MANY = 1 << 30
SKIP = 0.03

_UNCOUNTED = np.uint64(64 - COUNT_BITS)


def required(n: int) -> int:
    """Least overlap of a set of ``n`` with any partner."""
    return -(-3 * n // 4)


def set_marks(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(s):
        return 0, 0
    n = np.uint64(len(s) * 0x9E3779B97F4A7C15 % (1 << 64))
    one = mix64(np.array([s.sum(dtype=np.uint64)], dtype=np.uint64) ^ n)
    two = mix64(np.array([mix64(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)], dtype=np.uint64) + n)
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def shingle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: _id, n, f1, f2."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        rows.schema["_id"], T.StructField("n", T.IntegerType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = shingle_sets(block.data, block.offsets)
            marks = [set_marks(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                block.rows.column(0), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
            ], names=schema.names)

    return rows.mapInArrow(run, schema)


def shingle_levels(docs: DataFrame, shards: int, text_col: str = "text") -> DataFrame:
    """Shingles (``COUNT_BITS`` bits of their hash) in ``OFTEN`` classes or more, packed by level: level, size, keys.

    A level is twice the binary logarithm of the count. A class that several windows hold counts once in each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(list(window.values())) >> _UNCOUNTED, return_counts=True)
            shard = (keys % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, keys, times = shard[order], keys[order] // np.uint64(shards), times[order].astype(np.uint32)
            first, length = _runs(shard)
            ends = first + length
            return pa.RecordBatch.from_arrays([
                pa.array(shard[first].astype(np.int32)), pa.array(length.astype(np.int64)),
                pa.array([_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(first, ends)], pa.binary()),
                pa.array([_planes(times[a:b]) for a, b in zip(first, ends)], pa.binary()),
            ], names=["shard", "size", "keys", "times"])

        for block in blocks(batches, text_col):
            for s in shingle_sets(block.data, block.offsets):
                mark = set_marks(s)
                if len(s) and mark not in window:
                    window[mark] = s
                    held += len(s)
            if held >= 2 * WINDOW:
                yield flush()
                window, held = {}, 0
        if window:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for shard, n, keys, times in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                parts.setdefault(shard, []).append((np.cumsum(_whole(keys, n, np.uint64), dtype=np.uint64), _whole(times, n, np.uint32)))
        for shard in sorted(parts):
            keys, times = (np.concatenate([p[i] for p in parts[shard]]) for i in range(2))
            del parts[shard]
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            first, _ = _runs(keys)
            keys, times = keys[first] * np.uint64(shards) + np.uint64(shard), np.add.reduceat(times, first, dtype=np.int64)
            keys, level = keys[times >= OFTEN], np.floor(2 * np.log2(times[times >= OFTEN])).astype(np.int32)
            for x in np.unique(level):
                of = keys[level == x]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x], pa.int32()), pa.array([len(of)], pa.int64()), pa.array([_planes(np.diff(of, prepend=np.uint64(0)))], pa.binary()),
                ], names=["level", "size", "keys"])

    counted = docs.select(F.col(text_col)).mapInArrow(run, "shard int, size long, keys binary, times binary")
    return counted.repartition(shards, "shard").mapInArrow(total, "level int, size long, keys binary")


def frequent_shingles(levels: DataFrame, limit: int = HOT_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the highest levels, at most ``limit`` of them, sorted; and their levels. They only order the lists."""
    fixed = cut_lineage(levels)
    least, held = None, 0
    for x in fixed.groupBy("level").agg(F.sum("size").alias("n")).orderBy(F.desc("level")).collect():
        held += x.n
        if held > limit:
            break
        least = x.level
    rows = [] if least is None else fixed.where(F.col("level") >= least).collect()
    if not rows:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8)
    keys = np.concatenate([np.cumsum(_whole(bytes(x["keys"]), x["size"], np.uint64), dtype=np.uint64) for x in rows])
    level = np.repeat(np.array([x["level"] for x in rows], dtype=np.uint8), [x["size"] for x in rows])
    order = np.argsort(keys)
    return keys[order], level[order]


def list_head(s: np.ndarray, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The shingles of a set that go into lists: n - T + 1 of them, frequent ones last, the most frequent at the very end."""
    p = len(s) - required(len(s)) + 1
    if len(hot):
        key = s >> _UNCOUNTED
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        s = s[np.argsort(np.where(hot[at] == key, level[at], 0), kind="stable")]
    return s[:p]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.concatenate([first, [len(keys)]]))


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their bytes in planes, compressed: planes of high bytes that agree take next to nothing."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def _whole(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _pack(key: np.ndarray, ref: np.ndarray, size: np.ndarray, flag: np.ndarray) -> bytes:
    """Entries in order of ``key``: gaps of the keys, places in a table of the classes, that table, and the flags."""
    names, first, place = np.unique(ref, return_index=True, return_inverse=True)
    wide = np.uint16 if len(names) <= 1 << 16 else np.uint32
    parts = [_planes(np.diff(key, prepend=np.uint64(0))), _planes(place.astype(wide)), _planes(np.diff(names, prepend=np.uint64(0))),
             _planes(size[first].astype(np.uint32)), pa.compress(np.packbits(flag).tobytes(), codec="zstd", asbytes=True)]
    head = np.array([len(key), len(names), *[len(x) for x in parts]], dtype=np.int64)
    return head.tobytes() + b"".join(parts)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m, *sizes = np.frombuffer(blob, np.int64, 7).tolist()
    ends = np.cumsum([56, *sizes]).tolist()
    keys, places, names, widths, flags = (blob[a:b] for a, b in zip(ends, ends[1:]))
    place = _whole(places, n, np.uint16 if m <= 1 << 16 else np.uint32)
    flag = np.unpackbits(np.frombuffer(pa.decompress(flags, -(-n // 8), codec="zstd", asbytes=True), dtype=np.uint8))[:n].astype(bool)
    ref = np.cumsum(_whole(names, m, np.uint64), dtype=np.uint64)[place]
    return np.cumsum(_whole(keys, n, np.uint64), dtype=np.uint64), ref, _whole(widths, m, np.uint32)[place], flag


PAIR = "a long, b long, na int, nb int, c long"


def _pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    return pa.RecordBatch.from_arrays([
        pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), pa.array(c.astype(np.int64)),
    ], names=["a", "b", "na", "nb", "c"])


def _stars(keys: np.ndarray, refs: np.ndarray, sizes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of each member of the given runs with the run's first member."""
    total = int(length.sum())
    at = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
    head = np.repeat(first, length)
    own = at != head
    return refs[at[own]], refs[head[own]], sizes[at[own]], sizes[head[own]]


def inverted_lists(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], shards: int, text_col: str = "text") -> DataFrame:
    """List entries packed by shard: shard, blob of (shingle, class, size); or untested pairs of long local lists."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    schema = "shard int, blob binary, pairs array<struct<a:long,b:long,na:int,nb:int>>"
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32())]))

    def flush(heads: list[np.ndarray], refs: list[int], sizes: list[int]) -> pa.RecordBatch:
        count = np.array([len(h) for h in heads])
        key = np.concatenate(heads)
        ref = np.repeat(np.array(refs, dtype=np.int64).view(np.uint64), count)
        size = np.repeat(np.array(sizes, dtype=np.uint32), count)
        order = np.lexsort((ref, key))
        key, ref, size = key[order], ref[order], size[order]
        first, length = _runs(key)
        long = length > LIST
        pairs, flag = None, np.zeros(len(key), dtype=bool)
        if long.any():  # one entry stands for the list
            x, y, nx, ny = _stars(key, ref, size, first[long], length[long])
            pairs = [{"a": int(i), "b": int(j), "na": int(k), "nb": int(m)} for i, j, k, m in zip(x.view(np.int64), y.view(np.int64), nx, ny)]
            keep = np.repeat(~long, length)
            keep[first[long]] = True
            flag[first[long]] = True
            key, ref, size, flag = key[keep], ref[keep], size[keep], flag[keep]
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        key, ref, size, flag, shard = key[order], ref[order], size[order], flag[order], shard[order]
        first, length = _runs(shard)
        blobs = [_pack(key[a : a + n], ref[a : a + n], size[a : a + n], flag[a : a + n]) for a, n in zip(first, length)]
        return pa.RecordBatch.from_arrays([
            pa.array(shard[first].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array([pairs] + [None] * (len(blobs) - 1), pair),
        ], names=["shard", "blob", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        heads, refs, sizes, seen, held = [], [], [], set(), 0
        for block in blocks(batches, text_col):
            for s in shingle_sets(block.data, block.offsets):
                if not len(s):
                    continue
                mark = set_marks(s)
                if mark in seen:
                    continue
                seen.add(mark)
                heads.append(list_head(s, *often))
                refs.append(mark[0])
                sizes.append(len(s))
                held += len(heads[-1])
            if held >= WINDOW:
                yield flush(heads, refs, sizes)
                heads, refs, sizes, seen, held = [], [], [], set(), 0
        if heads:
            yield flush(heads, refs, sizes)

    return docs.select(F.col(text_col)).mapInArrow(run, schema)


def candidate_pairs(lists: DataFrame, shards: int) -> DataFrame:
    """Pairs of classes that may reach the required overlap: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for ready in batch.column(2).to_pylist():
                if ready:
                    cols = [np.array([p[k] for p in ready], dtype=np.int64) for k in ("a", "b", "na", "nb")]
                    yield _pairs(cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2], cols[3], np.full(len(ready), MANY))
            parts += [_unpack(b) for b in batch.column(1).to_pylist()]
        if not parts:
            return
        key, ref, size, flag = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        order = np.lexsort((flag, ref, key))
        key, ref, size, flag = key[order], ref[order], size[order], flag[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]) | (flag[1:] != flag[:-1])])
        key, ref, size, flag = key[new], ref[new], size[new], flag[new]
        first, length = _runs(key)
        if not len(first):
            return
        stands = np.logical_or.reduceat(flag, first)
        long = (length > 1) & ((length > LIST) | stands)
        if long.any():
            x, y, nx, ny = _stars(key, ref, size, first[long], length[long])
            yield _pairs(x, y, nx, ny, np.full(len(x), MANY))
        short = (length > 1) & ~long
        for m in np.unique(length[short]):
            begin = first[short & (length == m)]
            i, j = np.triu_indices(m, 1)
            step = max(1, (1 << 20) // len(i))
            for at in range(0, len(begin), step):
                x, y = ((begin[at : at + step, None] + k[None, :]).ravel() for k in (i, j))
                near = (np.minimum(size[x], size[y]).astype(np.int64) * 4 >= np.maximum(size[x], size[y]).astype(np.int64) * 3) & (ref[x] != ref[y])
                x, y = x[near], y[near]
                if len(x):
                    yield _pairs(ref[x], ref[y], size[x], size[y], np.ones(len(x)))

    met = lists.repartition(shards, "shard").mapInArrow(run, PAIR)
    pairs = met.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c"))
    rest = F.greatest(F.col("na") - F.floor(F.col("na") / 4) - 1, F.col("nb") - F.floor(F.col("nb") / 4) - 1)  # beyond the heads
    return pairs.where((F.col("a") != F.col("b")) & (7 * (F.col("c") + rest) >= 3 * (F.col("na") + F.col("nb")))).select("a", "b")


class Forest:
    """Union-find that keeps the smallest number as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = nxt
                return nxt
            up = nxt


def search(sets: list[np.ndarray], asks: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """Component roots of ``sets`` by links between those that ask and those that are held in the index."""
    n = len(sets)
    forest = Forest(n)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    index = np.flatnonzero(holds)
    if not len(index):
        return forest.roots()
    key = np.concatenate([sets[i] for i in index])
    doc = np.repeat(index, size[index])
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first, length = _runs(key)
    names = key[first]
    code = np.repeat(np.arange(len(first)), length) * n + doc  # sorted: list number, then set
    for q in np.flatnonzero(asks):
        s = sets[q]
        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
        lists = at[names[at] == s]
        least = required(len(s))
        if len(lists) < least:
            continue
        lists = lists[np.argsort(length[lists], kind="stable")]
        skip = min(int(least / (SKIP * np.log2(max(2, int(length[lists[-1]]))) + 1)), least - 1)
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        found = doc[np.concatenate([np.arange(first[i], first[i] + length[i]) for i in short])]
        count = np.bincount(found, minlength=n)
        able = np.flatnonzero(count >= least - skip)
        both = holds[q] & asks[able]
        able = able[(able != q) & (~both | (able > q)) & (4 * np.minimum(size[able], size[q]) >= 3 * np.maximum(size[able], size[q]))]
        able = able[np.argsort(-count[able], kind="stable")]
        while len(able):
            roots = forest.roots()
            able = able[roots[able] != roots[q]]
            now, able = able[:PROBES], able[PROBES:]
            if not len(now):
                break
            probes = (long[:, None] * n + now[None, :]).ravel()
            spot = np.minimum(np.searchsorted(code, probes), len(code) - 1)
            overlap = count[now] + (code[spot] == probes).reshape(len(long), len(now)).sum(axis=0)
            for d in now[7 * overlap >= 3 * (size[q] + size[now])]:
                forest.join(int(q), int(d))
    return forest.roots()


def search_tasks(rows: DataFrame) -> DataFrame:
    """Search every task of ``rows`` (task, node, set, asks, holds): task, node, root (smallest node linked with it there)."""
    node = rows.schema["node"].dataType
    schema = T.StructType([T.StructField("task", T.StringType()), T.StructField("node", node), T.StructField("root", node)])
    placed = rows.repartition(spread_count(rows), "task").sortWithinPartitions("task", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, sets, asks, holds = None, [], [], [], []

        def close() -> pa.RecordBatch:
            roots = search(sets, np.array(asks), np.array(holds))
            return pa.RecordBatch.from_arrays([
                pa.array([task] * len(nodes)), pa.array(nodes), pa.array([nodes[r] for r in roots]).cast(pa.array(nodes).type),
            ], names=schema.names)

        for batch in batches:
            for t, v, s, a, h in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if t != task:
                    if task is not None:
                        yield close()
                    task, nodes, sets, asks, holds = t, [], [], [], []
                if nodes and nodes[-1] == v:  # a class that several tasks have read
                    asks[-1], holds[-1] = asks[-1] or a, holds[-1] or h
                    continue
                nodes.append(v)
                sets.append(np.frombuffer(s, dtype=np.uint64))
                asks.append(a)
                holds.append(h)
        if task is not None:
            yield close()

    return placed.select("task", "node", "set", "asks", "holds").mapInArrow(run, schema)


def _class_sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sets of the classes in clusters: ``reps`` (f1, f2, id, node, cluster, _blocks) with ``set`` in place of the marks.

    A Bloom filter of the ids keeps most other texts from the join. A task gives a class once, whatever the number of
    its rows that repeat; several tasks may give it, and the search takes it once.
    """
    keyed = cut_lineage(reps.withColumn("_h", F.xxhash64("_id")))
    n = bloom.block_count(keyed.count())
    table = cut_lineage(bloom.build(keyed, "_h", n))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).withColumn("_h", F.xxhash64("_id"))
    maybe = bloom.flag(rows, "_h", table, n, "_maybe").where("_maybe").select("_id", "text")
    met = maybe.join(keyed.drop("_h"), "_id").select("node", "f1", "f2", "cluster", "_blocks", "text")
    schema = T.StructType([*[met.schema[c] for c in ("node", "cluster", "_blocks")], T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for block in blocks(batches):
            names = block.rows.column(0).to_pylist()
            marks = list(zip(block.rows.column(1).to_pylist(), block.rows.column(2).to_pylist()))
            same, sets = [], []
            for i, s in enumerate(shingle_sets(block.data, block.offsets)):
                if names[i] not in seen and set_marks(s) == marks[i]:  # another text of a repeated id is not the class's
                    seen.add(names[i])
                    same.append(i)
                    sets.append(s.tobytes())
            picked = pa.array(same, pa.int64())
            yield pa.RecordBatch.from_arrays([*[block.rows.column(c).take(picked) for c in (0, 3, 4)], pa.array(sets, pa.binary())], names=schema.names)

    return met.mapInArrow(run, schema)


def link_clusters(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Exact components inside clusters: node, component. ``sets``: cluster, node, set, _blocks (of ``block`` classes)."""
    sized = cut_lineage(sets)
    yes = F.lit(True)
    one = sized.where("_blocks = 1").select(F.col("cluster").cast("string").alias("task"), "node", "set", yes.alias("asks"), yes.alias("holds"))
    small = search_tasks(one).select("node", F.col("root").alias("component"))
    large = sized.where("_blocks > 1").withColumn("_b", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_blocks")))
    if large.isEmpty():
        return small
    # each block by itself, and the first as an index for all others
    where = F.explode(F.when(F.col("_b") == 0, F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).otherwise(F.array("_b"))).alias("_t")
    first = large.select("cluster", "node", "set", "_b", where).select(
        F.concat_ws(":", "cluster", "_t").alias("task"), "node", "set", (F.col("_b") == F.col("_t")).alias("asks"), yes.alias("holds"))
    links = cut_lineage(search_tasks(first).select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = cut_lineage(large.select("cluster", "node", "_blocks", "_b").distinct().join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")))
    share = label.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("_k"))
    main = share.groupBy("cluster").agg(F.max_by("component", "_k").alias("_main"), (F.sum("_k") - F.max("_k")).alias("_apart"))
    asked = label.join(main, "cluster").where("_apart > 0").withColumn("_asks", F.col("component") != F.col("_main"))
    asked = asked.withColumn("_q", F.ceil(F.col("_apart") / block)).select("cluster", "node", "_blocks", "_b", "_asks", "_q")
    rows = sized.select("cluster", "node", "set").join(asked, ["cluster", "node"])
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("_q"))
    index = rows.select("cluster", "node", "set", F.col("_b").alias("_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q") - 1)).alias("_s"), F.lit(False).alias("asks"), yes.alias("holds"))
    query = rows.where("_asks").select("cluster", "node", "set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_t"), mine.alias("_s"), yes.alias("asks"), F.lit(False).alias("holds"))
    both = index.unionByName(query).groupBy("cluster", "node", "_t", "_s").agg(
        F.first("set").alias("set"), F.max("asks").alias("asks"), F.max("holds").alias("holds"))
    more = search_tasks(both.select(F.concat_ws(":", "cluster", "_t", "_s").alias("task"), "node", "set", "asks", "holds"))
    every = links.unionByName(more.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return small.unionByName(components(every))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (smallest id reachable by links)."""
    digests = cut_lineage(shingle_digests(docs, id_col, text_col))
    shards = spread_count(docs)
    total = digests.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = frequent_shingles(shingle_levels(docs, max(shards, -(-total // COUNT_SHARD)), text_col))
    pairs = cut_lineage(candidate_pairs(inverted_lists(docs, hot, shards, text_col), shards))
    clusters = cut_lineage(components(pairs))
    marks = ["n", "f1", "f2"]
    classes = cut_lineage(digests.where("n > 0").groupBy(*marks).agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("_k")))
    key = F.concat_ws(":", "f1", "f2", "n").alias("key")
    placed = cut_lineage(classes.join(clusters.select(F.col("node").alias("f1"), F.col("component").alias("cluster")), "f1").where("node is not null"))
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    reps = spread_join(placed, sizes.drop("_n"), ["cluster"], ["f1"]).select("f1", "f2", F.col("node").alias("_id"), key.alias("node"), "cluster", "_blocks")
    linked = cut_lineage(link_clusters(_class_sets(docs, reps, id_col, text_col), block).withColumnRenamed("node", "key"))
    # classes are named by their marks up to here, then by the smallest id of their component
    least = linked.join(placed.select(key, "node"), "key").groupBy("component").agg(F.min("node").alias("_least"))
    linked = linked.join(least, "component").select("key", F.col("_least").alias("component"))
    named = classes.withColumn("key", key).join(linked, "key", "left").where("_k > 1 or component is not null")
    facts = named.select(*marks, F.coalesce("component", "node").alias("component"))
    rows = digests.select("_id", *marks)
    out = spread_join(rows, facts, marks, ["_id"], "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; all columns as they were.

    Rows without id stay. The ids that go are joined, so only texts that a Bloom filter of them may hit shuffle.
    """
    found = near_components(docs, id_col, text_col)
    gone = cut_lineage(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("_h")).distinct())
    n = bloom.block_count(gone.count())
    table = cut_lineage(bloom.build(gone, "_h", n))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_all"))
    flagged = bloom.flag(packed.withColumn("_h", F.xxhash64(F.col("_all")[id_col])), "_h", table, n, "_maybe")
    stays = flagged.where("_maybe").join(gone.select("_id"), F.col("_all")[id_col] == F.col("_id"), "left_anti")
    return flagged.where(~F.col("_maybe")).select("_all.*").unionByName(stays.select("_all.*"))
