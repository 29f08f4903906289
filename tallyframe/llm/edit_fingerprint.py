"""Document fingerprints by randomised edit embedding.

A text is cut into segments at places its own words choose, so an edit disturbs only segments near it. Each segment is
embedded by a shared random walk over its characters (UTF-8 bytes): at step j the pointer moves on or stays by a fixed
random bit of (j, character). Two segments at a small edit distance walk alike soon after the edit, so their
embeddings differ in few places (small Hamming distance). At sampled steps the walk emits a hash of the characters at
the pointer; each of its bits votes on one fingerprint bit, and the sign of all votes of the text is that bit.

``likeness`` rescales the Hamming distance of two fingerprints: 1 for equal ones, near 0 for unrelated texts.
``near_links`` bands sampled bits of the fingerprints and verifies all pairs of a bucket. Up to ``BUCKET`` classes are one
bucket, so the search is exact; beyond, keys grow by a bit as the classes double, and bands are added so that a pair at
the least likeness still shares one with probability ``RECALL``. ``near_components`` names each document's component.

Defined results: a null or empty text is embedded as an empty walk (all its bits fixed); equal texts have equal
fingerprints; any one text is walked to its end. In ``edit_probe`` rows of null id come last, rows of one id follow
each other by a hash of the text, and a single row is its own next document. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.blocks import blocks, hash_words, mix64, salts, split_words
from tallyframe.llm.components import components
from tallyframe.llm.prefix import spread_count
from tallyframe.session import cut_lineage

BITS = 256
GROUP = 16
SEGMENT = 256
CUT_WORDS = 8
SLACK = 32
STEPS = 2 * SEGMENT + SLACK
BUCKET = 4096
RECALL = 0.95
SAMPLED = [*range(0, 32, 2), *range(32, 128, 8), *range(128, STEPS, 16)]

_MOVE = (salts(STEPS * 256, 31) >> np.uint64(63)).astype(np.int64).reshape(STEPS, 256)
_SALT = salts(STEPS, 32)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and text number of each segment, at most ``SEGMENT`` bytes long."""
    words = split_words(data, offsets)
    chosen = words.starts[hash_words(data, words) % np.uint64(CUT_WORDS) == 0]
    begins = np.unique(np.concatenate([chosen, offsets[:-1][np.diff(offsets) > 0]]))
    if not len(begins):
        return begins, begins, begins
    sizes = np.diff(np.concatenate([begins, [len(data)]]))
    pieces = -(-sizes // SEGMENT)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    starts = np.repeat(begins, pieces) + nth * SEGMENT
    lengths = np.minimum(SEGMENT, np.repeat(begins + sizes, pieces) - starts)
    return starts, lengths, np.searchsorted(offsets, starts, side="right") - 1


def four_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The four bytes from each place on as a number, zeros after the end of a text."""
    gram = data.astype(np.uint64)
    for k in (1, 2, 3):
        later = np.zeros(len(data), dtype=np.uint64)
        later[:-k] = data[k:]
        for back in range(1, k + 1):
            late = offsets[1:] - back
            later[late[late >= offsets[:-1]]] = 0
        gram |= later << np.uint64(8 * k)
    return gram


def fingerprint_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts, one row of ``BITS / 8`` bytes each."""
    n = len(offsets) - 1
    votes = np.zeros((n, BITS), dtype=np.int32)
    mark = np.zeros(n, dtype=np.uint64)
    starts, lengths, text = segments(data, offsets)
    if len(starts):
        order = np.argsort(-lengths, kind="stable")
        place, end, text = starts[order].copy(), (starts + lengths)[order], text[order]
        steps = 2 * lengths[order] + SLACK
        gram = four_bytes(data, offsets)
        padded = np.concatenate([data, np.zeros(1, dtype=np.uint8)])
        active = len(place) - np.searchsorted(steps[::-1], np.arange(STEPS), side="right")
        sampled = {j: i for i, j in enumerate(SAMPLED)}
        for j in range(STEPS):
            a = int(active[j])
            if not a:
                break
            at, stop = place[:a], end[:a]
            if j in sampled:
                live = np.flatnonzero(at < stop)
                if len(live):
                    h = mix64(gram[at[live]] ^ _SALT[j])
                    group = sampled[j] % (BITS // GROUP) * GROUP
                    owner = text[live]
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, : GROUP // 8], axis=1).astype(np.int32) * 2 - 1
                    by = np.argsort(owner, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(owner[by]) > 0]))
                    votes[owner[by][first], group : group + GROUP] += np.add.reduceat(bits[by], first, axis=0)
                    mark[owner[by][first]] += np.add.reduceat(h[by], first)
            at += _MOVE[j][padded[at]]
            np.minimum(at, stop, out=at)
    # a bit without a majority takes one from a hash of the text's own votes
    ties = np.unpackbits(mix64(mark[:, None] + salts(BITS // 64, 33)[None, :]).view(np.uint8).reshape(n, -1), axis=1).astype(bool)
    return np.packbits(np.where(votes == 0, ties, votes > 0), axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - 2 * Hamming distance / bits, not below 0, row by row."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.maximum(0.0, 1 - 2 * differ / BITS)


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, fingerprint (hex)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            out = [x.tobytes().hex() for x in fingerprint_texts(block.data, block.offsets)]
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(out)], names=[id_col, "fingerprint"])

    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("fingerprint", T.StringType())]))


def band_plan(classes: int, least: float) -> tuple[int, int]:
    """Bits of a band's key, so that a bucket expects ``BUCKET`` classes at most, and the number of bands."""
    bits = max(0, math.ceil(math.log2(max(classes, 1) / BUCKET)))
    shared = ((1 + least) / 2) ** bits  # a pair at the least likeness has the same key
    return bits, 1 if shared >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - shared))


def band_keys(prints: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Key of each print (row) in each band (column): the band's number and its own draw of bits."""
    bit = np.unpackbits(prints, axis=1)
    out = np.zeros((len(prints), bands), dtype=np.int64)
    for k in range(bands):
        out[:, k] = k
        for i in np.argsort(salts(BITS, 34 + k))[:bits]:
            out[:, k] = out[:, k] << 1 | bit[:, i]
    return out


def close_pairs(prints: np.ndarray, side: np.ndarray, most: int, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows at most ``most`` bits apart and their distances; where rows of two sides meet, pairs across only.

    With ``forest``, just enough of them to connect what they connect.
    """
    words = np.ascontiguousarray(prints).view(np.uint64)
    two = side.any() and not side.all()
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if two else (np.arange(len(words)),) * 2
    columns = [np.ascontiguousarray(words[right, w]) for w in range(words.shape[1])]
    group = np.arange(len(words))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        low = 0 if two else at  # earlier rows have met these
        apart = np.zeros((len(rows), len(right) - low), dtype=np.uint16)
        for w, column in enumerate(columns):
            apart += np.bitwise_count(words[rows, w][:, None] ^ column[None, low:])
        i, j = np.nonzero(apart <= most)
        d = apart[i, j]
        i, j = rows[i], right[low + j]
        keep = i != j if two else i < j
        i, j, d = i[keep], j[keep], d[keep]
        if forest and len(i):
            taken = []
            begins = np.flatnonzero(np.concatenate([[True], np.diff(i) > 0]))
            for x, y in zip(begins, [*begins[1:], len(i)]):
                others, first = np.unique(group[j[x:y]], return_index=True)
                new = others != group[i[x]]
                if new.any():
                    taken.append(x + first[new])
                    group[np.isin(group, others[new])] = group[i[x]]
            chosen = np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)
            i, j, d = i[chosen], j[chosen], d[chosen]
        found.append((i, j, d))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3


def near_links(prints: DataFrame, id_col: str = "doc_id", bands: int | None = None, band_bits: int | None = None, least: float = 0.6,
               forest: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b, likeness) between representatives of different fingerprints whose sampled bits agree in some band.

    Equal fingerprints are one class, named by its smallest id. All classes of a bucket are compared; one of more than
    ``bucket`` classes is cut into blocks, and each pair of blocks is a task of its own. With ``forest``, each task gives
    just enough links to connect what its links connect. Keys and bands follow the number of classes unless they are given.
    """
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min(id_col).alias("_id")).where(F.col("_id").isNotNull())
                          .select("_id", F.unhex("fingerprint").alias("_print")))
    bits, count = band_plan(classes.count(), least)
    bits = bits if band_bits is None else band_bits
    count = count if bands is None else bands
    most = math.floor((1 - least) * BITS / 2 + 1e-9)
    kind = classes.schema["_id"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
            keys = band_keys(raw, bits, count)
            for k in range(count):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]), batch.column(0), batch.column(1)], names=["_key", "_id", "_print"])

    rows = classes.mapInArrow(keyed, T.StructType([T.StructField("_key", T.LongType()), kind, T.StructField("_print", T.BinaryType())]))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(sizes.where(F.col("_n") > bucket).select("_key", F.ceil(F.col("_n") / bucket).cast("int").alias("_blocks")))
    mine = F.pmod(F.xxhash64("_print"), F.col("_blocks")).cast("int")
    other = F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # large buckets are at most as many as classes * bands / bucket
    placed = rows.join(F.broadcast(large), "_key", "left").withColumn("_mine", F.coalesce(mine, F.lit(0))).withColumn("_other", other).select(
        "_key", F.least("_mine", "_other").alias("_x"), F.greatest("_mine", "_other").alias("_y"),
        (F.col("_mine") > F.col("_other")).alias("_side"), "_id", "_print")
    out = T.StructType([T.StructField("a", kind.dataType), T.StructField("b", kind.dataType), T.StructField("likeness", T.DoubleType())])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        raw = np.frombuffer(b"".join(table.column("_print").to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
        if key[1].as_py() != key[2].as_py():
            side = table.column("_side").to_numpy()
            if not side.any() or side.all():  # the other block is empty
                raw, side = raw[:0], side[:0]
        else:
            side = np.zeros(len(raw), dtype=bool)
        i, j, d = close_pairs(raw, side, most, forest)
        ids = table.column("_id")
        return pa.Table.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(np.maximum(0.0, 1 - 2 * d.astype(np.float64) / BITS))], names=out.names)

    pairs = placed.groupBy("_key", "_x", "_y").applyInArrow(search, out)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness").distinct()


def near_components(prints: DataFrame, id_col: str = "doc_id", least: float = 0.6) -> DataFrame:
    """One row per fingerprint: fingerprint, near_id (the smallest id that near links reach, null if all are null)."""
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min(id_col).alias("_id")).withColumn("_node", F.xxhash64("fingerprint")))
    joined = components(near_links(classes.select("_node", "fingerprint"), "_node", least=least, forest=True))
    named = cut_lineage(classes.join(joined, F.col("_node") == F.col("node"), "left")
                        .select("fingerprint", "_id", F.coalesce("component", "_node").alias("_component")))
    first = named.groupBy("_component").agg(F.min("_id").alias("near_id"))
    return named.join(first, "_component").select("fingerprint", "near_id")


def replace_tail(text: str, other: str) -> str:
    """The last floor(n/2) code points give way to the first as many of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _judge(ids: pa.Array, texts: list[str], prints: np.ndarray, others: list[str], other_prints: np.ndarray) -> list[pa.Array]:
    edited = [replace_tail(t, u).encode() for t, u in zip(texts, others)]
    edited_prints = fingerprint_texts(*_pack(edited))
    return [
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([x.tobytes().hex() for x in prints], pa.string()), pa.array([x.tobytes().hex() for x in edited_prints], pa.string()),
        pa.array(likeness(prints, edited_prints)), pa.array(likeness(prints, other_prints)),
    ]


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside an edited text (its second half replaced from the document with the next smaller id).

    One row per document: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Texts are dealt into ranges of id once; a range hands on its first and last row to finish its neighbour's.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("_id").desc_nulls_last(), F.xxhash64("text").desc()]
    ranged = rows.repartitionByRange(spread_count(docs), *order).sortWithinPartitions(*order)
    fields = [rows.schema["_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
              T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
              T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("range", T.IntegerType()), T.StructField("role", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        types = None

        def edge(ids: pa.Array, role: int, text: str) -> pa.RecordBatch:
            nulls = [pa.nulls(1, t) for t in types]
            return pa.RecordBatch.from_arrays([ids, *nulls, pa.array([here], pa.int32()), pa.array([role], pa.int32()), pa.array([text])], names=schema.names)

        last = None  # id, text and fingerprint of the row that waits for its next
        for block in blocks(batches):
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            ids = block.rows.column(0)
            texts = [block.text(i).decode() for i in range(len(block))]
            prints = fingerprint_texts(block.data, block.offsets)
            if last is None:
                yield edge(ids.slice(0, 1), 1, texts[0])
            else:
                ids, texts, prints = pa.concat_arrays([last[0], ids]), [last[1], *texts], np.concatenate([last[2], prints])
            n = len(texts) - 1
            if n:
                out = _judge(ids.slice(0, n), texts[:-1], prints[:-1], texts[1:], prints[1:])
                done = [pa.array(np.full(n, here, dtype=np.int32)), pa.array(np.zeros(n, dtype=np.int32)), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([*out, *done], names=schema.names)
            last = (ids.slice(n, 1), texts[n], prints[n:])
        if last is not None:
            yield edge(last[0], 2, last[1])

    made = cut_lineage(ranged.mapInArrow(run, schema))
    ends = cut_lineage(made.where("role > 0").select("_id", "range", "role", "text"))  # two rows per range
    heads = ends.where("role = 1").select(F.col("range").alias("_at"), F.col("text").alias("next"))
    every = Window.orderBy("_at")
    before = heads.select("_at", F.coalesce(F.lag("_at").over(every), F.max("_at").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_from"))
    tails = ends.where("role = 2").join(before, F.col("range") == F.col("_from")).join(heads, "_at").select("_id", "text", "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, other = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                prints = fingerprint_texts(*_pack([text.encode(), other.encode()]))
                yield pa.RecordBatch.from_arrays(_judge(batch.column(0).slice(i, 1), [text], prints[:1], [other], prints[1:]), names=names)

    whole = made.where("role = 0").select(*names).unionByName(tails.mapInArrow(finish, T.StructType(fields)))
    return whole.withColumnRenamed("_id", id_col)
