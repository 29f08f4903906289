"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity by sharded joins.

Texts are read as UTF-8 bytes, all 256 of them, with a word equal to the one before it as a symbol of its own (one for
words of up to ``SHORT`` bytes, which repeat in clean text too, and one for longer words, which hardly do). The model is
of order ``ORDER``; its counts come from all trusted texts and its tables grow with them.

No text is judged by a model that has seen it: a hash of the text puts it into one of two halves, and the texts of a half
are scored by the model of the other half's trusted texts. So limits taken from trusted texts hold for all others, and equal
texts have equal likelihoods. The number of the model stands in the key of a gram, above its symbols.

Counts, contexts and back-off weights are tables joined by key. For scoring, documents are packed in chunks of at most
``CHUNK_BYTES`` (or one longer text); a chunk asks for its distinct grams, their log-probabilities are worked out once for
all chunks, level by level, and come back to the chunk (in units of 1 / ``UNIT``), which sums them over its documents.
The texts of chunks are written in buckets and do not shuffle.

A document's score is its mean negative log-probability, drawn toward its language's mean by ``PRIOR`` symbols so that
short texts are not judged by chance. It is rejected above the ``QUANTILE`` of trusted texts of its language: the larger of
the observed one and of the normal one for a further text, since a few texts hold no such quantile. A language without
trusted texts uses all of them.

Defined results: null and empty texts have perplexity of their language's mean and stay; without trusted texts every
document stays, with null perplexity; repeated rows are scored each for itself; null languages are a language of their own.
A model without any trusted text gives every symbol the same probability.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import bloom
from tallyframe.llm.blocks import Block, blocks, hash_words, split_words
from tallyframe.operators.skew import spread_join
from tallyframe.session import cut_lineage, scratch_dir

ORDER = 5
AGAIN, AGAIN_LONG = 256, 257
SYMBOLS = 258
BITS = 9
MODEL = BITS * ORDER  # bit of a key that tells the model
BEGIN = 10
SHORT = 3
CHUNK_BYTES = 32 << 20
MAX_BUCKETS = 100_000  # the most that Spark takes; beyond, a bucket holds more chunks
UNIT = 1 << 16
ZSTD = 6
PRIOR = 40
QUANTILE = 0.995
NORMAL = NormalDist().inv_cdf(QUANTILE)


def text_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, and where each text begins."""
    symbols = data.astype(np.uint16)
    words = split_words(data, offsets)
    h = hash_words(data, words)
    if len(h) < 2:
        return symbols, offsets
    again = np.flatnonzero((h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])) + 1
    keep = np.ones(len(data) + 1, dtype=np.int32)
    if len(again):
        change = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(change, words.starts[again] + 1, 1)
        np.add.at(change, words.ends[again], -1)
        keep = 1 - np.cumsum(change)
        short = words.ends[again] - words.starts[again] <= SHORT
        symbols[words.starts[again]] = np.where(short, AGAIN, AGAIN_LONG)
    place = np.concatenate([[0], np.cumsum(keep[:-1])])
    return symbols[keep[:-1] > 0], place[offsets]


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram ending at each symbol (line ends stand before a text), its text's number, and symbols per text."""
    symbols, bounds = text_symbols(data, offsets)
    sizes = np.diff(bounds)
    s = symbols.astype(np.int64)
    text = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    gram = s.copy()
    for back in range(1, ORDER):
        earlier = np.full(len(s), BEGIN, dtype=np.int64)
        if len(s) > back:
            same = text[back:] == text[:-back]
            earlier[back:][same] = s[:-back][same]
        gram |= earlier << (BITS * back)
    return gram, text, sizes


def half(text_col: str = "text") -> Column:
    """Half of a text, 0 or 1; also the number of the model that scores it."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(2)).cast("int")


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts over all rows: gram, n. The texts of a half train the other half's model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            gram, text, _ = text_grams(block.data, block.offsets)
            models = block.rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            found, n = np.unique(gram | models[text] << MODEL, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["gram", "n"])

    rows = docs.select(F.col(text_col), (1 - half(text_col)).alias("model"))
    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(gram: str, k: int, model: bool = True) -> Column:
    """Key of a gram's last ``k`` symbols."""
    return F.col(gram).bitwiseAND(F.lit((model << MODEL) | ((1 << BITS * k) - 1)))


def _context(gram: str) -> Column:
    """Key of what stands before the last symbol."""
    return F.shiftright(gram, BITS)


def _model(gram: str) -> Column:
    return F.shiftright(gram, MODEL).cast("int")


def count_levels(counts: DataFrame) -> list[DataFrame]:
    """Counts of grams by order, from one to ``ORDER``: below the highest, how many symbols a gram continues."""
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.append(cut_lineage(levels[-1].groupBy(_suffix("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    return levels[::-1]


def _discounts(levels: list[DataFrame]) -> dict[tuple[int, int], list[float]]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, by level and model."""
    seen: dict[tuple[int, int], dict[int, int]] = {}
    rows = None
    for k, level in enumerate(levels):
        r = level.where("n <= 4").select(F.lit(k).alias("k"), _model("gram").alias("m"), "n")
        rows = r if rows is None else rows.unionByName(r)
    for r in rows.groupBy("k", "m", "n").count().collect():  # at most 4 x 2 x ORDER rows
        seen.setdefault((r.k, r.m), {})[r.n] = r["count"]
    out = {}
    for k in range(len(levels)):
        for m in (0, 1):
            c = [seen.get((k, m), {}).get(i, 0) for i in range(1, 5)]
            y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
            out[k, m] = [min(max(i + 1 - (i + 2) * y * c[i + 1] / c[i], 0.05), i + 0.95) if c[i] else 0.5 for i in range(3)]
    return out


def log_probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Natural log-probability of the last symbol of every wanted gram: gram, logp.

    ``counts`` has gram and n, ``wanted`` distinct grams. A context is followed and a gram preceded by at most ``SYMBOLS``
    symbols, so no join key is hot.
    """
    levels = count_levels(counts)
    discounts = _discounts(levels)
    asked = [wanted.select("gram")]
    for k in range(ORDER - 1, 0, -1):
        asked.append(cut_lineage(asked[-1].select(_suffix("gram", k).alias("gram")).distinct()))
    lower = None
    for k, (level, need) in enumerate(zip(levels, asked[::-1])):
        off = F.when(_model("gram") == 0, _by_count(discounts[k, 0])).otherwise(_by_count(discounts[k, 1]))
        level = level.withColumn("_off", off).withColumn("_c", _context("gram"))
        stats = cut_lineage(level.groupBy("_c").agg(F.sum("n").alias("_all"), F.sum("_off").alias("_rest")))
        own = need.withColumn("_c", _context("gram")).join(stats, "_c", "left").join(level.select("gram", "n", "_off"), "gram", "left")
        if lower is None:
            own = own.withColumn("_low", F.lit(1.0 / SYMBOLS))
        else:
            own = own.withColumn("_s", _suffix("gram", k)).join(lower, "_s")
        share = F.coalesce((F.col("n") - F.col("_off")) / F.col("_all"), F.lit(0.0))
        back = F.coalesce(F.col("_rest") / F.col("_all"), F.lit(1.0))
        lower = cut_lineage(own.select(F.col("gram").alias("_s"), (share + back * F.col("_low")).alias("_low")))
    return lower.select(F.col("_s").alias("gram"), F.log("_low").alias("logp"))


def _by_count(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _bucketed(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows written once to the shared folder in ``n`` buckets of ``key``: later grouping by it does not move them."""
    spark = rows.sparkSession
    path = scratch_dir(spark, "buckets")
    name = f"buckets_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def score(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``id_col``, lang, n_symbols, loglik. ``counts`` are those of :func:`count_grams`."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), half(text_col).alias("half"), F.col(text_col).alias("text"))
    id_field = rows.schema["_id"]
    longs = pa.list_(pa.int64())
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("texts", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.LongType())),
        T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("langs", T.ArrayType(T.StringType())),
        T.StructField("halves", T.ArrayType(T.IntegerType())), T.StructField("grams", T.ArrayType(T.LongType())),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, chunk, size = pa.Codec("zstd", ZSTD), TaskContext.get().partitionId() << 32, 0
        grams = np.zeros(0, dtype=np.int64)

        def row(blob, offsets, lists, asked) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([blob], pa.binary()), pa.array([offsets], longs), *lists, pa.array([asked], longs)], names=schema.names)

        types = [None, pa.string(), pa.int32()]
        for block in blocks(batches):
            types[0] = block.rows.column(0).type
            if size and size + len(block.data) > CHUNK_BYTES:
                yield row(None, None, [pa.array([None], pa.list_(t)) for t in types], grams)
                chunk, size, grams = chunk + 1, 0, grams[:0]
            size += len(block.data)
            grams = np.union1d(grams, text_grams(block.data, block.offsets)[0])
            blob = codec.compress(block.data.tobytes(), asbytes=True) if len(block.data) else b""
            yield row(blob, block.offsets.tolist(), [pa.array([block.rows.column(c).to_pylist()], pa.list_(t)) for c, t in enumerate(types)], None)
        if types[0] is not None:
            yield row(None, None, [pa.array([None], pa.list_(t)) for t in types], grams)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(rows.sparkSession.sparkContext.defaultParallelism, size // CHUNK_BYTES + 1), MAX_BUCKETS)
    packed = _bucketed(rows.mapInArrow(pack, schema), buckets, "chunk")
    asked = packed.where("grams is not null").select("chunk", F.posexplode("grams").alias("place", "gram"))
    wanted = cut_lineage(asked.select("gram").distinct())
    both = wanted.select(F.explode(F.array("gram", F.col("gram").bitwiseOR(F.lit(1 << MODEL)))).alias("gram"))
    found = log_probabilities(counts, both)
    # probabilities of both models in one number, each as a whole number of 1 / UNIT
    cost = F.round(-F.col("logp") * UNIT).cast("long")
    pair = found.groupBy(_suffix("gram", ORDER, model=False).alias("gram")).agg(F.sum(F.when(_model("gram") == 0, cost).otherwise(F.shiftleft(cost, 32))).alias("costs"))
    answers = asked.join(pair, "gram").select(F.col("chunk").alias("_chunk"), "place", "costs")
    out = T.StructType([id_field, T.StructField("lang", T.StringType()), T.StructField("n_symbols", T.LongType()), T.StructField("loglik", T.DoubleType())])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        codec, parts, gram = pa.Codec("zstd", ZSTD), [], None
        lists = left.column("grams")
        gram = next(x.values.to_numpy() for x in lists if x.is_valid)
        costs = np.zeros((2, len(gram)), dtype=np.int64)
        place, packed_costs = (right.column(c).to_numpy() for c in ("place", "costs"))
        costs[0, place], costs[1, place] = packed_costs & 0xFFFFFFFF, packed_costs >> 32
        for i in range(left.num_rows):
            if lists[i].is_valid:
                continue
            blob, offsets, ids, langs, halves = (left.column(c)[i] for c in ("texts", "offsets", "ids", "langs", "halves"))
            offsets = offsets.values.to_numpy()
            raw = codec.decompress(blob.as_py(), int(offsets[-1]), asbytes=True) if offsets[-1] else b""
            keys, text, sizes = text_grams(np.frombuffer(raw, dtype=np.uint8), offsets)
            each = costs[halves.values.to_numpy()[text], np.searchsorted(gram, keys)]
            sums = np.bincount(text, weights=each, minlength=len(sizes)) / -UNIT
            parts.append(pa.Table.from_arrays([ids.values, langs.values, pa.array(sizes.astype(np.int64)), pa.array(sums)], names=out.names))
        return pa.concat_tables(parts)

    return packed.groupBy("chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(add, out).withColumnRenamed("_id", id_col)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that labels call good and none calls bad."""
    return labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("_q")).where("_q = 1").select(id_col)


def trusted_texts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of trusted ids, hardly any of which shuffle.

    A Bloom filter of the trusted ids lets all of them pass and a few others. Those others are found by their ids alone and
    get a filter of their own: texts that pass the first and miss the second are trusted, those that hit both are joined.
    """
    hashes = cut_lineage(trusted.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("_h")))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("_h"), F.col(text_col).alias("text"))
    maybe = _hits(rows, hashes).where("_hit").drop("_hit")
    wrong = cut_lineage(maybe.select("_id", "_h").distinct().join(hashes.select("_id").hint("merge"), "_id", "left_anti"))
    split = _hits(maybe, wrong)
    sure = split.where(~F.col("_hit")).select("text")
    return sure.unionByName(split.where("_hit").join(hashes.select("_id").hint("merge"), "_id", "left_semi").select("text"))


def _hits(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows with ``_hit``: whether a Bloom filter of the listed hashes ``_h`` holds theirs."""
    n = bloom.block_count(listed.count())
    return bloom.flag(rows, "_h", cut_lineage(bloom.build(listed, "_h", n)), n, "_hit")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col``, lang, n_symbols, perplexity, threshold, kept."""
    trusted = cut_lineage(trusted_ids(labels, id_col))
    counts = cut_lineage(count_grams(trusted_texts(docs, trusted, id_col)))
    if counts.isEmpty():
        return docs.select(id_col, F.col("lang").cast("string").alias("lang"), F.lit(None).cast("long").alias("n_symbols"),
                           F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    scored = cut_lineage(score(docs, counts, id_col))
    good = scored.join(trusted, id_col, "left_semi").where("n_symbols > 0")
    by_lang = cut_lineage(good.groupBy("lang").agg((-F.sum("loglik") / F.sum("n_symbols")).alias("mean")))
    overall = good.agg((-F.sum("loglik") / F.sum("n_symbols")).alias("m")).scalar()

    def with_mean(rows: DataFrame) -> DataFrame:
        joined = spread_join(rows, by_lang, ["lang"], [id_col, "n_symbols"], "left", null_safe=True)
        mean = F.coalesce("mean", overall)
        x = (-F.coalesce("loglik", F.lit(0.0)) + PRIOR * mean) / (F.col("n_symbols") + PRIOR)
        return joined.withColumn("_x", x).drop("mean")

    rated = cut_lineage(with_mean(good))
    further = F.avg("_x") + NORMAL * F.stddev_samp("_x") * F.sqrt(1 + 1 / F.count("_x"))  # null for a single text
    high = F.greatest(F.percentile_approx("_x", F.lit(QUANTILE), F.lit(10000)), further)
    limits = cut_lineage(rated.groupBy("lang").agg(high.alias("limit")))
    any_limit = rated.agg(high.alias("l")).scalar()
    out = spread_join(with_mean(scored), limits, ["lang"], [id_col, "n_symbols"], "left", null_safe=True)
    limit = F.coalesce("limit", any_limit)
    return out.select(id_col, "lang", "n_symbols", F.exp("_x").alias("perplexity"), F.exp(limit).alias("threshold"),
                      ((F.col("n_symbols") == 0) | (F.col("_x") <= limit)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that are not rejected, all columns as they were.

    The rejected ids are joined behind a Bloom filter so that few other texts shuffle. Rows that
    share an id stay if any of them does; rows without id stay.
    """
    judged = judge(docs, labels, id_col)
    bad = judged.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("kept").alias("_k")).where("not _k")
    gone = cut_lineage(bad.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("_h")))
    n = bloom.block_count(gone.count())
    table = cut_lineage(bloom.build(gone, "_h", n))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_all"))
    flagged = bloom.flag(packed.withColumn("_h", F.xxhash64(F.col("_all")[id_col])), "_h", table, n, "_maybe")
    stays = flagged.where("_maybe").join(gone.select("_id"), F.col("_all")[id_col] == F.col("_id"), "left_anti")
    return flagged.where(~F.col("_maybe")).select("_all.*").unionByName(stays.select("_all.*"))
