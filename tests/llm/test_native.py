"""Exact dedup, URL filter, sharding and mixing beside brute force."""

import hashlib
import math
import zlib
from collections import Counter

import helpers as h
import pytest
from pyspark.sql import functions as F
from tallyframe.llm import bloom, exact_dedup, mixing, prefix, sharding, url_filter


def normal(t):
    return "".join(c for c in t or "" if c not in h.SPACES)


def exact_brute(ids, texts):
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(normal(t), []).append((-len(t or ""), math.inf if i is None else i))
    return groups


def test_exact_groups(spark):
    r = h.rng()
    texts = h.awkward(r) + ["same  text", "same text", "sametext", "same\ttext\n"] * 3 + [h.words(r, 30) for _ in range(60)]
    ids = [100 - i for i in range(len(texts))]
    out = exact_dedup.exact_groups(h.table(spark, texts, ids)).collect()
    groups = exact_brute(ids, texts)
    assert len(out) == len(texts)
    text_of = dict(zip(ids, texts))
    for row in out:
        mine = groups[normal(text_of[row.doc_id])]
        assert row.keep_id == min(mine)[1] and row.group_size == len(mine) and row.kept == (row.doc_id == row.keep_id)
        assert row.text_sha256 == hashlib.sha256(normal(text_of[row.doc_id]).encode()).hexdigest()


def test_exact_null_ids_and_repeated_rows(spark):
    docs = h.table(spark, ["a b", "ab", "a b", "c", "c", "c"], [None, 2, 1, 7, 7, None])
    out = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.keep_id, r.group_size) for r in out) == [(1, 3)] * 3 + [(7, 3)] * 3
    assert sum(r.kept for r in out) == 2
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_drop_copies_keeps_columns(spark):
    r = h.rng(8)
    texts = h.awkward(r) + ["q w"] * 50 + ["q  w"] * 2 + [h.words(r, 9) for _ in range(40)]
    docs = h.table(spark, texts).withColumn("_sha", F.lit("x")).withColumn("_maybe", F.lit(1)).withColumn("_all", F.lit(2.5))
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    groups = exact_brute(range(len(texts)), texts)
    assert sorted(x.doc_id for x in rows) == sorted(min(g)[1] for g in groups.values())
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0
    assert exact_dedup.drop_copies(docs.unionByName(docs)).count() == len(groups)


def test_bloom_never_misses(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    blocks = bloom.block_count(3000)
    table = bloom.build(keys.where("h % 2 = 0"), "h", blocks)
    flagged = bloom.flag(keys.unionByName(spark.sql("select cast(null as bigint) h")), "h", table, blocks, "hit")
    assert flagged.where("h % 2 = 0 and not hit").count() == 0
    assert flagged.where("h is null and hit").count() == 0
    assert flagged.where("h % 2 <> 0 and hit").count() < 150
    assert bloom.block_count(10**12) == bloom.MAX_BLOCKS


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]


def url_brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = h.lower(rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(a + b), a + b, v) for v, a, b in RULES if (host == a or host.endswith("." + a)) and path.startswith(b)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host and (host + path) in listed else "allow"


def test_urls(spark):
    urls = [None, "", "nourl", "http://", "http:///x", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2",
            "https://xexample.org/es/", "https://example.org", "http://bad.net/p?q=1", "http://bad.net/p2", "ftp://bad.net/p#z", "http://a..org/x",
            "http://bad.net?x/y", "http://u://org/es/", "http://EXAMPLE.org/es/://x", "http://ÄÖ.org/é", "http://" + "a." * 300 + "org/" + "x" * 5000]
    pages = spark.createDataFrame([(i % 15, u, "<p>", "v") for i, u in enumerate(urls * 2)], "page_id long, url string, html string, verdict string")
    listed = {"bad.net/p"}
    entries = url_filter.rule_table(spark, RULES).unionByName(url_filter.listed_urls(spark.createDataFrame([("http://BAD.net/p?z",)], "url string")))
    out = url_filter.judge_urls(pages, entries)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got == Counter((i % 15, *url_brute(u, listed)) for i, u in enumerate(urls * 2))
    assert url_filter.judge_urls(pages.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, entries.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("n", [0, 1, 300])
def test_shards(spark, n):
    r = h.rng(3)
    texts = (h.awkward(r) + [h.words(r, r.randrange(200)) for _ in range(300)])[:n]
    docs = h.table(spark, texts).withColumn("shard", F.lit("x")).withColumn("size", F.lit(0))
    out = sorted(sharding.balanced_shards(docs, 24).collect(), key=lambda x: x.doc_id)
    assert len(out) == n
    size = [len((t or "").encode()) + 8 for t in texts]
    assert [(x.size, x.text_crc32) for x in out] == [(s, zlib.crc32((t or "").encode())) for s, t in zip(size, texts)]
    assert [x.shard for x in out] == sorted(x.shard for x in out)  # contiguous by id
    for shard in {x.shard for x in out}:
        assert sorted(x.slot for x in out if x.shard == shard) == list(range(sum(x.shard == shard for x in out)))
    if n:
        assert max(sum(x.size for x in out if x.shard == k) for k in range(24)) <= sum(size) / 24 + 2 * max(size)


def test_shards_of_repeated_and_null_ids(spark):
    docs = h.table(spark, ["a", "a", None, "b"] * 10, [1, 1, None, None] * 10)
    out = sharding.balanced_shards(docs, 4).collect()
    assert len(out) == 40 and len({(x.shard, x.slot) for x in out}) == 40


def test_running_totals(spark):
    r = h.rng(4)
    rows = [(None if r.random() < 0.2 else f"g{r.randrange(2)}", r.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(7)
    out = {x.i: x.t for x in prefix.running_totals(df, ["x", "i"], {"t": "x"}, ["g"]).collect()}
    for g in {x[0] for x in rows}:
        total = 0
        for _, x, i in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            total += x
            assert out[i] == total


def mix_brute(rows, seed=7):
    """rows: (id, source, size) -> copies by id, target by source."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[2] for x in rows if x[1] == s) for s in sources}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    left, target, still = float(sum(size.values())), {}, list(sources)
    while still:
        level = left / sum(weight[s] for s in still)
        over = [s for s in still if level * weight[s] > 3 * size[s] + 1e-9]
        for s in over or still:
            target[s] = 3.0 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        still = [s for s in still if s not in over] if over else []
    copies = {}
    for s in sources:
        e = target[s] / size[s] if size[s] else 0.0
        u = int(hashlib.md5(f"{seed}:{'-' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) / 2**32
        for k, (i, _, _) in enumerate(sorted((x for x in rows if x[1] == s), key=lambda x: (x[2], x[0]))):
            copies[i] = min(math.floor(e * (k + 1) + u) - math.floor(e * k + u), math.ceil(e))
    return copies, target


def test_mixing(spark):
    r = h.rng(6)
    texts = h.awkward(r) + [h.words(r, r.randrange(80)) for _ in range(200)]
    docs = h.table(spark, texts).withColumn("size", F.lit("x")).withColumn("copies", F.lit(9))
    rows = [(x.doc_id, x.source, len(h.WORD.findall(x.text or ""))) for x in docs.collect()]
    copies, target = mix_brute(rows)
    out = mixing.mix_counts(docs).collect()
    assert {x.doc_id: x.copies for x in out} == copies
    for x in out:
        assert x.target == pytest.approx(target[x.source]) and x.taken == x.copies * x.size <= 3 * x.size
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    assert mixing.mix_counts(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mix_of_equal_rows(spark):
    docs = h.table(spark, ["a b c"] * 30 + ["d"] * 3, [1] * 30 + [2, None, None]).withColumn("source", F.when(F.col("text") == "d", "z"))
    assert mixing.mix(docs).count() == mixing.mix_counts(docs).agg(F.sum("copies").alias("n")).first().n
