"""Hard negatives, collocations and language identification beside brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import helpers as h
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyframe.llm import collocations, hard_negatives, language_id
from tallyframe.llm.blocks import blocks

DATA = "/root/testdata/sf0.01"


def negatives_brute(rows, positives=5, negatives=3, low=50, high=95):
    live = [(i, [math.floor(256.0 * x) for x in v], c) for i, v, c in rows
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def order(pair):
        s, n = pair
        return -s, math.inf if live[n][0] is None else live[n][0], n

    out = []
    for a, (i, v, c) in enumerate(live):
        if i is None or i % 5:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), n) for n, (_, w, _) in enumerate(live) if n != a]
        own = sorted([x for x in scores if live[x[1]][2] == c], key=order)[:positives]
        rest = sorted([x for x in scores if live[x[1]][2] != c], key=order)
        for s, p in own:
            hits = [x for x in rest if low * s <= 100 * x[0] and 100 * x[0] <= high * s][:negatives]
            out += [(i, live[p][0], k, live[n][0], s, x) for k, (x, n) in enumerate(hits, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, c, "z") for i, v, c in rows], "vec_id long, embedding array<double>, label int, score string").coalesce(1)
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 5 == 0, **kw).collect()), key=repr)


def test_hard_negatives_equal_brute_force(spark):
    r = h.rng(4)
    rows = [(i, [r.choice([-0.5, 0.25, 0.3, 1.0]) for _ in range(4)], r.randrange(3)) for i in range(80)]
    rows += [(3, rows[3][1], rows[3][2]), (5, rows[5][1], rows[5][2]), (10, [1.0, 1.0, 0.5, 0.5], 7), (None, [1.0, 1.0, 1.0, 0.5], 1), (None, [1.0] * 4, 2)]
    rows += [(90, [1.0, float("nan")], 1), (95, [float("inf")], 1), (100, None, 1), (105, [1.0, None], 2), (110, [1.0], None), (115, [], 1), (120, [2.0, 1.0], 0)]
    want = negatives_brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, anchors_per_pass=3) == want
    assert mined(spark, rows, positives=2, negatives=7, low=10, high=99) == negatives_brute(rows, 2, 7, 10, 99)
    assert mined(spark, rows[:1]) == []
    assert mined(spark, []) == []


def test_hard_negatives_large_components(spark):
    rows = [(i, [float(3**k) * (i % 4 + 1), 2.0**20], i % 2) for i, k in enumerate([8, 9, 11, 12, 12, 11, 10, 12, 9, 3, 11, 5])]
    assert mined(spark, rows) == negatives_brute(rows)


def test_slots_hold_the_best(spark):
    r = np.random.default_rng(3)
    best = hard_negatives.Best(3, 4)
    which, score, ids = r.integers(0, 4, 900), r.integers(-5, 6, 900), r.permutation(900)
    for part in np.array_split(np.arange(900), 7):
        best.add(which[part], score[part], ids[part], ids[part])
    got = defaultdict(list)
    for w, s, i in zip(*best.entries[:3]):
        got[int(w)].append((-int(s), int(i)))
    for w in range(4):
        assert got[w] == sorted((-int(s), int(i)) for x, s, i in zip(which, score, ids) if x == w)[:3]


def pieces(text):
    return [w for p in re.split("[.,;:!?\x0a-\x0d]", h.lower(text)) if (w := re.findall("[^\x20\x09]+", p))]


def phrase_brute(rows, least=30, kept=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for w in pieces(text or ""):
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        best, dropped = [], set()
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * counts[p[i : i + k]]:
                        dropped.add(p[i : i + k])
            score, cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((score, a, p, counts[p[:cut]], counts[p[cut:]]))
        best = sorted((x for x in best if x[2] not in dropped), key=lambda x: (-x[0], -x[1], " ".join(x[2]).encode()))[:kept]
        out += [(lang, i, " ".join(p), a, u, v, n[lang], s) for i, (s, a, p, u, v) in enumerate(best, 1)]
    return sorted(out)


def phrase_rows(r):
    stock = ["new york city", "the quick brown fox", "ab cd", "éa ß 日本", "x\x00y z\x1fw"]
    texts = [" ".join(r.choice(stock + ["a", "b", "the", "Of", "q w e r t"]) + r.choice(["", "", ",", ".", "\t", "\n"]) for _ in range(r.randrange(1, 60))) for _ in range(150)]
    texts += ["loop " * 700, " ".join(f"u{i}" for i in range(300)), "same passage of many words here " * 3] * 2 + ["same passage of many words here"] * 40
    texts += [t for t in h.awkward(r) if t is None or len(t) < 50_000]
    return [(t, r.choice(["en", "de", None, "und"])) for t in texts]


def phrases(spark, rows, parts=5, **kw):
    df = spark.createDataFrame([(t, lang, 1, "k") for t, lang in rows], "text string, lang string, n int, chunk string").repartition(parts)
    return sorted(tuple(x) for x in collocations.collocations(df, **kw).collect())


def test_collocations_equal_brute_force(spark):
    rows = phrase_rows(h.rng(6))
    want = phrase_brute(rows)
    assert len(want) > 20 and {x[0] for x in want} == {"en", "de", "und"}
    assert phrases(spark, rows) == want
    assert phrases(spark, rows, 1, least=3, kept=9) == phrase_brute(rows, 3, 9)


def test_collocations_over_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 150)
    monkeypatch.setattr(collocations, "BLOCK_ROWS", 16)
    monkeypatch.setattr(collocations, "BATCH_ROWS", 16)
    rows = phrase_rows(h.rng(7))
    assert phrases(spark, rows) == phrase_brute(rows)


def test_collocations_edges(spark):
    assert phrases(spark, []) == []
    assert phrases(spark, [(None, None), ("", "en"), (" . , \t", "en"), ("one two", "en")]) == []


def test_counts_of_phrases_are_not_broadcast(spark, tmp_path):
    """A stored table of counts may be small as compressed and large once copied for a join."""
    rows = [("en", 1, "a", 90), ("en", 1, "b", 80), ("en", 1, "c", 70), ("en", 2, "a b", 60), ("en", 2, "b c", 50), ("en", 3, "a b c", 45)]
    spark.createDataFrame(rows, "lang string, words int, phrase string, f long").write.parquet(f"{tmp_path}/counts")
    counts = spark.read.parquet(f"{tmp_path}/counts")
    for df in (collocations.scored(counts), collocations.covered(counts, 80)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.phrase, x.a, x.l, x.r) for x in collocations.scored(counts).collect()) == [("a b", 60, 90, 80), ("a b c", 45, 90, 50), ("b c", 50, 80, 70)]


def test_chunks_own_every_word_once(spark):
    rows = phrase_rows(h.rng(8))
    df = spark.createDataFrame(rows, "text string, lang string")
    own, whole = Counter(), Counter()
    for x in collocations.parse(df).collect():
        w = x.chunk.split(" ")
        assert 1 <= len(w) - x.tail <= collocations.LONGEST_CHUNK
        for i in range(len(w) - x.tail):
            own[x.lang, tuple(w[i : i + 4])] += x.n
    for text, lang in rows:
        for w in pieces(text or ""):
            whole.update((lang or "und", tuple(w[i : i + 4])) for i in range(len(w)))
    assert own == whole


def stream_brute(text):
    out = [0]
    for c in text:
        p = ord(c.lower()[0]) if c.isalpha() else 0
        if p or out[-1]:
            out.append(p)
    return out


def grams_brute(text):
    s = stream_brute(text)
    s = s if s[-1] == 0 else [*s, 0]
    return Counter(tuple(s[i : i + n]) for n in range(1, 5) for i in range(len(s) - n + 1)
                   if any(s[i : i + n]) and all(s[i + 1 : i + n - 1]) and (n > 1 or s[i]))


def bucket_of(gram):
    value = 0
    for n, p in enumerate(gram):
        value = (value + p + 1) * int(language_id._STEPS[n]) % (1 << 64)
    return int(language_id.mix64(np.array([value], dtype=np.uint64))[0]) >> (64 - language_id.BUCKET_BITS)


def buckets_brute(text):
    out = Counter()
    for g, n in grams_brute(text or "").items():
        out[bucket_of(g)] += n
    return out


def test_grams_equal_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 7)
    texts = ["", "a", "Ab c", "..x..", "İß ÀÉ", "日本 語", "abc", "12 34", "Éa-b­c 𝒳y", "x" * 30]
    (block,) = blocks(iter([pa.RecordBatch.from_pydict({"text": [*texts, None]})]))
    stream, starts = language_id.letter_stream(block)
    got = [Counter() for _ in range(len(texts) + 1)]
    for begin, bucket in language_id.grams(stream):
        for b, k in zip(begin.tolist(), bucket.tolist()):
            got[int(np.searchsorted(starts, b, side="right")) - 1][k] += 1
    assert got == [buckets_brute(t) for t in [*texts, None]]


def language_brute(rows):
    seen, prior = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            prior[lang] += 1
            seen[lang].update(buckets_brute(text))
    out = []
    for i, text, _ in rows:
        fold = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        mine = buckets_brute(text)
        if not prior or not any(c.isalpha() for c in text or ""):
            out.append((i, fold, "und", 0.0))
            continue
        a, b = language_id.SMOOTHING, language_id.BUCKETS
        z = {g: math.log(prior[g] / sum(prior.values())) + sum(n * math.log((seen[g][k] + a) / (sum(seen[g].values()) + a * b)) for k, n in mine.items())
             for g in sorted(prior)}
        top = max(z, key=lambda g: z[g])
        out.append((i, fold, top, 1 / sum(math.exp(v - z[top]) for v in z.values())))
    return out


@pytest.mark.parametrize("per_pass", [16, 2])
def test_language_equals_brute_force(spark, per_pass, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES_PER_PASS", per_pass)
    r = h.rng(9)
    alphabets = {"en": "etaoin", "de": "ßüenr", "fr": "éèaul", "xx": "日本語", "yy": "etao"}
    rows = []
    for i in range(60):
        lang = r.choice([*alphabets, None])
        rows.append((i, "".join(r.choice(alphabets[lang or "en"] + " ") for _ in range(r.randrange(1, 25))), lang))
    rows += [(None, "etao", "zz"), (None, None, None), (61, "", "en"), (62, " 12 ", "en"), (63, "eeee", "en"), (63, "eeee", "en")]
    df = spark.createDataFrame([(*x, 2.5) for x in rows], "doc_id long, text string, lang string, score double")
    counts = language_id.train(df.where(F.col("doc_id").isNotNull() & ~language_id.held_out("doc_id")))
    named = language_id.predict(df, counts, per_pass=per_pass).select("doc_id", language_id.held_out("doc_id"), "lang_pred", "score")
    key = repr
    for got in ([tuple(x) for x in named.collect()], [tuple(x) for x in language_id.identify(df).collect()]):
        for a, b in zip(sorted(got, key=key), sorted(language_brute(rows), key=key), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-4)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string"
    assert language_id.identify(spark.createDataFrame([], schema)).count() == 0
    (x,) = language_id.identify(spark.createDataFrame([(1, "abc", None)], schema)).collect()
    assert (x.lang_pred, x.score) == ("und", 0.0)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    row = judged.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert row.n > 100 and row.right >= 0.98
