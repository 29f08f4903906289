"""Jaccard join and edit fingerprints beside brute force."""

import hashlib

import helpers as h
import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyframe.llm import edit_fingerprint as ef
from tallyframe.llm import jaccard, queries
from tallyframe.llm.blocks import hash_words, shingle_sets, split_words
from tallyframe.llm.components import components


def pack(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_words_and_shingles():
    texts = ["", "a", " a  b\n", "x y z", "\x0b", "Tail head"] + ["p q r s t u", "P Q r s\tt u", "é è"]
    data, offsets = pack(texts)
    w = split_words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == [x for t in texts for x in h.WORD.findall(t)]
    assert len(set(hash_words(data, w).tolist())) == len({x for t in texts for x in h.WORD.findall(t)})
    sets = shingle_sets(data, offsets)
    assert [len(s) for s in sets] == [len(h.shingles(t)) for t in texts]
    assert (sets[6] == sets[7]).all()


def test_components(spark):
    r = h.rng(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)]
    out = {x.node: x.component for x in components(spark.createDataFrame(edges + [(None, 1), (7, 7)], "a long, b long")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert out == {i: root(i) for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [jaccard.BLOCK, 16])
def test_near_components(spark, block):
    r = h.rng(2)
    passage = h.words(r, 60)
    texts = h.awkward(r) + ["ONE two three FOUR", "one Two three four"]
    base = h.words(r, 120)
    texts += [h.mutate(r, base, r.randrange(1, 6)) for _ in range(90)]  # a list longer than the limit
    chain = h.words(r, 150)
    for _ in range(40):
        chain = h.mutate(r, chain, 2)
        texts.append(chain)
    texts += [passage + " " + h.words(r, r.randrange(5, 200)) for _ in range(80)]  # a frequent passage
    texts += [h.words(r, r.randrange(1, 60)) for _ in range(60)] + [base] * 40
    ids = [r.randrange(10**9) for _ in texts]
    docs = h.table(spark, texts, ids).withColumn("cluster", F.lit(1)).withColumn("n", F.lit("x"))
    out = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_components(docs, block=block).collect()}
    assert out == h.near_classes(ids, texts)


def test_near_edges(spark):
    docs = h.table(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "z"], [None, 4, 3, None, 9])
    out = sorted(jaccard.near_components(docs).collect(), key=str)
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in out) == [
        ("3", 2, "3"), ("4", 2, "3"), ("9", 1, "9"), ("None", 0, "None"), ("None", 2, "None")]
    assert jaccard.near_components(docs.limit(0)).count() == 0
    both = docs.withColumn("_h", F.lit(1)).withColumn("_all", F.lit("x"))
    kept = jaccard.drop_near_copies(both)
    assert kept.columns == both.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["3", "9", "None", "None"]
    assert jaccard.drop_near_copies(both.limit(0)).count() == 0


def test_passage_spread_over_tasks_links_nothing(spark, monkeypatch):
    """A passage is frequent by its count over all tasks; else its lists link all its texts untested."""
    r = h.rng(31)
    passage = h.words(r, 40)
    texts = [passage + " " + h.words(r, 160, 10**6) for _ in range(2 * jaccard.LIST)]
    found = []
    monkeypatch.setattr(jaccard, "components", lambda pairs, *a: found.append(pairs.count()) or components(pairs, *a))
    out = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_components(h.table(spark, texts, parts=len(texts))).collect()}
    assert out == h.near_classes(list(range(len(texts))), texts)
    assert found == [0]


@pytest.mark.parametrize("block", [3, 4096])
def test_one_id_with_several_texts(spark, block):
    r = h.rng(21)
    one, two = h.words(r, 60), h.words(r, 60)
    texts = [one, h.mutate(r, one, 1), two, h.mutate(r, two, 1), h.mutate(r, one, 1), one]
    ids = [7, 7, 7, 3, 9, 7]  # id 7 has two near texts of one cluster and one of another
    out = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_components(h.table(spark, texts, ids), block=block).collect())
    size = [len(h.shingles(t)) for t in texts]
    assert out == sorted([(7, size[0], 7), (7, size[1], 7), (7, size[2], 3), (3, size[3], 3), (9, size[4], 7), (7, size[5], 7)])


def test_list_entries_survive_packing():
    r = np.random.default_rng(8)
    for n in (1, 7, 5000):
        key = np.sort(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        ref, size, flag = r.integers(0, 2**64, max(1, n // 3), dtype=np.uint64), r.integers(1, 2**31, max(1, n // 3)).astype(np.uint32), r.random(n) < 0.3
        pick = r.integers(0, len(ref), n)
        for a, b in zip(jaccard._unpack(jaccard._pack(key, ref[pick], size[pick], flag)), (key, ref[pick], size[pick], flag)):
            assert (a == b).all()


def test_search_equals_all_pairs():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = r.choice(500, 60, replace=False)
        for _ in range(12):
            s = base.copy()
            k = r.integers(0, 14)
            s[r.choice(60, k, replace=False)] = r.integers(1000, 10**6, k)
            sets.append(np.unique(s.astype(np.uint64)))
    n = len(sets)
    want = list(range(n))

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    asks, holds = r.random(n) < 0.7, r.random(n) < 0.7
    for i in range(n):
        for j in range(n):
            o = len(np.intersect1d(sets[i], sets[j]))
            if i != j and asks[i] and holds[j] and 7 * o >= 3 * (len(sets[i]) + len(sets[j])):
                a, b = root(i), root(j)
                want[max(a, b)] = min(a, b)
    assert jaccard.search(sets, asks, holds).tolist() == [root(i) for i in range(n)]


def test_fingerprint_is_of_the_text_alone():
    r = h.rng(7)
    texts = h.awkward(r) + [h.words(r, 100) for _ in range(20)]
    together = ef.fingerprint_texts(*pack(texts))
    for i, t in enumerate(texts):
        assert (ef.fingerprint_texts(*pack([t])) == together[i]).all()
    apart = ef.fingerprint_texts(*pack([h.words(r, 100) for _ in range(40)]))
    assert ef.likeness(apart[:20], apart[20:]).mean() < 0.12
    base = h.words(r, 200)
    near = ef.fingerprint_texts(*pack([base, h.mutate(r, base, 3)]))
    assert ef.likeness(near[:1], near[1:])[0] > 0.7


def slow_walk(text):
    """Votes of one text, step by step, with plain loops."""
    data, offsets = pack([text])
    votes = np.zeros(ef.BITS, dtype=int)
    raw = data.tobytes() + b"\0" * 4
    for s, n in zip(*ef.segments(data, offsets)[:2]):
        at = int(s)
        for j in range(2 * int(n) + ef.SLACK):
            if at >= s + n:
                break
            if j in ef.SAMPLED:
                gram = np.array([int.from_bytes(raw[at : at + 4], "little")], dtype=np.uint64)
                v = ef.mix64(gram ^ ef._SALT[j]).view(np.uint8)[:2]
                g = ef.SAMPLED.index(j) % 16 * 16
                votes[g : g + 16] += np.unpackbits(v).astype(int) * 2 - 1
            at += int(ef._MOVE[j, raw[at]])
    return votes


def test_fingerprint_equals_the_plain_walk():
    r = h.rng(9)
    for t in [h.words(r, 60), "x" * 900, "é" * 40]:
        votes = slow_walk(t)
        bits = np.unpackbits(ef.fingerprint_texts(*pack([t])), axis=1)[0].astype(bool)
        assert (bits[votes != 0] == (votes > 0)[votes != 0]).all()


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_edit_probe(spark, n):
    r = h.rng(4)
    texts = (h.awkward(r) + [h.words(r, r.randrange(1, 200)) for _ in range(60)])[-n:] if n else []
    ids = r.sample(range(1000), n)
    docs = h.table(spark, texts, ids).withColumn("range", F.lit(1)).withColumn("role", F.lit("x"))
    out = {x.doc_id: x for x in ef.edit_probe(docs).collect()}
    assert len(out) == n
    order = sorted(zip(ids, texts), reverse=True)
    for k, (i, t) in enumerate(order):
        edited = ef.replace_tail(t or "", order[(k + 1) % n][1] or "")
        x, nxt = out[i], out[order[(k + 1) % n][0]]
        assert x.n_chars == len(t or "") and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (np.frombuffer(bytes.fromhex(y), dtype=np.uint8)[None] for y in (x.fingerprint, x.edited_fingerprint, nxt.fingerprint))
        assert x.near_edited == pytest.approx(ef.likeness(a, b)[0]) and x.near_next == pytest.approx(ef.likeness(a, c)[0])
        assert (b[0] == ef.fingerprint_texts(*pack([edited]))[0]).all()


def test_edit_probe_null_and_repeated_ids(spark):
    docs = h.table(spark, ["aa bb", None, "cc dd", "cc dd"], [None, None, 3, 3])
    assert ef.edit_probe(docs).count() == 4


def test_near_links(spark):
    r = h.rng(11)
    base = [h.words(r, 150) for _ in range(15)]
    texts = [t for b in base for t in (b, h.mutate(r, b, 2))] + [base[0]] * 5
    docs = h.table(spark, texts)
    links = {(x.a, x.b) for x in ef.near_links(ef.fingerprints(docs)).collect()}
    assert links <= {(2 * i, 2 * i + 1) for i in range(15)} and len(links) >= 13


def planted_prints(r, n, groups, size, flips):
    """Random fingerprints, and groups that lie ``flips`` bits from a centre each."""
    bits = r.integers(0, 2, (n, ef.BITS), dtype=np.uint8)
    for g in range(groups):
        for k in range(1, size):
            bits[g * size + k] = bits[g * size]
            bits[g * size + k, r.choice(ef.BITS, flips, replace=False)] ^= 1
    return np.packbits(bits, axis=1)


@pytest.mark.parametrize("bucket", [ef.BUCKET, 700])
def test_near_links_recall_against_all_pairs(spark, bucket):
    prints = planted_prints(np.random.default_rng(5), 20_000, 150, 4, 20)
    bits, bands = ef.band_plan(len(prints), 0.6)
    assert bits == 3 and ef.band_plan(1000, 0.6) == (0, 1)
    i, j, _ = ef.close_pairs(prints, np.zeros(len(prints), dtype=bool), 51, False)
    want = {(int(a), int(b)) for a, b in zip(i, j)}
    assert want >= {(4 * g + a, 4 * g + b) for g in range(150) for a in range(4) for b in range(a + 1, 4)}
    table = spark.createDataFrame([(k, p.tobytes().hex()) for k, p in enumerate(prints)], "doc_id long, fingerprint string")
    links = {(x.a, x.b): x.likeness for x in ef.near_links(table, bucket=bucket).collect()}
    assert set(links) <= want and len(links) >= 0.95 * len(want)
    assert all(v == pytest.approx(ef.likeness(prints[a : a + 1], prints[b : b + 1])[0]) for (a, b), v in links.items())


def test_close_pairs_across_and_as_a_forest():
    prints = planted_prints(np.random.default_rng(6), 300, 20, 6, 10)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int)
    side = np.arange(300) % 2 > 0
    for s in (np.zeros(300, dtype=bool), side):
        want = {(a, b) for a in range(300) for b in range(300) if apart[a, b] <= 51 and (a < b if not s.any() else s[b] and not s[a])}
        i, j, d = ef.close_pairs(prints, s, 51, False)
        assert set(zip(i.tolist(), j.tolist())) == want and (apart[i, j] == d).all()
        i, j, _ = ef.close_pairs(prints, s, 51, True)
        assert set(zip(i.tolist(), j.tolist())) <= want and len(i) == 20 * 5


def test_query_names_near_components(spark, tmp_path):
    r = h.rng(13)
    base = [h.words(r, 150) for _ in range(6)]
    texts = [t for b in base for t in (b, h.mutate(r, b, 2), b)] + [None, ""]
    h.table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = {x.doc_id: x.near_id for x in queries.op8_edit_fingerprint(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts) and out[19] == 18
    assert sum(out[3 * g + k] == 3 * g for g in range(6) for k in range(3)) >= 17
