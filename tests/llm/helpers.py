"""Small tables and brute-force versions shared by the tests."""

import random
import re

SPACES = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None, parts=3, schema=SCHEMA):
    """Documents with the given texts (nulls allowed)."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else "de", f"s{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, schema).repartition(parts)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def mutate(rng, text, edits):
    parts = text.split(" ")
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = f"e{rng.randrange(10**6)}"
    return " ".join(parts)


def awkward(rng):
    """Texts that operators must not trip over."""
    return [None, "", " \t\n", "a", "a b", "é ß", "日本 語", "x" * 30_000, words(rng, 20_000, 50), "\u00a0nbsp", "one two three four", "A\x0bB"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_classes(ids, texts):
    """Smallest id reachable by links, by comparing every pair."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            o = len(a & b)
            if a and b and 100 * o >= 75 * (len(a) + len(b) - o):
                up[root(i)] = root(j)
    best = {}
    for i, d in enumerate(ids):
        best[root(i)] = min(d, best.get(root(i), d))
    return {d: (len(sets[i]), best[root(i)]) for i, d in enumerate(ids)}


def rng(seed=5):
    return random.Random(seed)
