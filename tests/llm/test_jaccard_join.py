import random

import numpy as np
import pytest

from quillspark.llm.jaccard_join import Words, meetings, near_duplicates, shingles, signatures


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(docs, percent=85):
    sets = [grams(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs))


@pytest.mark.parametrize("seed", range(12))
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    for _ in range(400):
        n = int(rng.integers(6, 12)) if rng.random() < 0.4 else int(rng.integers(6, 700))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop, add = 0, 0
        while 15 * (2 * len(a) - drop + add + (rng.random() < 0.5)) >= 185 * (drop + add + 1):
            if rng.random() < 0.5:
                drop += 1
            else:
                add += 1
        if 15 * (2 * len(a) - drop + add) < 185 * (drop + add):
            continue
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
        (sa, na), (sb, nb) = signatures(a, 85), signatures(b, 85)
        shared = np.bincount(np.intersect1d(sa, sb) & 3, minlength=4)
        least = [[n >> 8 * w & 255 for w in range(4)] for n in (na, nb)]
        # in a size class where both are, they share as many as each must share
        assert np.array_equal(a, b) or any(x and y and s >= max(x, y) for x, y, s in zip(*least, shared)), (len(a), drop, add)


def test_meetings_cover_all_sizes():
    for n in range(6, 300):
        for m in range(n, 100 * n // 85 + 1):
            assert {c for c, *_ in meetings(n, 85)} & {c for c, *_ in meetings(m, 85)}


def test_shingles():
    words = Words()
    assert len(shingles("A b c d e", 4, words)) == 2 and len(shingles("a b", 4, words)) == 1 and len(shingles(" \t\n", 4, words)) == 0
    assert np.array_equal(shingles("A B\x0bC D", 4, words), shingles("a b c d ", 4, words))
    assert not np.array_equal(shingles("É b c d", 4, words), shingles("é b c d", 4, words))


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(40))
    base = [[word() for _ in range(rng.choice([2, 5, 9, 12, 30, 80, 300]))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(rng.randrange(1, 12)):
            w = list(b)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            texts.append(rng.choice([" ", "\n"]).join(w).upper() if rng.random() < 0.3 else " ".join(w))
    chain = [word() for _ in range(120)]  # neighbours link, ends don't
    for i in range(12):
        chain = chain[2:] + [word(), word()]
        texts.append(" ".join(chain))
    texts += [passage + " " + word() * 2 for _ in range(8)] + ["same text here now"] * 9 + [None, "", "  ", "\n"]
    docs = list(enumerate(texts)) + [(3, texts[3])]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, c string").repartition(5)
    got = sorted(tuple(r) for r in near_duplicates(frame).collect())
    assert got == brute(docs)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
