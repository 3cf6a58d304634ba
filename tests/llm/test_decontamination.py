import random
import re
from collections import Counter

import pytest

from quillspark.llm.decontamination import contamination, matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))


def brute(docs, items, size=8):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", *[f"w{i}" for i in range(30)], "É", "été", "日本", "🙂"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([3, 37])]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 8, 9, 20]))) for i in range(25)] + [(3, "The of, a THE!"), (99, None), (100, "...")]
    docs = []
    for i in range(150):
        parts = [text(rng.randrange(0, 30))]
        if rng.random() < 0.6:
            parts.append((rng.choice(items)[1] or "").upper().replace("É", "É"))
        docs.append((i % 140, rng.choice([" ", ", ", "\n--"]).join(parts)))
    docs += [(500, None), (501, ""), (None, "w1 w2"), docs[0], docs[0]]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, _words string").repartition(5)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_hit int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in contamination(frame, bench).collect()), key=str)
    assert got == brute(docs, items)


def brute_near(docs, items, size=8):
    """(row, item, start, n) by the rule: all words of a window, as often, within reach of its rarest term."""
    windows, counts = {}, Counter()
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    used = {t for k in windows for t in k}
    for _, text in docs:
        counts.update(t for t in words(text) if t in used)
    out = set()
    for row, (_, text) in enumerate(docs):
        w = words(text)
        for window, found in windows.items():
            rare = min((counts[t], i, t) for i, t in enumerate(window))[2]
            for p in [i for i, t in enumerate(w) if t == rare]:
                spots = [i for i in range(max(0, p - size + 1), min(len(w), p + size)) if w[i] in window]
                have = Counter(w[i] for i in spots)
                if all(have[t] >= n for t, n in Counter(window).items()):
                    out |= {(docs[row][0], item, spots[0], spots[-1] - spots[0] + 1) for item in found}
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_proximity(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", *[f"w{i}" for i in range(12)]]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 9]))) for i in range(12)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + i, " ".join(rng.sample((t := items[i % 12][1].split()[:8]), len(t)))) for i in range(24)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["_item"], r["_start"], r["_n"]) for r in matches(frame, bench, exact=False).drop("_x").distinct().collect())
    assert got == brute_near(docs, items) and len(got) > 50


def test_a_very_long_text(spark):
    passage = "eins zwei drei vier fuenf sechs sieben acht neun zehn"
    long = "the " * 300_000 + passage + " the of" * 100_000
    bench = spark.createDataFrame([(1, passage), (2, "the of the of the of the of"), (3, "zz " * 8)], "item_id long, text string")
    got = contamination(spark.createDataFrame([(1, long), (2, "the")], "doc_id long, text string"), bench)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()} == {1: (500_010, 200_010, ["1", "2"]), 2: (1, 0, [])}


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs.limit(0), bench).count() == 0
    assert [r["items"] for r in contamination(docs, bench.limit(0)).collect()] == [[]]
    assert [r["items"] for r in contamination(docs, bench).collect()] == [["1"]]
