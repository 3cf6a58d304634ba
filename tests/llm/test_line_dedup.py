import random

import pytest

from quillspark.llm.line_dedup import dedup_lines


def brute(docs, size=3):
    once = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    places = {}
    for d in once:
        lines = d[1].split("\n")
        for i in range(max(1, len(lines) - size + 1)):
            w = tuple(lines[i:i + size])
            if any(x.strip(" \t") for x in w):
                places.setdefault(w, []).append((d, i))
    gone = {}
    for w, at in places.items():
        for d, i in at[1:]:
            gone.setdefault(d, set()).update(range(i, i + len(w)))
    out = []
    for d in docs:
        lines = d[1].split("\n") if d[1] is not None else []
        g = gone.get(d, set())
        out.append((d[0], None if d[1] is None else "\n".join(x for i, x in enumerate(lines) if i not in g), len(lines), len(g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["", " ", "a", "b", "é", *[f"line {i}" for i in range(12)]]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "x\ny\nz"), (502, "x\ny\nz"), docs[0], docs[0], (503, "\n\n\n\n"), (504, "q\n" * 40)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, _gone string").repartition(4)
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(frame).collect()), key=str)
    assert got == brute(docs)


def test_empty_and_long(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = spark.createDataFrame([(1, "\n".join(f"l{i % 5000}" for i in range(20_000)))], "doc_id long, text string")
    assert dedup_lines(long).first()["n_removed"] == 15_000
