import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm.toxicity import ToxicityModel, fit, fit_extreme_values, log_odds, maximal_segments, score


def brute_maximal(scores):
    """Ruzzo and Tompa's definition: take the best segment, then left and right of it."""
    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = sum(scores[a:b])
                if s > 0 and (best is None or s > best[2] or s == best[2] and b - a < best[1] - best[0]):
                    best = (a, b, s)
        return [] if best is None else [*go(lo, best[0]), best, *go(best[1], hi)]
    return go(0, len(scores))


@pytest.mark.parametrize("seed", range(60))
def test_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-1, 1]) * rng.randrange(1, 2**20) / 2**10 for _ in range(rng.randrange(0, 25))]
    assert [x[:2] for x in maximal_segments(scores)] == [x[:2] for x in brute_maximal(scores)]


def test_log_odds(spark):
    """The formula in plain Python gives the same, and rare tokens are shrunk."""
    cases = [(500.0, 0.0), (2.0, 0.0), (0.0, 900.0), (37.0, 12.0)]
    n1, n0, prior = 1000, 9000, 0.02
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "y1 double, y0 double")
    got = [tuple(r) for r in frame.select(*log_odds(F.col("y1"), F.col("y0"), n1, n0, prior)).collect()]
    for (y1, y0), (delta, z) in zip(cases, got):
        a1, a0 = (prior * n * (y1 + y0) / (n1 + n0) for n in (n1, n0))
        want = math.log((y1 + a1) / (n1 * (1 + prior) - y1 - a1)) - math.log((y0 + a0) / (n0 * (1 + prior) - y0 - a0))
        assert delta == pytest.approx(want) and z == pytest.approx(want / math.sqrt(1 / (y1 + a1) + 1 / (y0 + a0)))
    assert got[0][1] > 5 and 0 < got[1][1] < 1.65 and got[2][0] < 0


def test_offsets_are_those_of_the_text(spark):
    model = ToxicityModel({"vile": (9.0, 9.0)}, k=0.1, slope=4.0, bias=-6.0)
    text = "İİİ ẞ plain VILE words"
    (got,) = score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [text[p["start"] : p["end"]] for p in got["_passages"]] == ["VILE"]


def test_held_out_rows_of_the_test_tables(spark):
    """Labelled rows that nothing was learned from: no clean document is called toxic, most toxic ones are."""
    from quillspark.llm.registry import op2_toxicity

    folder = "/root/testdata/sf0.1"
    held = op2_toxicity(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in held if r["toxic"] == 1]
    assert len(toxic) > 100 and sum(toxic) >= 0.75 * len(toxic)
    assert sum(r["predicted"] for r in held if r["toxic"] == 0) <= 0.005 * len(held)


def test_extreme_value_fit():
    rng = random.Random(4)
    best = []
    for _ in range(4000):
        n = rng.randrange(50, 3000)
        best.append((n, (math.log(0.3 * n) - math.log(-math.log(rng.random()))) / 1.7))
    rate, k = fit_extreme_values(best)
    assert rate == pytest.approx(1.7, rel=0.05) and k == pytest.approx(0.3, rel=0.25)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["Gruxo", "vilbat", f"snarkle{rng.choice('abcdefgh')}{rng.choice(words)}"]))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 7)
    frame = spark.createDataFrame(docs, "doc_id long, text string, _score string").repartition(4)
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    model = fit(frame, known)
    got = {r["doc_id"]: r for r in score(frame, model).collect()}
    held = [(y, got[i]["_score"]) for i, y in labels if i % 5 == 0]
    assert sum((s >= 0.7) == bool(y) for y, s in held) / len(held) > 0.98
    i = next(i for i, y in labels if y and i % 5 == 0 and got[i]["_passages"])
    p = got[i]["_passages"][0]
    assert any(w in docs[i][1][p["start"]:p["end"]].lower() for w in ("gruxo", "vilbat", "snarkle"))


def test_edges(spark):
    model = ToxicityModel({"bad": (9.0, 9.0)}, rate=3.0, slope=4.0, bias=-6.0)
    rows = [(1, None), (2, ""), (3, "bad"), (3, "bad"), (None, "good " * 50_000 + "bad")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = score(frame, model).collect()
    assert len(got) == 5 and all(0 <= r["_score"] <= 1 for r in got)
    by = {(r["doc_id"]): r["_score"] for r in got}
    assert by[1] == by[2] < 0.7 <= by[3] and by[None] >= 0.7
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit(frame, none).weights == {} and score(frame.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (2, None)], "doc_id long, toxic int")
    assert all(r["_score"] < 0.7 for r in score(frame, fit(frame, one)).collect())


def test_a_repeated_passage_is_found_each_time(spark):
    model = ToxicityModel({w: (6.0, 9.0) for w in ("vile", "nasty", "awful")}, k=0.1, slope=4.0, bias=-6.0)
    text = " ".join(["plain " * 200 + "vile nasty awful"] * 60)
    (got,) = score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [text[p["start"] : p["end"]] for p in got["_passages"]] == ["vile nasty awful"] * 60
