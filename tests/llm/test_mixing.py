import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm.mixing import capped_targets, cumulative, cyclic_weights, due, mix, ramp, training_order


def brute_targets(sizes, weights, cap):
    """Share by weight, fix whatever is above its cap, and share the rest again."""
    total, fixed = float(sum(sizes)), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        w = sum(weights[i] for i in rest)
        share = {i: (total - sum(fixed.values())) * weights[i] / w for i in rest}
        over = [i for i in rest if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


@pytest.mark.parametrize("seed", range(30))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 10 ** rng.randrange(1, 6)) for _ in range(rng.randrange(1, 12))]
    weights = cyclic_weights(len(sizes))
    got = capped_targets(sizes, weights, sum(sizes), 3.0)
    assert got == pytest.approx(brute_targets(sizes, weights, 3.0))
    assert sum(got) == pytest.approx(sum(sizes))


def test_due_inverts_the_integral(spark):
    knots = [(0.0, 1.0), (0.25, 3.0), (0.6, 0.0), (1.0, 2.0)]
    pieces = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(p, ("t", "area", "weight", "slope"))]) for p in cumulative(knots)])
    got = spark.range(101).select((F.col("id") / 100).alias("u"), due(F.col("id") / 100, pieces).alias("t")).collect()
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    for u, t in got:
        done = 0.0
        for (a, w), (b, v) in zip(knots, knots[1:]):
            x = min(max(t, a), b)
            done += (x - a) * (w + w + (v - w) * (x - a) / (b - a)) / 2
        assert done / area == pytest.approx(u, abs=1e-6)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "é", "", "zz"])
        text = rng.choice([None, "", " \t\n", *[" ".join(["w"] * rng.randrange(1, 60))] * 12])
        out.append((rng.choice([i, i, None]), text, source, i))
    return out + out[:20]


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _name int").repartition(5)
    got = mix(docs).collect()
    again = mix(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["source"] or "", r["_taken"], r["_positions"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["_size"] == len((r["text"] or "").split())
        assert 0 <= r["_taken"] <= 3 * r["_size"]
        assert all(0 <= p <= 1 for p in r["_positions"]) and bool(r["_positions"]) == (r["_taken"] > 0)
        sizes[r["source"]] += r["_size"]
        taken[r["source"]] += r["_taken"]
        target[r["source"]] = r["_target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets([sizes[s] for s in order], cyclic_weights(len(order)), 3.0)
    for s, w in zip(order, want):
        assert target[s] == pytest.approx(w) and abs(taken[s] - w) <= 1
    ordered = training_order(mix(docs), ["doc_id", "text", "source"])
    assert ordered.columns == ["doc_id", "text", "source"]
    assert abs(sum(len((r["text"] or "").split()) for r in ordered.collect()) - sum(sizes.values())) <= 60 * len(sizes)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0
    with pytest.raises(ValueError):
        cumulative(ramp(1.0, 2.0))
