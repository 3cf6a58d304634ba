import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm.sharding import assign_blocks, even_capacities, min_cost_flow, reshard, rewrite_affected


@pytest.mark.parametrize("seed", range(20))
def test_flow_moves_only_the_surplus(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 9)
    supply = [rng.randrange(0, 1000) for _ in range(n)]
    demand = even_capacities(sum(supply), n)
    flow = min_cost_flow(supply, demand, [[int(i != j) for j in range(n)] for i in range(n)])
    assert [sum(f) for f in flow] == supply
    assert [sum(f[j] for f in flow) for j in range(n)] == demand
    moved = sum(f[j] for i, f in enumerate(flow) for j in range(n) if i != j)
    assert moved == sum(max(0, s - d) for s, d in zip(supply, demand))


def test_blocks_follow_the_flow():
    rng = random.Random(1)
    blocks = [(i, i % 5, rng.randrange(1, 300), 2) for i in range(2000)]
    total = sum(b[2] for b in blocks)
    plan = assign_blocks(blocks, even_capacities(total, 6))
    load = Counter()
    for b in blocks:
        load[plan.places[b[0]][0]] += b[2]
    assert max(load.values()) - min(load.values()) <= 2
    old = Counter()
    for b in blocks:
        old[b[1]] += b[2]
    least = sum(max(0, old[i] - total / 6) for i in range(5))
    assert plan.moved_bytes <= least + 6 * 300


def check(rows, got, n):
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(r[0]), r[1] or "") for r in rows)
    slots, load = defaultdict(list), Counter()
    for r in got:
        assert r["_size"] == len((r["text"] or "").encode()) + 1 and 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["_size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_reshard(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "x" * rng.randrange(1, 200), f"é{i}" * 9]), "s") for i in range(3000)]
    rows += [(10_000 + i, "copy " * 12, "t") for i in range(100)] + rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)
    placed, plan = reshard(docs, 8, n_old=7)
    got = placed.collect()
    load = check(rows, got, 8)
    assert max(load.values()) - min(load.values()) <= 300
    shards = defaultdict(set)
    for r in got:
        shards[r["text"] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["shard"])
    assert sorted(map(key, got)) == sorted(map(key, reshard(docs.repartition(2), 8, n_old=7)[0].collect()))


def test_rewrite_replaces_the_old_shards(spark, tmp_path):
    rng = random.Random(5)
    folder = str(tmp_path / "shards")
    rows = [(i, f"text {i} " * rng.randrange(1, 20), i % 9 if i % 9 < 6 else 5) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(folder)
    for n_new in (8, 8, 3):
        old = spark.read.parquet(folder)
        untouched = defaultdict(set)
        for r in old.select("shard", F.input_file_name().alias("f")).collect():
            untouched[r["shard"]].add(r["f"])
        own = old.withColumn("_was", F.col("shard"))
        placed, plan = reshard(own, n_new, n_old=max(untouched) + 1, old_shard=F.col("_was"))
        want = sorted((r["doc_id"], r["shard"], r["slot"]) for r in placed.collect())
        rewrite_affected(placed.drop("_was", "_size"), plan, folder)
        spark.catalog.refreshByPath(folder)
        back = spark.read.parquet(folder)
        got = back.select("doc_id", "shard", "text", F.input_file_name().alias("f")).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(r[:2] for r in rows)
        assert sorted((r["doc_id"], r["shard"]) for r in got) == [w[:2] for w in want]
        for j in set(range(n_new)) - set(plan.affected):
            assert {r["f"] for r in got if r["shard"] == j} == untouched[j]
        assert sorted({r["shard"] for r in got}) == list(range(n_new))


def test_a_group_of_copies_larger_than_a_shard_is_split(spark):
    rows = [(i, "same text", "s") for i in range(2000)] + [(5000 + i, f"text {i}", "s") for i in range(2000)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    load = check(rows, reshard(docs, 4, n_old=4)[0].collect(), 4)
    assert max(load.values()) - min(load.values()) <= 60


def test_a_large_group_that_fits_stays_together(spark):
    rows = [(i, "same text", "s") for i in range(900)] + [(5000 + i, f"text {i}", "s") for i in range(3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = reshard(docs, 4, n_old=4)[0].collect()
    load = check(rows, got, 4)
    assert len({r["shard"] for r in got if r["text"] == "same text"}) == 1
    assert max(load.values()) - min(load.values()) <= 60


def test_a_very_long_text(spark):
    rows = [(1, "é" * 3_000_000)] + [(i, f"text {i}") for i in range(2, 300)]
    check(rows, reshard(spark.createDataFrame(rows, "doc_id long, text string"), 4, n_old=3)[0].collect(), 4)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert reshard(docs, 8, n_old=7)[0].count() == 0
