"""Minimum-cost-flow resharding.

Rows lie in old shards.  A flow from old shard sizes to new capacities that
moves the fewest bytes says how much each old shard sends to each new one; it
is carried out in blocks (hash ranges of a shard), and only shards that send or
receive a block need new files.  Rows of equal text share a block; only a group
that no shard has room for is dealt out by id.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of an old shard at least, rows of a block aimed at, and blocks at most.
#: The driver gets a row for each block, so MAX_BLOCKS bounds what it holds and broadcasts.
BLOCKS_PER_SHARD, ROWS_PER_BLOCK, MAX_BLOCKS = 1024, 100_000, 1 << 20
#: A block of over so many times the mean rows is numbered in parts, each by a task of its own.
UNEVEN = 4


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest integer flow that sends every supply to demands (of the same sum).

    Successive cheapest augmenting paths over the residual graph (Bellman-Ford).
    """
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(demand)
    while any(left):
        far = [0 if left[i] else None for i in range(n)] + [None] * m
        came: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] is not None and (far[n + j] is None or far[i] + cost[i][j] < far[n + j]):
                        far[n + j], came[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] is not None and (far[i] is None or far[n + j] - cost[i][j] < far[i]):
                        far[i], came[i], changed = far[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if room[j] and far[n + j] is not None), key=lambda j: far[n + j], default=None)
        if end is None:
            raise ValueError("demands are less than supplies")
        path, v = [], n + end
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end] -= amount
    return flow


@dataclass
class Plan:
    """Where each block goes: block -> (new shard, first slot); the bytes moved; shards to be rewritten, and those of them left empty."""

    places: dict[int, tuple[int, int]]
    moved_bytes: int
    affected: list[int]
    emptied: list[int] = field(default_factory=list)


def assign_blocks(blocks: list[tuple[int, int, int, int]], capacities: list[int]) -> Plan:
    """blocks: (block, old shard, bytes, rows).  Old shard i and new shard i are the same place."""
    m = len(capacities)
    n = max([m, *(b[1] + 1 for b in blocks)]) if blocks else m
    supply = [0] * n
    for _, old, size, _ in blocks:
        supply[old] += size
    spare = sum(capacities) - sum(supply)
    if spare < 0:
        raise ValueError("capacities are less than what there is")
    cost = [[int(i != j) for j in range(m)] for i in range(n)]
    flow = min_cost_flow([*supply, spare], capacities, [*cost, [0] * m])
    by_shard: dict[int, list] = {}
    for b in sorted(blocks, key=lambda b: (-b[2], b[0])):
        by_shard.setdefault(b[1], []).append(b)
    to: dict[int, int] = {}
    load = [0] * m
    for old, own in by_shard.items():
        needs = {j: flow[old][j] for j in range(m) if j != old}
        for block, _, size, _ in own:
            j = max(needs, key=lambda j: (needs[j], -j), default=None)
            if old >= m or j is not None and needs[j] >= size:
                needs[j] -= size
            else:
                j = old
            to[block] = j
            load[j] += size
    # What the flow asks for is met but for less than a block by shard; level the rest.
    held: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for block, _, size, _ in blocks:
        held[to[block]].append((size, block))
    for h in held:
        h.sort()
    over = lambda j: load[j] - capacities[j]
    for _ in range(4 * len(blocks) if m > 1 else 0):
        a, b = max(range(m), key=over), min(range(m), key=over)
        gap = over(a) - over(b)
        # of the blocks smaller than the gap, that nearest to half of it
        i = bisect_left(held[a], (gap / 2,))
        fits = [x for x in held[a][max(0, i - 1) : i + 1] if 0 < x[0] < gap]
        if not fits:
            break
        size, block = min(fits, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        if max(abs(over(a) - size), abs(over(b) + size)) >= max(abs(over(a)), abs(over(b))):
            break
        del held[a][bisect_left(held[a], (size, block))]
        insort(held[b], (size, block))
        load[a] -= size
        load[b] += size
        to[block] = b
    places, slots, moved, touched = {}, [0] * m, 0, set()
    for block, old, size, rows in sorted(blocks):
        j = to[block]
        places[block] = (j, slots[j])
        slots[j] += rows
        if j != old:
            moved += size
            touched |= {j, old}
    return Plan(places, moved, sorted(touched), sorted(j for j in touched if j >= m or not slots[j]))


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def measured(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with _size (UTF-8 bytes of the text, null: none, plus 1) and _hash (of the text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_size": (F.octet_length(text) + 1).cast("long"), "_hash": F.xxhash64(text)})


def reshard(
    docs: DataFrame,
    n_new: int,
    *,
    n_old: int,
    old_shard: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    is_measured: bool = False,
) -> tuple[DataFrame, Plan]:
    """docs with _size, shard and slot (gapless from 0 in each shard), and the plan.

    A row weighs its text's UTF-8 bytes (null: none) plus 1, and new shards get
    equal capacities.  ``old_shard`` is where rows lie now, 0 to ``n_old`` - 1; by
    default the text's hash says.  Equal texts (null equals empty) stay together
    unless they are more than a shard holds; repeated rows get a slot each; an empty
    table gives an empty one.  Columns shard, slot and those of the operator's own
    names (each begins with an underscore) are replaced.  ``is_measured``: docs
    come from ``measured`` and need no text.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "_old", "_block", "_part", "_parts", "_b", "_p", "_first")
    own = docs if is_measured else measured(docs, text_col=text_col)
    own = own.withColumn("_old", (old_shard if old_shard is not None else F.pmod("_hash", F.lit(n_old))).cast("int"))
    rows = docs.select(F.lit(1)).count()
    per_shard = min(MAX_BLOCKS // n_old, max(BLOCKS_PER_SHARD, rows // ROWS_PER_BLOCK // n_old))
    block = lambda by: F.col("_old").cast("long") * per_shard + F.pmod(F.shiftright(by, 8), F.lit(per_shard))
    own = own.withColumn("_block", block(F.col("_hash")))
    count = lambda df: df.groupBy("_block", "_old").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    blocks = count(own)
    total = sum(b["bytes"] for b in blocks)
    room = total / n_new
    if heavy := [b["_block"] for b in blocks if b["bytes"] > room]:  # fewer than n_new
        groups = own.filter(F.col("_block").isin(heavy)).groupBy("_hash").agg(F.sum("_size").alias("bytes")).filter(F.col("bytes") > room)
        if hot := [r["_hash"] for r in groups.collect()]:  # fewer than n_new
            salted = F.when(F.col("_hash").isin(hot), block(F.xxhash64(F.lit(1), F.col(id_col)))).otherwise(F.col("_block"))
            own = own.withColumn("_block", salted)
            blocks = count(own)
    plan = assign_blocks([(b["_block"], b["_old"], b["bytes"], b["rows"]) for b in blocks], even_capacities(total, n_new))
    # blocks far above the mean are numbered in parts; the parts of all are no more than the blocks
    mean = max(100.0, rows / max(1, len(blocks)))
    parts = {b["_block"]: int(b["rows"] / mean) for b in blocks if b["rows"] > UNEVEN * mean}
    firsts = {(k, 0): v for k, v in plan.places.items()}
    own = own.withColumn("_part", F.lit(0))
    if parts:
        by_part = spark.createDataFrame(list(parts.items()), "_b long, _parts int")
        own = own.join(F.broadcast(by_part), F.col("_block") == F.col("_b"), "left").drop("_b")
        own = own.withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), "_parts")).otherwise(0).cast("int"))
        sizes = {(r["_block"], r["_part"]): r["n"] for r in own.filter("_parts IS NOT NULL").groupBy("_block", "_part").agg(F.count(F.lit(1)).alias("n")).collect()}
        for k, n in parts.items():
            shard, first = plan.places[k]
            for i in range(n):
                firsts[k, i] = (shard, first)
                first += sizes.get((k, i), 0)
        own = own.drop("_parts")
    places = spark.createDataFrame([(*k, *v) for k, v in firsts.items()], "_b long, _p int, shard int, _first long")
    placed = own.join(F.broadcast(places), (F.col("_block") == F.col("_b")) & (F.col("_part") == F.col("_p")))  # 2 * MAX_BLOCKS rows at most
    order = Window.partitionBy("_block", "_part").orderBy("_hash", id_col)
    placed = placed.withColumn("slot", F.col("_first") + F.row_number().over(order) - 1)
    return placed.drop("_hash", "_old", "_block", "_part", "_b", "_p", "_first"), plan


def rewrite_affected(placed: DataFrame, plan: Plan, folder: str) -> None:
    """Replace the shards that sent or received blocks in folder (shard=N/...); others keep their files.

    Only the affected shards' folders are replaced (a dynamic partition
    overwrite), and those of shards left empty are deleted; ``placed`` may have
    been read from the folder itself.
    """
    if not plan.affected:
        return
    changed = placed.filter(F.col("shard").isin(plan.affected))
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    spark = placed.sparkSession
    for shard in plan.emptied:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
