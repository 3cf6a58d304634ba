"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule of weight over training time t in [0, 1], linear
between knots.  Its integral, scaled, is the source's demand for words; turning
that integral around gives the time at which the n-th demanded word of the
source is due.  A document's place in the source's (hashed) order says which
demanded words it serves, hence its positions; the mix is range-sorted by them.

Prefix sums within a source go over hash buckets, so no source needs one task:
bucket totals are added up per source, and rows only within their bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket on average; a bucket is sorted by one task.
ROWS_PER_BUCKET = 2_000
WORD = r"[^\x20\x09-\x0D]+"

Knots = list[tuple[float, float]]

#: The operator's own columns; columns of these names are replaced.
OWN = ("_name", "_source_size", "_target", "_words", "_buckets", "_pieces", "_bucket", "_n", "_null", "_b", "_before", "_from")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(n: int, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> list[float]:
    return [cycle[i % len(cycle)] for i in range(n)]


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight; none above cap * size, the excess reshared by weight."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        if weight <= 0:
            break
        over = {i for i in free if left * weights[i] / weight >= cap * sizes[i]}
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = cap * sizes[i]
        free -= over
        left = float(total) - sum(targets[i] for i in range(len(sizes)) if i not in free)
    return targets


def ramp(weight: float, slope: float) -> Knots:
    """A schedule that rises (falls, below 0) linearly around a mean of weight."""
    return [(0.0, weight * (1 - slope)), (1.0, weight * (1 + slope))]


def default_schedule(weight: float) -> Knots:
    """Heavy sources early, light ones late: the query's curriculum."""
    return ramp(weight, -0.5 if weight >= 5 else 0.5)


def cumulative(knots: Knots) -> list[tuple[float, float, float, float]]:
    """Pieces (t, integral up to t, weight at t, slope) of a schedule, the whole integral being 1."""
    if any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots) or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("knots must run from t = 0 to t = 1 with weights of 0 or more")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0:
        raise ValueError("a schedule needs a positive integral")
    out, done = [], 0.0
    for (t, w), (u, v) in zip(knots, knots[1:]):
        out.append((t, done, w / area, (v - w) / area / (u - t)))
        done += (u - t) * (w + v) / 2 / area
    return out


def due(share: Column, pieces: Column) -> Column:
    """Time at which the share (0 to 1) of a source's demand has come up."""
    at = F.filter(pieces, lambda p: p["area"] <= share)
    p = F.element_at(at, -1)
    rest = share - p["area"]
    root = F.sqrt(F.greatest(F.lit(0.0), p["weight"] * p["weight"] + 2 * p["slope"] * rest))
    step = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (p["weight"] + root))
    return F.least(F.lit(1.0), p["t"] + step)


def sized(docs: DataFrame, *, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _size (words of the whole text) and _hash (the order of taking)."""
    return docs.withColumns({"_size": word_count(F.col(text_col)), "_hash": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))})


def mix(
    docs: DataFrame,
    *,
    is_sized: bool = False,
    weights: Callable[[int], list[float]] = cyclic_weights,
    schedule: Callable[[float], Knots] = default_schedule,
    cap: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with _size, _source_size, _target, _taken and _positions.

    Sources stand in order of code points, null last (null is a source of its
    own); ``weights(n)`` gives their weights.  A source's target is its share of
    all words by weight, at most ``cap`` times its own words.  Documents are
    taken in a hashed order, round after round, until the target is met to the
    word; the last is cut.  ``_positions`` holds the due time of each copy that
    begins within the target, empty for a document that isn't taken.

    Null and empty texts have 0 words and take none; rows that repeat count each
    (which of two equal rows comes first doesn't matter); an empty table gives
    an empty one.  Columns of the operator's own names (each begins with an
    underscore) are replaced.  ``is_sized``: docs come from ``sized`` already.
    The driver gets one row for each source, as a mix is stated by source.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OWN)
    own = docs if is_sized else sized(docs, seed=seed, id_col=id_col, text_col=text_col)
    totals = own.groupBy(F.col(source_col).alias("_source")).agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    totals.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    sizes = [r["size"] for r in totals]
    ws = weights(len(sizes))
    targets = capped_targets(sizes, ws, sum(sizes), cap)
    rows = [
        (r["_source"], r["size"], t, round(t), max(1, -(-r["rows"] // ROWS_PER_BUCKET)), [tuple(map(float, p)) for p in cumulative(schedule(w))])
        for r, t, w in zip(totals, targets, ws)
    ]
    schema = "_name string, _source_size long, _target double, _words long, _buckets int, _pieces array<struct<t: double, area: double, weight: double, slope: double>>"
    sources = spark.createDataFrame(rows, schema)
    own = own.join(F.broadcast(sources), F.col(source_col).eqNullSafe(F.col("_name")))  # one row for each source
    own = own.withColumn("_bucket", F.pmod("_hash", "_buckets").cast("int"))
    sums = own.groupBy("_name", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.coalesce("_name", F.lit("")).alias("_n"), F.col("_name").isNull().alias("_null"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    keyed = own.withColumns({"_n": F.coalesce("_name", F.lit("")), "_null": F.col("_name").isNull(), "_b": F.col("_bucket")})
    keyed = keyed.join(sums.hint("merge"), ["_n", "_null", "_b"])
    inside = F.sum("_size").over(Window.partitionBy("_n", "_null", "_b").orderBy("_hash", "_size", id_col).rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("_from", F.col("_before") + F.coalesce(inside, F.lit(0)))
    rounds = F.when(F.col("_source_size") > 0, F.floor(F.col("_words") / F.col("_source_size"))).otherwise(0).cast("long")
    part = F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_words") - rounds * F.col("_source_size") - F.col("_from")))
    starts = F.transform(F.sequence(F.lit(0), F.lit(int(cap))), lambda e: e * F.col("_source_size") + F.col("_from"))
    begun = F.filter(starts, lambda x: (x < F.col("_words")) & (F.col("_size") > 0))
    placed = placed.withColumn("_taken", (rounds * F.col("_size") + part).cast("long"))
    placed = placed.withColumn("_positions", F.transform(begun, lambda x: due(x / F.col("_words"), F.col("_pieces"))))
    # a copy of which most words lie beyond the target is cut to less than half
    placed = placed.withColumn("_whole", F.size(F.filter(begun, lambda x: x + F.col("_size") / 2 <= F.col("_words"))))
    return placed.drop("_hash", *(c for c in OWN if c not in ("_source_size", "_target")))


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each whole copy that the mix takes, range-sorted by position, ties by what the columns hold."""
    copies = F.slice("_positions", 1, F.greatest(F.col("_whole"), F.lit(0)))
    rows = mixed.select(*columns, F.explode(copies).alias("_position"))
    rows = rows.withColumn("_tie", F.xxhash64(*columns))
    return rows.repartitionByRange("_position", "_tie").sortWithinPartitions("_position", "_tie").drop("_position", "_tie")
