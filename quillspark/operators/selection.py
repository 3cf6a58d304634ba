"""Choice of one of several candidates: folds over an array of structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence_logprobs(transitions: Column) -> tuple[Column, Column]:
    """(sum, mean) of log-probabilities; -inf is padding, the mean is over at least one token."""
    real = F.filter(transitions, lambda x: x != float("-inf"))
    total = F.aggregate(real, F.lit(0.0), lambda a, x: a + x)
    return total, total / F.greatest(F.size(real), F.lit(1))


def argmax(candidates: Column, key: Callable[[Column], Column], pool: Column | None = None) -> Column:
    """Index of the first candidate of the largest key among those of the pool (indexes; default: all).

    Only a greater key takes over, so the first of ties wins; NaN takes over from
    nothing, and nothing from a NaN that comes first.
    """
    pool = F.sequence(F.lit(0), F.size(candidates) - 1) if pool is None else pool
    value = lambda i: key(F.get(candidates, i)).cast("double")
    first = F.get(pool, F.lit(0))
    start = F.struct(first.alias("i"), value(first).alias("v"))

    def step(best: Column, i: Column) -> Column:
        v = value(i)
        better = ~F.isnan(v) & ~F.isnan(best["v"]) & (v > best["v"])
        return F.when(better, F.struct(i.alias("i"), v.alias("v"))).otherwise(best)

    return F.when(F.size(candidates) > 0, F.aggregate(pool, start, step, lambda s: s["i"]))


def parse_valid(candidates: Column) -> Column:
    """Indexes of the candidates that parse; of all, if none does."""
    every = F.sequence(F.lit(0), F.greatest(F.size(candidates) - 1, F.lit(0)))
    valid = F.filter(every, lambda i: F.coalesce(F.get(candidates, i)["parse_ok"], F.lit(False)))
    return F.when(F.size(valid) > 0, valid).otherwise(every)


RULES: dict[str, Callable[[Column], Column]] = {
    "first": lambda c: F.when(F.size(c) > 0, 0),
    "likelihood": lambda c: argmax(c, lambda x: x["logprob_mean"]),
    "reranked": lambda c: argmax(c, lambda x: x["sac_score"]),
    "parse_likelihood": lambda c: argmax(c, lambda x: x["logprob_mean"], parse_valid(c)),
    "parse_sac": lambda c: argmax(c, lambda x: x["sac_score"], parse_valid(c)),
}


def select_candidates(df: DataFrame, candidates: str = "candidates", with_parser: bool = True) -> DataFrame:
    """df with best_<rule>_idx and prediction_<rule> for each rule, num_candidates and any_parse_ok.

    A candidate is a struct (text, logprob_mean, sac_score, parse_ok).
    """
    c = F.col(candidates)
    rules = {k: v for k, v in RULES.items() if with_parser or not k.startswith("parse")}
    df = df.withColumns({f"best_{k}_idx": rule(c).cast("int") for k, rule in rules.items()} | {"num_candidates": F.size(c)})
    df = df.withColumns({f"prediction_{k}": F.get(c, F.col(f"best_{k}_idx"))["text"] for k in rules})
    return df.withColumn("any_parse_ok", F.exists(c, lambda x: F.coalesce(x["parse_ok"], F.lit(False)))) if with_parser else df


def by_rule(df: DataFrame, keep: list[str]) -> DataFrame:
    """Long form: a row (keep, rule, prediction) for each rule, so that one aggregation reports all."""
    rules = [k for k in RULES if f"prediction_{k}" in df.columns]
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"prediction_{k}").alias("prediction")) for k in rules])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")
