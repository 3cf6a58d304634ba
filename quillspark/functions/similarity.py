"""Similarities of texts, sets and slots; null stands for "nothing to compare"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import let, normalize_name, words_of

#: Slots in the order of reports.
SLOTS = ["event_type", "event_target", "action_types", "loop_types", "loop_counts", "condition_types", "numeric_values", "variable_names", "costume_names", "backdrop_names", "broadcast_names"]
SCALARS = SLOTS[:2]
GUIDED = SLOTS[7:]


def jaccard(a: Column, b: Column) -> Column:
    return let(F.size(F.array_union(a, b)), lambda union: F.when(union > 0, F.size(F.array_intersect(a, b)) / union))


def scalar_similarity(a: Column, b: Column) -> Column:
    x, y = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    return F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y).cast("double"))


def guided_similarity(program: Column, spoken: Column, text: Column) -> Column:
    """Share of the program's names that the instruction names or mentions; names only spoken score 0."""
    return let(normalize_name(text), lambda mentioned: _guided(program, spoken, mentioned))


def _guided(program: Column, spoken: Column, mentioned: Column) -> Column:
    hit = F.filter(program, lambda n: let(normalize_name(n), lambda name: F.array_contains(spoken, name) | F.contains(mentioned, name)))
    return F.when(F.size(program) > 0, F.size(hit) / F.size(program)).when(F.size(spoken) > 0, F.lit(0.0))


def slot_scores(program: Column, spoken: Column, text: Column) -> Column:
    """Struct of the 11 slots' scores of a program against an instruction."""
    def one(slot: str, x: Column) -> Column:
        p, s = x["p"][slot], x["s"][slot]
        if slot in SCALARS:
            return scalar_similarity(p, s)
        if slot in GUIDED:
            return _guided(p, s, x["mentioned"])
        return jaccard(p, s)
    read = F.struct(program.alias("p"), spoken.alias("s"), normalize_name(text).alias("mentioned"))
    return let(read, lambda x: F.struct(*[one(s, x).alias(s) for s in SLOTS]))


def program_scores(a: Column, b: Column) -> Column:
    """Struct of 9 slots' scores of two programs: plain similarities, without loops."""
    pick = [s for s in SLOTS if not s.startswith("loop_")]
    read = F.struct(a.alias("a"), b.alias("b"))
    return let(read, lambda x: F.struct(*[(scalar_similarity if s in SCALARS else jaccard)(x["a"][s], x["b"][s]).alias(s) for s in pick]))


def compared(scores: Column, slots: list[str] = SLOTS) -> Column:
    return F.array_compact(F.array(*[scores[s] for s in slots]))


def mean_score(scores: Column, empty: float, slots: list[str] = SLOTS) -> Column:
    """Mean of the scores that aren't null; ``empty`` if all are."""
    mean = lambda own: F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)).otherwise(F.lit(empty))
    return let(compared(scores, slots), mean)


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two texts' words as multisets; 1 if both are empty, 0 if one is."""
    return let(F.struct(words_of(pred).alias("p"), words_of(gold).alias("g")), lambda x: _multiset_f1(x["p"], x["g"]))


def _multiset_f1(p: Column, g: Column) -> Column:
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    both = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda a, w: a + F.least(count(p, w), count(g, w)))
    # 2 P R / (P + R) of P = both / |p| and R = both / |g|
    f1 = let(both, lambda n: F.when(n > 0, 2 * (n / F.size(p)) * (n / F.size(g)) / (n / F.size(p) + n / F.size(g))).otherwise(0.0))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f1)
