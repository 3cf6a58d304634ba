"""Alignment of programs with instructions, its summary by group, and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.cleanup import postprocess
from quillspark.functions.grammar import accepted
from quillspark.functions.similarity import SLOTS, compared, mean_score, program_scores, slot_scores, token_f1
from quillspark.functions.slots import program_slots, spoken_slots
from quillspark.functions.text import comparable, let, lines_of, squeeze

HIGH = 0.85
NO_LOOPS = [s for s in SLOTS if not s.startswith("loop_")]


def align(df: DataFrame, nl: str = "nl", lines: str = "pseudocode", empty: float = 1.0) -> DataFrame:
    """df with pseudo_slots, nl_slots, slot_scores, alignment_score and what follows from it."""
    df = df.withColumn("pseudo_slots", program_slots(F.col(lines))).withColumn("nl_slots", spoken_slots(F.col(nl)))
    df = df.withColumn("slot_scores", slot_scores(F.col("pseudo_slots"), F.col("nl_slots"), F.col(nl)))
    scores = F.col("slot_scores")
    named = F.array(*[F.struct(F.lit(s).alias("slot"), scores[s].alias("v")) for s in SLOTS])
    df = df.withColumn("alignment_score", mean_score(scores, empty))
    return df.withColumns({
        "exact_alignment": F.forall(compared(scores), lambda v: F.abs(v - 1) <= 1e-9),
        "high_confidence_alignment": F.col("alignment_score") >= HIGH,
        "mismatch_slots": F.transform(F.filter(named, lambda x: F.coalesce(x["v"] < 1, F.lit(False))), lambda x: x["slot"]),
    })


def summarize(aligned: DataFrame, group: str | None = None) -> DataFrame:
    """(group, is_overall, metric, value) over all rows and by group; slots never compared have no rows."""
    flat = aligned.select(F.col(group).cast("string").alias("g") if group else F.lit(None).cast("string").alias("g"), "alignment_score", F.col("exact_alignment").cast("double").alias("exact"), F.col("high_confidence_alignment").cast("double").alias("high"), "slot_scores.*")
    metrics = [F.count(F.lit(1)).cast("double").alias("num_examples"), F.avg("alignment_score").alias("avg_alignment_score"), F.avg("exact").alias("exact_alignment_rate"), F.avg("high").alias("high_confidence_rate")]
    for s in SLOTS:
        metrics += [F.avg(s).alias(f"{s}_avg_score"), F.when(F.count(s) > 0, F.count(s) / F.count(F.lit(1))).alias(f"{s}_coverage")]
    if group:
        sums = flat.groupingSets([[F.col("g")], []], F.col("g")).agg(F.grouping_id().alias("gid"), *metrics)
        sums = sums.withColumn("is_overall", F.col("gid") > 0).withColumn("group", F.when(F.col("is_overall"), "overall").otherwise(F.coalesce("g", F.lit("None")))).drop("g", "gid")
    else:
        sums = flat.agg(*metrics).withColumn("is_overall", F.lit(True)).withColumn("group", F.lit("overall"))
    names = [c for c in sums.columns if c not in ("group", "is_overall")]
    return sums.unpivot(["group", "is_overall"], names, "metric", "value").filter("value IS NOT NULL")


def worst(aligned: DataFrame, k: int = 250, key: str = "key") -> DataFrame:
    return aligned.orderBy("alignment_score", key).limit(k)


def _spoken_score(program: Column, spoken: Column, nl: Column) -> Column:
    return let(slot_scores(program, spoken, nl), lambda scores: mean_score(scores, 0.0))


def _program_score(a: Column, b: Column) -> Column:
    return let(program_scores(a, b), lambda scores: mean_score(scores, 0.0, NO_LOOPS))


def spoken_alignment(pred: Column, nl: Column) -> Column:
    """Alignment of a predicted text with an instruction; 0 if blank or if nothing can be compared."""
    score = lambda lines: _spoken_score(program_slots(lines), spoken_slots(nl), nl)
    return let(lines_of(F.coalesce(pred, F.lit(""))), lambda lines: F.when(F.size(lines) > 0, score(lines)).otherwise(0.0))


def program_alignment(pred: Column, gold: Column) -> Column:
    """Alignment of two programs' texts on 9 slots; 0 if either is blank."""
    texts = F.struct(lines_of(F.coalesce(pred, F.lit(""))).alias("a"), lines_of(F.coalesce(gold, F.lit(""))).alias("b"))
    score = lambda x: _program_score(program_slots(x["a"]), program_slots(x["b"]))
    return let(texts, lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), score(x)).otherwise(0.0))


def alignments(pred: Column, gold: Column, nl: Column) -> Column:
    """Struct of spoken_alignment() and program_alignment() as sac_nl and sac_pseudo; the prediction's slots are read once."""
    slots = lambda lines: F.when(F.size(lines) > 0, program_slots(lines))
    read = F.struct(slots(lines_of(F.coalesce(pred, F.lit("")))).alias("p"), slots(lines_of(F.coalesce(gold, F.lit("")))).alias("g"))
    return let(read, lambda x: F.struct(
        F.when(x["p"].isNotNull(), _spoken_score(x["p"], spoken_slots(nl), nl)).otherwise(0.0).alias("sac_nl"),
        F.when(x["p"].isNotNull() & x["g"].isNotNull(), _program_score(x["p"], x["g"])).otherwise(0.0).alias("sac_pseudo"),
    ))


def compare(df: DataFrame, pred: str = "prediction", gold: str = "gold", nl: str | None = "nl", clean: bool = False, parser: bool = True) -> DataFrame:
    """df with exact, line_exact, f1 and, where asked for, parse_ok, sac_nl and sac_pseudo, of each prediction."""
    text = F.coalesce(F.col(pred), F.lit(""))
    df = df.withColumn("_pred", postprocess(text) if clean else text).withColumn("_gold", F.coalesce(F.col(gold), F.lit("")))
    df = df.withColumns({"_p": comparable(F.col("_pred")), "_g": comparable(F.col("_gold"))})
    df = df.withColumns({
        "exact": F.col("_p") == F.col("_g"),
        "line_exact": F.transform(lines_of(F.col("_pred")), squeeze) == F.transform(lines_of(F.col("_gold")), squeeze),
        "f1": token_f1(F.col("_p"), F.col("_g")),
    })
    if parser:
        df = accepted(df, "_p")
    if nl:
        df = df.withColumn("_sac", alignments(F.col("_pred"), F.col("_gold"), F.col(nl))).withColumns({s: F.col("_sac")[s] for s in ("sac_nl", "sac_pseudo")})
    return df.drop("_pred", "_gold", "_p", "_g", "_sac")


def evaluate(compared_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over all rows (or by group) of what compare() gives; 0 where there is no row."""
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    have = compared_rows.columns
    metrics = [F.count(F.lit(1)).alias("examples"), mean(F.col("exact")).alias("exact_match"), mean(F.col("line_exact")).alias("line_exact_match"), mean(F.col("f1")).alias("token_f1")]
    if "parse_ok" in have:
        metrics.append(mean(F.col("parse_ok")).alias("vm_parse_rate"))
    for s in ("sac_nl", "sac_pseudo"):
        if s in have:
            metrics += [mean(F.col(s)).alias(f"{s}_avg"), mean(F.col(s) >= 1).alias(f"{s}_perfect_rate"), mean(F.col(s) >= HIGH).alias(f"{s}_high_rate")]
    return compared_rows.groupBy(*(by or [])).agg(*metrics)


def mismatches(compared_rows: DataFrame, limit: int = 5, order: str = "order") -> DataFrame:
    """The first rows, in order, whose prediction isn't exact."""
    return compared_rows.filter(~F.col("exact")).orderBy(order).limit(limit)


def mismatch_lines(shown: DataFrame, order: str = "order", nl: str = "nl", pred: str = "prediction", gold: str = "gold") -> DataFrame:
    """Mismatches as text lines, in order: a mark, then instruction, prediction and gold."""
    parts = [F.lit("--- mismatch ---"), *[F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c), F.lit(""))) for k, c in (("NL", nl), ("PRED", pred), ("GOLD", gold))]]
    return shown.select(order, F.posexplode(F.array(*parts)).alias("i", "line")).orderBy(order, "i").select("line")


def report_lines(metrics: DataFrame) -> DataFrame:
    """One row of metrics as text lines "name: value", rates with 4 decimals."""
    show = lambda c: F.concat(F.lit(f"{c}: "), F.col(c).cast("string") if c == "examples" else F.format_string("%.4f", F.col(c)))
    return metrics.select(F.explode(F.array(*[show(c) for c in metrics.columns])).alias("line"))
