"""Programs, instructions and text pairs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(value, cases: dict):
    out = F.lit(None).cast("string")
    for k, v in cases.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program_id, nl, lines): a program and an instruction for each order that has lines."""
    li = table(spark, sf_dir, "lineitem")
    q, flag = F.col("l_quantity").cast("bigint").cast("string"), F.concat_ws(",", "l_returnflag", "l_linestatus")
    part = F.col("l_partkey").cast("string")
    block = _case(flag, {"A,F": F.concat(F.lit("move ("), q, F.lit(") steps")), "A,O": F.concat(F.lit("repeat ("), q, F.lit(")")), "N,F": F.concat(F.lit("wait ("), q, F.lit(") seconds")), "N,O": F.concat(F.lit("say [p"), part, F.lit("]")), "R,F": F.concat(F.lit("change [score v] by ("), q, F.lit(")")), "R,O": F.lit("end")})
    said = _case(flag, {"A,F": F.concat(F.lit("move "), q, F.lit(" steps")), "A,O": F.concat(F.lit("repeat "), q, F.lit(" times")), "N,F": F.concat(F.lit("wait "), q, F.lit(" seconds")), "N,O": F.concat(F.lit("say p"), part), "R,F": F.concat(F.lit("change score by "), q)})
    said = F.when(F.col("l_partkey") % 4 != 0, said)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", block.alias("block"), said.alias("said"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 5).cast("string").alias("m"))
    both = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    hat = _case(F.col("o_orderpriority"), {"1-URGENT": F.lit("when @greenFlag clicked"), "2-HIGH": F.lit("when this sprite clicked"), "3-MEDIUM": F.lit("when (space v) key pressed"), "4-NOT SPECIFIED": F.concat(F.lit("when backdrop switches to [b"), "m", F.lit(" v]")), "5-LOW": F.concat(F.lit("when I receive [msg"), "m", F.lit(" v]"))})
    trigger = _case(F.col("o_orderpriority"), {"1-URGENT": F.lit("when the green flag is clicked"), "2-HIGH": F.lit("when you click on this sprite"), "3-MEDIUM": F.lit("when the space key is pressed"), "4-NOT SPECIFIED": F.concat(F.lit("when the backdrop changes to b"), "m"), "5-LOW": F.concat(F.lit("when i receive msg"), "m")})
    lines = F.concat(F.array(hat), F.transform("rows", lambda r: r["block"]))
    nl = F.concat(F.concat_ws(", ", F.array(trigger), F.transform("rows", lambda r: r["said"])), F.lit("."))
    return both.select(F.col("l_orderkey").alias("program_id"), nl.alias("nl"), lines.alias("lines"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, pred, gold): each user turn and the next turn, where that is an assistant's."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"r2": F.lead("role").over(after), "t2": F.lead("text").over(after)})
    return rows.filter("role = 'user' AND r2 = 'assistant'").select("conv_id", "turn", F.col("t2").alias("pred"), F.col("text").alias("gold"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, candidates): the texts of a conversation's assistant turns with made-up scores."""
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    score = F.struct("turn", F.col("text"), (-((F.col("conv_id") * 7 + F.col("turn") * 13) % 11) / 4.0).alias("logprob_mean"), (((F.col("conv_id") * 5 + F.col("turn") * 3) % 7) / 7.0).alias("sac_score"), (((F.col("conv_id") + F.col("turn")) % 3) == 0).alias("parse_ok"))
    return own.groupBy("conv_id").agg(F.array_sort(F.collect_list(score)).alias("candidates"))
