"""Prompts, request bodies and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip


def chat_prompt(nl: Column, system: str) -> Column:
    return F.concat(F.lit(f"<|system|>\n{system}\n<|user|>\n"), strip(nl), F.lit("\n<|assistant|>\n"))


def few_shot_prompt(nl: Column, examples: Column, task: str, syntax: str, ask: str) -> Column:
    """Task and syntax, numbered examples (structs of nl and pseudocode), and the query."""
    shown = F.transform(examples, lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\nNatural Language: "), e["nl"], F.lit("\nPseudocode:\n"), e["pseudocode"], F.lit("\n\n")))
    return F.concat(F.lit(f"{task}\n\n{syntax}\n\nHere are some examples:\n\n"), F.array_join(shown, ""), F.lit(f"{ask}\n\nNatural Language: "), nl, F.lit("\nPseudocode:\n"))


def reasoning_effort(model: Column, effort: Column) -> Column:
    """Null for none or empty; "auto" means medium for models of the gpt-5 family, else none."""
    auto = F.when(F.startswith(model, F.lit("gpt-5")), "medium")
    return F.when(effort.isNull() | effort.isin("", "none"), F.lit(None)).when(effort == "auto", auto).otherwise(effort)


def chat_body(model: Column, prompt: Column, *, max_tokens: int = 1500, effort: Column | None = None, temperature: Column | None = None) -> Column:
    """JSON request body; temperature and reasoning_effort are left out where null."""
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.to_json(F.struct(
        model.alias("model"), message.alias("messages"), F.lit(max_tokens).alias("max_completion_tokens"),
        (F.lit(None).cast("double") if temperature is None else temperature).alias("temperature"),
        reasoning_effort(model, F.lit("auto") if effort is None else effort).alias("reasoning_effort"),
    ))


def training_rows(df: DataFrame, system: str, *, key: str = "key", nl: str = "nl", lines: str = "pseudocode") -> DataFrame:
    """key, nl, pseudocode, prompt, target, completion and text of each record."""
    target = F.array_join(F.col(lines), "\n")
    out = df.select(key, nl, lines).withColumns({"prompt": chat_prompt(F.col(nl), system), "target": target, "completion": target})
    return out.withColumn("text", F.concat("prompt", "target"))


def requests(queries: DataFrame, found_examples: DataFrame, *, prefix: str, url: str, model: str, task: str, syntax: str, ask: str, effort: str = "auto") -> DataFrame:
    """Batch requests of queries (query, order, nl): custom_id, method, url and body."""
    rows = queries.join(found_examples, "query", "left").withColumn("examples", F.coalesce("examples", F.array().cast(found_examples.schema["examples"].dataType)))
    body = chat_body(F.lit(model), few_shot_prompt(F.col("nl"), F.col("examples"), task, syntax, ask), effort=F.lit(effort))
    return rows.select(F.concat(F.lit(prefix), F.col("order").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))
