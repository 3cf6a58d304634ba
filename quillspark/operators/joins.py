"""Joins of records by key with the last-wins and resume semantics of line-oriented pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    fields = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_r")).select(key, "_r.*")


def merge_annotations(rows: DataFrame, annotations: DataFrame, fields: list[str], *, key: str = "key", order: str, present: dict[str, Column] | None = None) -> DataFrame:
    """Left join on key; fields of the last annotation overwrite those of rows.

    A field overwrites where it is present, even by null; ``present`` gives the
    condition by field (default: wherever the key has an annotation).
    """
    last = last_by(annotations, key, order)
    flags = {f: (present or {}).get(f, F.lit(True)) for f in fields}
    last = last.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_new_{f}") for f in fields], *[flags[f].alias(f"_has_{f}") for f in fields])
    out = rows.join(last, F.col(key) == F.col("_key"), "left")
    old = lambda f: F.col(f) if f in rows.columns else F.lit(None)
    out = out.withColumns({f: F.when(F.col(f"_has_{f}"), F.col(f"_new_{f}")).otherwise(old(f)) for f in fields})
    return out.drop("_key", *(f"_new_{f}" for f in fields), *(f"_has_{f}" for f in fields))


def resume(todo: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Rows of todo whose key isn't done; rows without a key (null or empty) are never skipped."""
    keys = done.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(key).distinct()
    return todo.join(keys, key, "left_anti")


def collect_responses(responses: DataFrame, metadata: DataFrame, *, order: str = "order", position: str | None = None) -> DataFrame:
    """Predictions of responses (custom_id, error, status_code, content and perhaps body) with their metadata, in order.

    Where an id has several rows of metadata, the last by ``position`` (default:
    order) counts.  A response without metadata is an error.  A failed response's
    prediction is "ERROR: " and the error, or else the status and the body, as
    JSON text.  Null error and empty error are none.
    """
    known = last_by(metadata, "custom_id", position or order).withColumn("_known", F.lit(True))
    known = known.drop(position) if position and position != order else known
    both = responses.join(known, "custom_id", "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no metadata for "), F.col("custom_id")))).otherwise(F.col("custom_id"))
    said = lambda c: F.coalesce(F.col(c).cast("string") if c in responses.columns else F.lit(None), F.lit("None"))
    text = F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.concat(F.lit("ERROR: "), F.col("error")))
    text = text.when(F.col("status_code").eqNullSafe(F.lit(200)), F.trim("content")).otherwise(F.concat(F.lit("ERROR: status "), said("status_code"), F.lit(" "), said("body")))
    out = both.withColumn("custom_id", checked).withColumn("prediction", text)
    return out.orderBy(order).drop(order, "_known", "error", "status_code", "body", "content")
