"""Line deduplication by overlapping three-line windows.

Every run of three consecutive lines is hashed; windows that occur more than
once anywhere are found by one aggregation.  The first occurrence (least id,
then position) stays, and of every later one all lines that it covers go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _k1, _k2, _pos, _len, _h1, _h2): a row for each window of lines that isn't blank."""
    lines = F.split(F.col(text_col), "\n", -1)
    own = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), *keys(id_col, text_col), lines.alias("_lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_lines") - size))
    cut = F.transform(starts, lambda i: F.struct(i.alias("_pos"), F.slice("_lines", i + 1, size).alias("_w")))
    rows = own.select("_id", "_k1", "_k2", F.explode(cut).alias("_c")).select("_id", "_k1", "_k2", "_c.*")
    rows = rows.filter(F.exists("_w", lambda line: line.rlike(r"\S")))
    return rows.select("_id", "_k1", "_k2", "_pos", F.size("_w").alias("_len"), F.xxhash64(F.lit(1), "_w").alias("_h1"), F.xxhash64("_w", F.lit(2)).alias("_h2"))


def keys(id_col: str, text_col: str) -> list:
    """A 128-bit key of id and text: rows equal in both are one document."""
    return [F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("_k1"), F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col)).alias("_k2")]


def dedup_lines(docs: DataFrame, *, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without repeated passages, and n_lines and n_removed, a row for each row.

    Lines are what newlines separate.  A text of fewer than ``size`` lines is one
    window; windows of white space alone never repeat.  Null stays null (0
    lines), an empty text is one line; rows equal in id and text are one document
    and end alike; a text of which all lines go becomes empty; an empty table
    gives an empty one.  Columns n_lines, n_removed and those of the operator's own
    names (each begins with an underscore) are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "_k1", "_k2", "_gone")
    rows = windows(docs, size, id_col, text_col).distinct()
    place = F.struct("_id", "_k1", "_k2", "_pos")
    repeated = rows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).filter("_n > 1")
    later = rows.join(repeated, ["_h1", "_h2"]).filter(~place.eqNullSafe(F.col("_first")))
    covered = later.select("_k1", "_k2", F.explode(F.sequence("_pos", F.col("_pos") + F.col("_len") - 1)).alias("_line"))
    gone = covered.groupBy("_k1", "_k2").agg(F.collect_set("_line").alias("_gone"))
    out = docs.select("*", *keys(id_col, text_col)).join(gone, ["_k1", "_k2"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(lines, i))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    out = out.withColumns({"n_lines": n_lines.cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})
    out = out.withColumn("n_removed", F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.col("n_removed")).cast("long"))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.withColumn(text_col, text).select(*docs.columns, "n_lines", "n_removed")
