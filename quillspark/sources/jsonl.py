"""Sources and sinks of JSON lines, read and written by Spark."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All records; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line): physical lines in order, blank ones included; files in order of their names.

    Lines are numbered within the piece of a file that a task read and moved on by
    the counts of those before; the driver gets one number for each piece.
    """
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    own = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # a task reads a piece from its first line to its last, so ids within it have no gaps
    counts = own.groupBy("file_path", "file_block_start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("file_path", "file_block_start").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["file_path"], r["file_block_start"], r["first"], total))
        total += r["n"]
    pieces = spark.createDataFrame(starts, "file_path string, file_block_start long, first long, start long")
    return own.join(F.broadcast(pieces), ["file_path", "file_block_start"]).select((F.col("start") + F.col("id") - F.col("first")).alias("ord"), "line")


def read_jsonl_head(spark: SparkSession, path: str, schema: str, limit: int | None, *, count_blank: bool = True) -> DataFrame:
    """Records of the first ``limit`` lines: physical ones, or (count_blank=False) those that aren't blank. None: all."""
    lines = numbered_lines(spark, path)
    if not count_blank:
        lines = lines.filter(F.trim("line") != "")
        if limit is not None:
            lines = lines.orderBy("ord").limit(limit)
    elif limit is not None:
        lines = lines.filter(F.col("ord") < limit)
    return lines.filter(F.trim("line") != "").select("ord", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("_r")).select("ord", "_r.*")


def read_done_keys(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """Keys of a file that a run left, which may end in a torn line."""
    rows = spark.read.schema(f"{key} string").json(path, mode="DROPMALFORMED")
    return rows.filter(F.col(key).isNotNull() & (F.col(key) != "")).distinct()


def string_or_lines(variant: Column) -> Column:
    """Lines of a VARIANT that is a string or an array of strings; a string is one line."""
    is_array = F.startswith(F.schema_of_variant(variant), F.lit("ARRAY"))
    return F.when(is_array, F.try_variant_get(variant, "$", "array<string>")).otherwise(F.array(F.try_variant_get(variant, "$", "string")))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """UTF-8 JSON lines; mode "append" adds to what an earlier run wrote."""
    df.write.json(path, mode=mode, ignoreNullFields=False)


def write_checkpoints(df: DataFrame, path: str, every: int, order: str = "order") -> list[str]:
    """Write df as JSON lines in order, and beside it, for each ``every`` rows, what there is up to then.

    Returns the paths written; those of the checkpoints come first, so a run that
    ends early leaves them.  ``order`` numbers the rows from 0.
    """
    total = df.count()
    marks = [(n, sibling(path, f"_checkpoint_{n}")) for n in range(every, total + 1, every)]
    for n, name in marks:
        write_jsonl(df.filter(F.col(order) < n).orderBy(order), name, "overwrite")
    write_jsonl(df.orderBy(order), path, "overwrite")
    return [*(name for _, name in marks), path]


def write_summary(df: DataFrame, path: str) -> None:
    df.select("group", "metric", "value").write.csv(path, header=True, mode="overwrite")


def sibling(path: str, suffix: str) -> str:
    """The path with ``suffix`` after its stem."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}{suffix}{p.suffix}"))


def read_split(spark: SparkSession, folder: str, split: str, schema: str) -> DataFrame:
    """A split of a data set that lies in a folder; "val" is also called "validation"."""
    return read_jsonl(spark, f"{folder.rstrip('/')}/{ {'val': 'validation'}.get(split, split) }.jsonl", schema)
