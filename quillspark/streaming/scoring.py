"""Alignment over a stream of records: a stateless map, so append mode is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.report import align

SCHEMA = "key string, nl string, pseudocode array<string>"


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the JSON-lines files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def score_stream(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append aligned records as JSON lines; a restart goes on where it stopped."""
    return align(records).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
