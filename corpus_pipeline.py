"""The corpus pipeline: five stages, each over all documents that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table, write_shared
from quillspark.llm.decontamination import contamination
from quillspark.llm.jaccard_join import near_duplicates
from quillspark.llm.mixing import mix, training_order
from quillspark.llm.registry import fit_toxicity
from quillspark.llm.sharding import reshard
from quillspark.llm.toxicity import score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_key(docs: DataFrame) -> DataFrame:
    """COLUMNS and _key, which only equal rows share and which sorts as doc_id does, null ids last."""
    flipped = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    by_id = F.coalesce(F.concat(F.lit("0"), F.lpad(F.hex(flipped), 16, "0")), F.lit("1"))
    return docs.select(*COLUMNS, F.concat(by_id, F.md5(F.to_json(F.struct(*COLUMNS)))).alias("_key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below 0.7.

    Null and empty texts count as clean; repeated rows stay or go together;
    columns beyond those of documents go; an empty table stays empty, and without
    labels of both classes all documents stay.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    # score() carries the columns along, so no join brings the texts together again
    return score(docs, model, keep=tuple(COLUMNS)).filter("_score < 0.7").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by 85 % of common four-word runs: that of the least id.

    Rows are told apart by all their columns, not by id: a unique text stays
    whatever other rows have its id, or none.  Of rows that are equal in every
    column one is kept.
    """
    own = with_key(docs)
    groups = near_duplicates(own, size=4, percent=85, id_col="_key")
    kept = groups.filter(F.col("_key") == F.col("component_id")).select("_key").distinct()
    return own.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; clean rows of a dropped one's id stay.

    One item is enough: a document that holds a passage of a single item leaks it.
    Null and empty texts hold none; of no row that stays anything changes, repeated
    rows stay or go together; an empty table stays empty.
    """
    own = with_key(docs)
    found = contamination(own, table(spark, sf_dir, "benchmark"), id_col="_key")
    bad = found.filter(F.size("items") > 0).select("_key").distinct()
    return own.join(bad, "_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy that the mix takes, in order of training.

    Documents without words (null, empty) are taken by no mix; a null source is a
    source of its own, the last; each of several equal rows is a document; an empty
    table stays empty.
    """
    return training_order(mix(docs), COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot: 7 hash shards resharded into 8 of equal bytes.

    Null and empty texts weigh one byte; equal rows get a slot each; an empty table
    stays empty.
    """
    placed, _ = reshard(docs, 8, n_old=7)
    return placed.select(*COLUMNS, "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the trained model of the first stage; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = write_shared(docs, f"stage-{name}")
    return docs
