import zlib
from collections import Counter

import corpus_pipeline
import pytest
from quillspark.llm.common import table
from quillspark.llm.registry import fit_toxicity
from quillspark.llm.toxicity import Scorer
import math

from test_decontamination import brute as brute_contamination
from test_jaccard_join import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return out


def test_each_stage_against_brute_force(spark, stages):
    start = table(spark, SF, "documents").collect()
    scorer = Scorer(fit_toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")))
    clean = [r for r in start if scorer.model.probability(math.log1p(scorer.evidence(*scorer.segments(r["text"]))[0])) < 0.7]
    assert sorted(r["doc_id"] for r in stages[0]) == sorted(r["doc_id"] for r in clean)
    groups = brute_groups([(r["doc_id"], r["text"]) for r in stages[0]])
    assert sorted(r["doc_id"] for r in stages[1]) == sorted({least for *_, least in groups})
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, _, _, found in brute_contamination([(r["doc_id"], r["text"]) for r in stages[1]], items) if found}
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(r["doc_id"] for r in stages[1] if r["doc_id"] not in bad)
    copies = Counter(r["doc_id"] for r in stages[3])
    assert copies and max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in stages[2]}
    assert sorted(r["doc_id"] for r in stages[4]) == sorted(r["doc_id"] for r in stages[3])
    for shard in range(8):
        slots = sorted(r["slot"] for r in stages[4] if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_columns(spark, stages):
    assert all(list(rows[0].asDict()) == corpus_pipeline.COLUMNS for rows in stages[:-1] if rows)
    texts = {r["doc_id"]: zlib.crc32(r["text"].encode()) for r in table(spark, SF, "documents").collect()}
    assert all(zlib.crc32(r["text"].encode()) == texts[r["doc_id"]] for r in stages[4])


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    one, two = " ".join(f"p{i}" for i in range(8)), " ".join(f"q{i}" for i in range(8))
    spark.createDataFrame([(1, one), (2, two)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    row = lambda i, t, lang="en": (i, t, lang, "s", None)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    big = 2**60 + 1
    rows = [row(1, text("a")), row(5, text("a")), row(5, text("b")), row(None, text("c")), row(None, text("d")), row(None, text("a")), row(-3, text("e")), row(2, text("e"))]
    rows += [row(7, text("f")), row(7, text("f")), row(8, text("g"), None), row(8, text("g"), "en"), row(None, None), row(None, ""), row(big, text("h")), row(big + 1, text("h"))]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(4), str(tmp_path)).collect()
    kept = [(1, text("a")), (5, text("b")), (None, text("c")), (None, text("d")), (-3, text("e")), (7, text("f")), (8, text("g")), (None, None), (None, ""), (big, text("h"))]
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter(kept)
    bad = f"{one} and {two}"
    rows = [row(1, bad), row(1, text("a")), row(None, bad), row(None, text("b")), row(None, None), row(2, text("c")), row(2, text("c"))]
    left = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, schema).repartition(4), str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter((r[0], r[1]) for r in rows if r[1] != bad)
