"""How much work built columns hold: values that several rules use are written, and read, once."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import slots, text
from quillspark.functions.operands import operand_tree
from quillspark.operators import report, retrieval


def patterns_in(spark, build, kind="string") -> int:
    df = spark.createDataFrame([], f"x {kind}").select(build(F.col("x")))
    return len(re.findall(r"regexp_\w+\(|RLIKE|split\(", df._jdf.queryExecution().analyzed().toString()))


def test_slots_read_each_value_once(spark):
    assert patterns_in(spark, slots.spoken_slots) < 400
    assert patterns_in(spark, slots.program_slots, "array<string>") < 80


def test_alignments_read_a_program_once(spark):
    spoken, program = patterns_in(spark, slots.spoken_slots), patterns_in(spark, slots.program_slots, "array<string>")
    assert patterns_in(spark, lambda c: report.program_alignment(c, c)) < 2 * program + 20
    df = spark.createDataFrame([], "prediction string, gold string, nl string")
    plan = report.compare(df, parser=False)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_\w+\(|RLIKE|split\(", plan)) < spoken + 2 * program + 60


def test_lines_are_told_apart_whatever_they_hold(spark):
    rows = [(["when flag clicked", "a﷐show"],), (["x\nhide"],), (["show", None],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "l array<string>").select(slots.program_slots(F.col("l"))).collect()]
    assert [g["action_types"] for g in got] == [[], [], ["show"], []]


@pytest.mark.parametrize("pattern, want", [
    (r"\bset ([a-z]+) to\b", ["set ", " to"]), (r"go s?now", ["go ", "now"]), (r"a b|c d", []), (r"(?i)move up", []), (r"play sound \(([^)]+?) v\)", ["play sound (", " v)"]),
    (r"(?:move|go) up\s+\d{2}steps?", ["step", " up"]), (r"\by\s*is", ["is"]),
])
def test_required(pattern, want):
    assert text.required(pattern) == want


def test_spaces_are_those_of_the_pattern():
    assert re.fullmatch(text.SPACE + "+", text.SPACES) and not re.search(text.SPACE, "".join(c for c in map(chr, range(0x3100)) if c not in text.SPACES))


@pytest.mark.parametrize("terms, tokens", [(200_000, 20_000), (0, 1)])
def test_retrieval_places_documents_once(spark, monkeypatch, terms, tokens):
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", terms)
    monkeypatch.setattr(retrieval, "COMMON_TOKENS", tokens)
    texts = ["move cat cat", "turn dog", "", None, "cat cat move", "dog dog cat x1", "x2 x3"]
    asked = ["cat dog", "move move turn", "xyz", "x3", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    ask = spark.createDataFrame(list(enumerate(asked)), "q int, t string")
    top = retrieval.top_k(ask, docs, 4, query_id="q", query_text="t", doc_id="i", doc_text="t")
    if terms:
        assert not re.search(r"hashpartitioning\((query#\d+L?, doc|doc#\d+L?, query)", top._jdf.queryExecution().executedPlan().toString())
    df = Counter(w for t in texts for w in set((t or "").split()))

    def vector(t):
        own = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in Counter((t or "").split()).items() if w in df}
        norm = math.sqrt(sum(x * x for x in own.values())) or 1.0
        return {w: x / norm for w, x in own.items()}

    want = []
    for q, a in enumerate(asked):
        v = vector(a)
        scored = [(round(sum(x * vector(t).get(w, 0.0) for w, x in v.items()), 12), i) for i, t in enumerate(texts)]
        order = sorted(scored, reverse=True) if v else sorted(scored, key=lambda x: x[1])
        want += [(q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(order[:4])]
    assert sorted((r["query"], r["rank"], r["doc"], round(r["score"], 9)) for r in top.collect()) == want


def test_operands_look_for_a_variable_once(spark):
    df = spark.createDataFrame([], "x string").select(operand_tree(F.col("x"), "any", F.array(F.lit("Score"))))
    assert df._jdf.queryExecution().analyzed().toString().count("filter(") <= 2
