import pytest
from pyspark.sql import functions as F

from quillspark.functions import cleanup, grammar, similarity, slots, text
from quillspark.operators.selection import argmax, select_candidates, sequence_logprobs


def values(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(build(F.col("x"))).collect()]


@pytest.mark.parametrize("build, cases", [
    (text.normalize_name, {"My Variable v": "myariable", "  \"Big  Cat\" ": "big cat", "score v": "score", "": ""}),
    (text.normalize_number, {"10.50": "10.5", "3.0": "3", "-0": "0", "abc": "abc", "0.3333333333": "0.333333", "1e400": "1e400", "-2.50": "-2.5"}),
    (lambda c: F.array_join(F.array_sort(text.number_words(c)), ","), {"two hundred and five": "200,5", "a dog moves twenty five": "1,25", "thousand": "", "zero": "", "three thousand two hundred": "3200", "a five": "6", "none here": ""}),
    (lambda c: F.array_join(F.array_sort(text.digit_numbers(c)), ","), {"move 10 then -2.50 and 3.0": "-2.5,10,3", "x": ""}),
    (lambda c: F.array_join(F.array_sort(text.repeat_counts(c)), ","), {"repeat ten times": "10", "do this 3 times, then repeat 4 times": "3,4", "move 5 steps": ""}),
    (lambda c: F.array_join(F.array_sort(text.directional_numbers(c)), ","), {"move backward 10 steps": "-10", "go left by 5": "-5", "move up 3 steps": "3"}),
    (text.strip_special_tokens, {"a<|eot_id|>b<|user|>": "a", "none": "none"}),
    (text.truncate_chat, {" say [hi] Human: x": "say [hi]", "x<|im_end|>": "x"}),
    (text.normalize_text, {" a  b \n\n\tc": "a b\nc", "x  y z": "x y\nz"}),
    (text.comparable, {"go to x: (0)，y": "go to x  (0) y", "é!": "!"}),
    (lambda c: text.mask_identifiers(c, F.array(F.lit("x"), F.lit("six cats"))), {"six cats move x": "  move  "}),
    (lambda c: text.is_variable_name(c).cast("string"), {"score": "true", "it is": "false", "wait time": "false", "": "false"}),
])
def test_text(spark, build, cases):
    assert dict(zip(cases, values(spark, list(cases), build))) == cases


def test_prompt(spark):
    df = spark.createDataFrame([("abc def", "abc"), ("x<|assistant|> y <|assistant|>z", "q"), (" plain ", "q")], "f string, p string")
    assert [r[0] for r in df.select(text.strip_prompt(F.col("f"), F.col("p"))).collect()] == ["def", "y <|assistant|>z", "plain"]


def test_similarity(spark):
    pairs = [("a b", "a c", 0.5), ("", "", 1.0), ("", "x", 0.0), ("a a b", "a a a", 2 / 3), ("x", "y", 0.0)]
    df = spark.createDataFrame(pairs, "p string, g string, f double")
    for r in df.withColumn("got", similarity.token_f1(F.col("p"), F.col("g"))).collect():
        assert r["got"] == pytest.approx(r["f"])
    sets = spark.createDataFrame([([], [], None), (["a", "b"], ["b", "c"], 1 / 3), (["a"], ["a"], 1.0)], "a array<string>, b array<string>, want double")
    assert all(r["got"] == r["want"] or r["got"] == pytest.approx(r["want"]) for r in sets.withColumn("got", similarity.jaccard(F.col("a"), F.col("b"))).collect())


CASES = [
    ("When the green flag is clicked, move 10 steps.", ["when @greenFlag clicked", "move (10) steps"], 1.0, []),
    ("When the green flag is clicked, wait a second.", ["when @greenFlag clicked", "wait (2) seconds"], 2 / 3, ["numeric_values"]),
    ("When the space key is pressed, move 5 steps.", ["when [space v] key pressed", "move (5) steps"], 1.0, []),
    ("When I receive go, hide.", ["when I receive [go v]", "hide"], None, None),
    ("", [], 1.0, []),
]


def test_alignment(spark):
    from quillspark.operators.report import align, summarize, worst

    df = spark.createDataFrame([(str(i), nl, lines) for i, (nl, lines, *_) in enumerate(CASES)], "key string, nl string, pseudocode array<string>")
    aligned = align(df).cache()
    for r in aligned.collect():
        _, _, score, wrong = CASES[int(r["key"])]
        if score is not None:
            assert r["alignment_score"] == pytest.approx(score) and r["mismatch_slots"] == wrong
        assert 0 <= r["alignment_score"] <= 1
    rows = {(r["group"], r["metric"]): r["value"] for r in summarize(aligned, "key").collect() if r["is_overall"]}
    assert rows["overall", "num_examples"] == 5
    assert worst(aligned, 1).count() == 1


def test_program_slots(spark):
    lines = ["when backdrop switches to [Night v]", "repeat (3)", "set [my score v] to [0]", "change x by (-5)", "if <touching (edge v)?> then", "switch costume to [cat1]", "broadcast (go)", "play sound (pop v)", "end"]
    r = spark.createDataFrame([(lines,)], "l array<string>").select(slots.program_slots(F.col("l")).alias("s")).first()["s"]
    assert (r["event_type"], r["event_target"]) == ("backdrop_switch", "night")
    assert r["action_types"] == ["broadcast", "change_variable", "move", "play_sound", "set_variable", "switch_costume"]
    assert (r["loop_types"], r["loop_counts"], r["condition_types"]) == (["repeat"], ["3"], ["edge", "touching"])
    assert (r["variable_names"], r["costume_names"], r["backdrop_names"], r["broadcast_names"]) == (["my score", "x"], ["cat1"], ["night"], ["go"])
    assert r["numeric_values"] == ["-5", "0", "3"]


@pytest.mark.parametrize("program, want", [
    ("when @greenFlag clicked\nforever\nmove (10) steps", True), ("when @greenFlag clicked\nend", False), ("when I receive [go v]\nhide", False),
    ("when @greenFlag clicked\nif on edge, bounce", False), ("", False), ("move (1) steps", False), ("when flag clicked", True),
    ("when flag clicked\nif <(1) = (2)> then\nhide\nelse\nshow\nend\nend", True), ("when flag clicked\nelse", False),
    ("when flag clicked\nwait until <x contains y>", False), ("when flag clicked\nwait until <not key (a v) presse>", False),
    ("when flag clicked\ngo to x: (0) y: (0)", True), ("when flag clicked\nnext costume", False), ("when (space v) key pressed\nturn left (15) degrees", True),
    ("when flag clicked\nforever\nend\nend", False),
])
def test_acceptance(spark, program, want):
    df = spark.createDataFrame([(program,)], "code string")
    assert grammar.accepted(df, "code").first()["parse_ok"] is want


def test_blocks(spark):
    df = spark.createDataFrame([(1, "when flag clicked\nrepeat (2)\nhide\nforever\nshow\nend\nend\nmove (1) steps")], "id int, code string")
    got = {r["seq"]: (r["parent_seq"], r["next_seq"]) for r in grammar.program_blocks(df, "id", "code").collect()}
    assert got == {0: (None, None), 1: (0, 7), 2: (1, 3), 3: (1, None), 4: (3, None), 7: (0, None)}


@pytest.mark.parametrize("given, want", [
    ("if touching wall?", "if <touching (wall v)?> then> then\nend"),
    ("forever\nend", ""), ("end\nhide", "hide"), ("repeat (2)\nhide", "repeat (2)\nhide\nend"),
    ("forever\nforever\nhide\nend\nend", "forever\nhide\nend"), ("when green flag clicked move (1) steps", "when @greenFlag clicked\nmove (1) steps"),
    ("wait until touching edge", "wait until <touching edge>"), ("\n".join("abcde" * 2), "a\nb\nc\nd\ne"), (None, ""), ("say [x]<|eot_id|>junk", "say [x]"),
    ("if on edge, bounce\nhide", "if <on edge, bounce> then\nhide\nend"),
])
def test_postprocess(spark, given, want):
    assert values(spark, [given], cleanup.postprocess) == [want]


def test_selection(spark):
    nan = float("nan")
    rows = [([1.0, 3.0, 3.0], 1), ([nan, 1.0], 0), ([1.0, nan, 2.0], 2), ([2.0], 0), ([], None)]
    df = spark.createDataFrame(rows, "v array<double>, want int")
    assert [r["got"] for r in df.withColumn("got", argmax(F.col("v"), lambda x: x)).collect()] == [w for _, w in rows]
    c = "candidates array<struct<text: string, logprob_mean: double, sac_score: double, parse_ok: boolean>>"
    df = spark.createDataFrame([([("a", -1.0, 0.2, False), ("b", -2.0, 0.1, True), ("c", -3.0, 0.9, None)],), ([("a", -1.0, 0.2, False), ("b", -0.5, 0.1, None)],)], c)
    got = select_candidates(df).collect()
    assert [r["best_parse_likelihood_idx"] for r in got] == [1, 1] and [r["best_reranked_idx"] for r in got] == [2, 0] and [r["any_parse_ok"] for r in got] == [True, False]
    logs = spark.createDataFrame([([-1.0, -2.0, float("-inf")],), ([],)], "t array<double>")
    assert [tuple(r) for r in logs.select(*sequence_logprobs(F.col("t"))).collect()] == [(-3.0, -1.5), (0.0, 0.0)]
