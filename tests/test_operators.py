import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import joins, prompting, retrieval
from quillspark.operators.report import compare, evaluate, mismatch_lines, mismatches, report_lines
from quillspark.sources import jsonl
from quillspark.streaming.scoring import read_stream, score_stream


def test_top_k(spark):
    docs = spark.createDataFrame([(0, "move cat"), (1, "turn dog")], "i int, t string")
    ask = spark.createDataFrame([(0, "cat"), (1, "xyz")], "q int, t string")
    got = {(r["query"], r["rank"]): (r["doc"], round(r["score"], 6)) for r in retrieval.top_k(ask, docs, 2, query_id="q", query_text="t", doc_id="i", doc_text="t").collect()}
    assert got == {(0, 1): (0, 0.707107), (0, 2): (1, 0.0), (1, 1): (0, 0.0), (1, 2): (1, 0.0)}


def test_joins(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")
    notes = spark.createDataFrame([("a", None, 0), ("a", 7, 1), ("c", 9, 2)], "key string, x int, n int")
    assert {r["key"]: r["x"] for r in joins.merge_annotations(rows, notes, ["x"], order="n").collect()} == {"a": 7, "b": 2}
    late = notes.filter("n != 1")
    assert {r["key"]: r["x"] for r in joins.merge_annotations(rows, late, ["x"], order="n").collect()} == {"a": None, "b": 2}
    todo = spark.createDataFrame([("a",), ("",), (None,), ("z",)], "key string")
    done = spark.createDataFrame([("a",), ("",), (None,)], "key string")
    assert sorted(str(r[0]) for r in joins.resume(todo, done).collect()) == ["", "None", "z"]
    meta = spark.createDataFrame([("x1", 1, "k1"), ("x0", 0, "k0")], "custom_id string, order int, key string")
    answers = spark.createDataFrame([("x0", None, 200, " ok "), ("x1", "bad", None, None)], "custom_id string, error string, status_code int, content string")
    assert [(r["key"], r["prediction"]) for r in joins.collect_responses(answers, meta).collect()] == [("k0", "ok"), ("k1", "ERROR: bad")]
    with pytest.raises(Exception, match="no metadata"):
        joins.collect_responses(answers, meta.limit(1)).collect()


def test_prompting(spark):
    df = spark.createDataFrame([("gpt-5-mini", "hi")], "m string, p string")
    body = json.loads(df.select(prompting.chat_body(F.col("m"), F.col("p"))).first()[0])
    assert body == {"model": "gpt-5-mini", "messages": [{"role": "user", "content": "hi"}], "max_completion_tokens": 1500, "reasoning_effort": "medium"}
    body = json.loads(df.select(prompting.chat_body(F.lit("other"), F.col("p"), temperature=F.lit(0.5))).first()[0])
    assert "reasoning_effort" not in body and body["temperature"] == 0.5
    rows = spark.createDataFrame([("k", " go ", ["a", "b"])], "key string, nl string, pseudocode array<string>")
    r = prompting.training_rows(rows, "sys").first()
    assert r["text"] == "<|system|>\nsys\n<|user|>\ngo\n<|assistant|>\na\nb" and r["completion"] == "a\nb"


def test_evaluate(spark):
    rows = [("when flag clicked\nhide", "when flag clicked\n  hide", "hide"), ("x", "y", "z"), (None, "", "")]
    df = spark.createDataFrame(rows, "prediction string, gold string, nl string")
    m = evaluate(compare(df)).first()
    assert m["examples"] == 3 and m["exact_match"] == pytest.approx(2 / 3) and m["vm_parse_rate"] == pytest.approx(1 / 3)
    assert evaluate(compare(df.limit(0))).first()["exact_match"] == 0
    assert report_lines(evaluate(compare(df))).first()[0] == "examples: 3"


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    open(path, "w").write('{"key":"a","pseudocode":["x","y"]}\n\n{"key":"b","pseudocode":"z"}\n{"key":"c","pse')
    assert [r["key"] for r in jsonl.read_done_keys(spark, path).orderBy("key").collect()] == ["a", "b"]
    head = jsonl.read_jsonl_head(spark, path, "key string", 3)
    assert [(r["ord"], r["key"]) for r in head.orderBy("ord").collect()] == [(0, "a"), (2, "b")]
    assert jsonl.read_jsonl_head(spark, path, "key string", 2, count_blank=False).count() == 2
    raw = head.select("key").join(jsonl.numbered_lines(spark, path).filter("ord < 3"), F.col("ord") >= 0).limit(0)
    assert raw.count() == 0
    v = spark.createDataFrame([('["x","y"]',), ('"z"',)], "j string").select(jsonl.string_or_lines(F.parse_json("j")).alias("l"))
    assert [r["l"] for r in v.collect()] == [["x", "y"], ["z"]]
    assert jsonl.sibling("out/p.jsonl", "_batch_input") == "out/p_batch_input.jsonl"
    jsonl.write_jsonl(head.select("key"), str(tmp_path / "o"))
    jsonl.write_jsonl(head.select("key"), str(tmp_path / "o"), mode="append")
    assert spark.read.json(str(tmp_path / "o")).count() == 4


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"key": "k", "nl": "When the green flag is clicked, move 10 steps.", "pseudocode": ["when @greenFlag clicked", "move (10) steps"]}) + "\n")
    q = score_stream(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).first()["alignment_score"] == 1.0


def test_collect_batch_keeps_every_turn(spark, tmp_path):
    from quillspark.plans import registry

    rows = [(1, t, "user", f" t{t} ") for t in range(0, 2500, 100)] + [(2, 1, "user", "a"), (2, 100, "user", "b"), (3, None, "user", "c")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r["conv_id"], r["turn"], r["key"], r["prediction"]) for r in registry.QUERIES["collect_batch"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and [g[:2] for g in got] == [r[:2] for r in rows]
    assert (1, 2300, "user", "t2300") in got and (1, 600, "user twice", "t600") in got and (3, None, "user", "c") in got


def test_collect_responses_takes_the_last_metadata_and_shows_bodies(spark):
    meta = spark.createDataFrame([("a", 0, 5, "old"), ("b", 1, 1, "b"), ("a", 2, 2, "new"), ("c", 3, 3, "c")], "custom_id string, line int, order int, key string")
    answers = [("a", "", 200, None, " ok "), ("b", None, 500, '{"e":1}', "x"), ("c", None, None, None, None)]
    frame = spark.createDataFrame(answers, "custom_id string, error string, status_code int, body string, content string")
    got = [(r["key"], r["prediction"]) for r in joins.collect_responses(frame, meta, position="line").collect()]
    assert got == [("b", 'ERROR: status 500 {"e":1}'), ("new", "ok"), ("c", "ERROR: status None None")]


def test_lines_of_several_files_stay_in_order(spark, tmp_path):
    sizes = {"a": 5, "b": 40_000, "c": 1, "d": 3000}
    for name, n in sizes.items():
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    want = [f"{name}{i}" for name, n in sizes.items() for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = [(r["ord"], r["line"]) for r in jsonl.numbered_lines(spark, str(tmp_path)).orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(want))


def test_checkpoints_and_mismatches(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}", "p1", f"n{i}") for i in range(7)], "order long, prediction string, gold string, nl string").repartition(3)
    paths = jsonl.write_checkpoints(df, str(tmp_path / "out.jsonl"), 3)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["out_checkpoint_3.jsonl", "out_checkpoint_6.jsonl", "out.jsonl"]
    assert [spark.read.json(p).count() for p in paths] == [3, 6, 7]
    rows = mismatches(compare(df, nl=None, parser=False), 2)
    assert [r["line"] for r in mismatch_lines(rows).collect()] == ["--- mismatch ---", "NL: n0", "PRED: p0", "GOLD: p1", "--- mismatch ---", "NL: n2", "PRED: p2", "GOLD: p1"]


def test_split_of_a_folder_and_summary(spark, tmp_path):
    (tmp_path / "validation.jsonl").write_text('{"key":"a"}\n{"key":"b"}\n')
    assert jsonl.read_split(spark, str(tmp_path), "val", "key string").count() == 2
    jsonl.write_summary(spark.createDataFrame([("overall", "n", 1.0)], "group string, metric string, value double"), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first().asDict() == {"group": "overall", "metric": "n", "value": "1.0"}
