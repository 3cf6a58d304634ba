import pytest
from pyspark.sql import functions as F

from quillspark.functions.operands import condition_blocks, operand_tree


def trees(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r["i"]: r["x"] for r in df.select("i", operand_tree(F.col("t"), **how).alias("x")).collect()}
    return [None if got[i] is None else [tuple(n) for n in got[i]] for i in range(len(texts))]


def test_conditions(spark):
    got = trees(spark, [
        "(5) = (score + 1)", "not touching ( Edge v)?", "color (#f00) is touching color (#0f0)?", "(hello) contains (e)?",
        "(letter 2 of length of (answer)) < (-1.5)", "mouse up?", "mouse left?",
    ])
    assert got[0] == [
        (None, None, "operator_equals", None, None), (0, "OPERAND1", "math_number", "NUM", "5"), (0, "OPERAND2", "operator_add", None, None),
        (2, "NUM1", "math_number", "NUM", "score "), (2, "NUM2", "math_number", "NUM", "1"),
    ]
    assert got[1] == [(None, None, "operator_not", None, None), (0, "OPERAND", "sensing_touchingobject", None, None), (1, "TOUCHINGOBJECTMENU", "sensing_touchingobjectmenu", "TOUCHINGOBJECTMENU", "_edge_")]
    assert got[2] == [(None, None, "sensing_coloristouchingcolor", None, None), (0, "COLOR1", "colour_picker", "COLOUR", "#f00"), (0, "COLOR2", "colour_picker", "COLOUR", "#0f0")]
    assert [n[2:] for n in got[3]] == [("operator_contains", None, None), ("text", "TEXT", "hello"), ("text", "TEXT", "e")]
    assert [(n[0], n[2], n[4]) for n in got[4]] == [
        (None, "operator_lt", None), (0, "operator_letter_of", None), (0, "math_number", "-1.5"), (1, "math_whole_number", "2"), (1, "operator_length", None), (4, "sensing_answer", None),
    ]
    assert [n[2] for n in got[5]] == ["operator_not", "sensing_mousedown"] and [n[2] for n in got[6]] == ["sensing_mousedown"]


def test_the_last_rule_wins_over_the_whole_condition(spark):
    got = trees(spark, ["(x position) > (10) and not touching (edge v)?", "mouse down? and (1) = (2)", "(a) = (b) and unclear", "a and b and c", "a or b and c", "key (space v) pressed? or x"])
    assert [n[2] for n in got[0]] == ["sensing_touchingobject", "sensing_touchingobjectmenu"]
    assert [n[2] for n in got[1]] == ["sensing_mousedown"]
    assert [n[2] for n in got[2]] == ["operator_equals", "text", "text"]
    assert [n[2] for n in got[3]] == ["operator_and", None, None]
    assert [n[2] for n in got[4]] == ["operator_and", "operator_or", None, None, None]
    assert [n[2] for n in got[5]] == ["sensing_keypressed", "sensing_keyoptions"]


def test_empty_null_and_not_understood(spark):
    assert trees(spark, ["", "  ", "whatever", None]) == [[(None, None, None, None, None)]] * 3 + [None]
    assert trees(spark, ["", None], kind="any") == [[(None, None, "text", "TEXT", "")], None]
    with pytest.raises(ValueError):
        operand_tree(F.col("t"), "no such kind")


def test_expressions(spark):
    texts = ["a - b * c", "10 mod 3", "round (2.5)", "join (a, b, c)", "pick random (1) to (6)", "sqrt of 9", "10^ of 2", "e^ of 2", "current [day of week v]", "timer", "Timer"]
    got = [[n[2:] for n in t] for t in trees(spark, texts, kind="any")]
    assert got[0] == [("operator_multiply", None, None), ("math_number", "NUM", "a - b "), ("math_number", "NUM", "c")]
    assert got[1][0][0] == "operator_mod" and got[2] == [("operator_round", None, None), ("math_number", "NUM", "2.5")]
    assert got[3] == [("operator_join", None, None), ("text", "TEXT", "a, b"), ("text", "TEXT", "c")]
    assert [n[2] for n in got[4]] == [None, "1", "6"] and got[4][0][0] == "operator_pickrandom"
    assert got[5] == [("operator_mathop", "OPERATOR", "sqrt"), ("math_number", "NUM", "9")] and got[6][0][2] == "10^"
    assert got[7] == [("text", "TEXT", "e^ of 2")]
    assert [t[0][0] for t in got[8:]] == ["sensing_current_day_of_week", "sensing_timer", "text"]


def test_kinds_and_variables(spark):
    assert trees(spark, ["nearest"], kind="goto_menu")[0][0][2:] == ("motion_goto_menu", "TO", "_random_")
    assert trees(spark, ["Mouse pointer"], kind="touching_object_menu")[0][0][4] == "_mouse_"
    known = F.array(F.lit("Score"), F.lit("score"), F.lit("edge"))
    assert trees(spark, ["SCORE"], kind="math_number", variables=known)[0][0][2:] == ("VARIABLE", None, "Score")
    assert trees(spark, ["edge"], kind="touching_object_menu", variables=known)[0][0][2] == "sensing_touchingobjectmenu"


def test_condition_blocks(spark):
    code = "when @greenFlag clicked\nif <(timer) > (3)> then\nwait until <mouse down?>\nend\nrepeat until <nothing known>\nend"
    df = spark.createDataFrame([(1, code, "x"), (2, None, "y"), (3, "move (3) steps", "z")], "id int, code string, opcode string")
    got = sorted((r["id"], r["seq"], r["node"], r["parent"], r["opcode"]) for r in condition_blocks(df, "id", "code").collect())
    assert got == [(1, 1, 0, None, "operator_gt"), (1, 1, 1, 0, "sensing_timer"), (1, 1, 2, 0, "math_number"), (1, 2, 0, None, "sensing_mousedown"), (1, 4, 0, None, None)]


def test_a_long_condition(spark):
    got = trees(spark, [" and ".join(["not not (1) = (2)"] * 300)])[0]
    assert [n[2] for n in got][:4] == ["operator_not", "operator_not", "operator_equals", "text"] and len(got) == 5
