"""Operand trees of conditions and inputs: which reporter blocks a text in brackets stands for.

A tree is an array of nodes in breadth-first order.  One fold builds it: step k
looks at node k, names its block and appends the texts of the block's inputs as
new nodes.  A node's inputs lie apart within its text, so there are at most two
nodes more than characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.grammar import opcode, program_lines
from quillspark.functions.text import has_any, let, matches, strip

# Conditions (opcode, pattern, inputs as (name, group or text, kind)), the first match wins.
CONDITIONS = [
    ("sensing_coloristouchingcolor", r"color \((.+)\) is touching color \((.+)\)\?", [("COLOR1", 1, "color"), ("COLOR2", 2, "color")]),
    ("operator_contains", r"\((.+)\) contains \((.+)\)\?", [("TEXT", 1, "text"), ("SUBSTRING", 2, "text")]),
    ("operator_not", r"^not (.*)$", [("OPERAND", 1, "condition")]),
    ("sensing_touchingcolor", r"touching color \((.+)\)\?", [("COLOR", 1, "color")]),
    ("sensing_mousedown", r"(?i)mouse down\?", []),
    ("operator_not", r"(?i)mouse up\?", [("OPERAND", "mouse down?", "condition")]),
    ("sensing_mousedown", r"(?i)mouse (left|right)\?", []),
    ("sensing_touchingobject", r"touching \((.*) v\)\?", [("TOUCHINGOBJECTMENU", 1, "touching_object_menu")]),
    ("sensing_keypressed", r"key \((.*) v\) pressed", [("KEY_OPTION", 1, "key_option")]),
    ("operator_lt", r"\((.+)\) < \((.+)\)", [("OPERAND1", 1, "compared"), ("OPERAND2", 2, "compared")]),
    ("operator_gt", r"\((.+)\) > \((.+)\)", [("OPERAND1", 1, "compared"), ("OPERAND2", 2, "compared")]),
    ("operator_equals", r"\((.+)\) = \((.+)\)", [("OPERAND1", 1, "compared"), ("OPERAND2", 2, "compared")]),
    ("operator_and", r"^(.*?) and (.*?)(?: and .*)?$", [("OPERAND1", 1, "condition"), ("OPERAND2", 2, "condition")]),
    ("operator_or", r"^(.*?) or (.*?)(?: or .*)?$", [("OPERAND1", 1, "condition"), ("OPERAND2", 2, "condition")]),
]
# Lines that hold a condition.
HOLDERS = {"control_if": r"if\s*<(.+?)>\s*then", "control_repeat_until": r"^repeat until\s*<(.+?)>", "control_wait_until": r"^wait until <(.+?)>$"}
# Opcodes of the arithmetic signs.
SIGNS = {"+": "operator_add", "-": "operator_subtract", "*": "operator_multiply", "/": "operator_divide"}
# Functions (opcode, pattern, inputs), the first match wins; the arithmetic ones come before.
ARITHMETIC = r"^(.+)\s*([+\-*/])\s*(.+)$"
FUNCTIONS = [
    ("operator_mod", r"^(.+)\s+mod\s+(.+)$", [("NUM1", 1, "math_number"), ("NUM2", 2, "math_number")]),
    ("operator_round", r"^round\s*\((.+)\)$", [("NUM", 1, "math_number")]),
    ("operator_join", r"^join\s*\((.+),\s*(.+)\)$", [("STRING1", 1, "text"), ("STRING2", 2, "text")]),
    ("operator_length", r"^length of\s*\((.+)\)$", [("STRING", 1, "any")]),
    ("operator_pickrandom", r"^pick random\s*\((.+?)\)\s*to\s*\((.+?)\)$", [("FROM", 1, "math_number"), ("TO", 2, "math_number")]),
    ("operator_letter_of", r"^letter\s+(\d+)\s+of\s+(.+)$", [("LETTER", 1, "whole_number"), ("STRING", 2, "any")]),
    ("operator_mathop", r"^(?:abs|floor|ceiling|sqrt|sin|cos|tan|asin|acos|atan|ln|log|10\^)\s+of\s+(.+)$", [("NUM", 1, "math_number")]),
]
# Reporters without inputs.
REPORTERS = {
    "x position": "motion_xposition", "y position": "motion_yposition", "direction": "motion_direction", "size": "looks_size",
    "costume [number v]": "looks_costumenumber", "costume [name v]": "looks_costumename",
    "backdrop [number v]": "looks_backdropnumber", "backdrop [name v]": "looks_backdropname",
    "volume": "sounds_volume", "answer": "sensing_answer", "username": "sensing_username", "days since 2000": "sensing_dayssince2000",
    "mouse x": "sensing_mousex", "mouse y": "sensing_mousey", "loudness": "sensing_loudness", "timer": "sensing_timer",
    "current [year v]": "sensing_current_year", "current [month v]": "sensing_current_month", "current [date v]": "sensing_current_date",
    "current [day of week v]": "sensing_current_day_of_week", "current [hour v]": "sensing_current_hour",
    "current [minute v]": "sensing_current_minute", "current [second v]": "sensing_current_second",
}
# What a text is where an input of a certain kind is expected (opcode, field).
LEAVES = {
    "math_number": ("math_number", "NUM"), "positive_number": ("math_positive_number", "NUM"), "whole_number": ("math_whole_number", "NUM"),
    "angle": ("math_angle", "NUM"), "text": ("text", "TEXT"), "color": ("colour_picker", "COLOUR"), "key_option": ("sensing_keyoptions", "KEY_OPTION"),
    "goto_menu": ("motion_goto_menu", "TO"), "glide_to_menu": ("motion_glide_to_menu", "TO"), "sound_menu": ("sound_sounds_menu", "SOUND_MENU"),
    "touching_object_menu": ("sensing_touchingobjectmenu", "TOUCHINGOBJECTMENU"), "clone_option": ("control_create_clone_of_menu", "CLONE_OPTION"),
    "looks_costume": ("looks_costume", "COSTUME"),
}
# Names of what may be touched, and menus that no variable stands in for.
TOUCHED = {"edge": "_edge_", "_edge_": "_edge_", "mouse-pointer": "_mouse_", "mouse pointer": "_mouse_", "_mouse_": "_mouse_"}
NO_VARIABLE = ["touching_object_menu", "sound_menu"]

_NODE = "struct<parent: int, input: string, kind: string, text: string, opcode: string, field: string, value: string>"
_LOOK = "struct<opcode: string, field: string, value: string>"


def _look(opcode, field=None, value=None) -> Column:
    made = [c if isinstance(c, Column) else F.lit(c).cast("string") for c in (opcode, field, value)]
    return F.struct(*[c.alias(n) for c, n in zip(made, ("opcode", "field", "value"))]).cast(_LOOK)


def _grown(k: Column, text: Column, pattern: str, inputs: list) -> Column:
    """New nodes for the inputs of node k."""
    nodes = []
    for name, part, kind in inputs:
        own = F.regexp_extract(text, pattern, part) if isinstance(part, int) else F.lit(part)
        if kind == "condition":
            own = strip(own)
        nodes.append(F.struct(k, F.lit(name), F.lit(kind), own, *[F.lit(None).cast("string")] * 3).cast(_NODE))
    return F.array(*nodes) if nodes else F.array().cast(f"array<{_NODE}>")


def _expand(node: Column, k: Column, variables: Column) -> Column:
    """The node with its block named, and its inputs' nodes."""
    kind, text = node["kind"], node["text"]
    nothing = F.array().cast(f"array<{_NODE}>")
    both = lambda look, nodes: F.struct(look.alias("look"), nodes.alias("nodes"))

    condition = both(_look(None), nothing)
    for code, pattern, inputs in reversed(CONDITIONS):
        condition = F.when(matches(text, pattern), both(_look(code), _grown(k, text, pattern, inputs))).otherwise(condition)

    reporter = F.create_map(*[F.lit(x) for pair in REPORTERS.items() for x in pair])
    expression = let(F.try_element_at(reporter, text), lambda plain: both(F.when(plain.isNotNull(), _look(plain)).otherwise(_look("text", "TEXT", text)), nothing))
    for code, pattern, inputs in reversed(FUNCTIONS):
        look = _look(code, "OPERATOR", F.regexp_extract(text, r"^(\S+)", 1)) if code == "operator_mathop" else _look(code)
        expression = F.when(matches(text, pattern), both(look, _grown(k, text, pattern, inputs))).otherwise(expression)
    sign = F.try_element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), F.regexp_extract(text, ARITHMETIC, 2))
    terms = [("NUM1", 1, "math_number"), ("NUM2", 3, "math_number")]
    expression = F.when(has_any(text, list(SIGNS)) & text.rlike(ARITHMETIC), both(_look(sign), _grown(k, text, ARITHMETIC, terms))).otherwise(expression)

    touched = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TOUCHED.items() for x in pair]), strip(F.lower(text))), text)
    # a number is a leaf where numbers are compared
    leaf_kind = F.when((kind == "compared") & strip(text).rlike(r"^-?\d+(\.\d+)?$"), "math_number").otherwise(kind)
    leaves = F.create_map(*[x for name, (code, field) in LEAVES.items() for x in (F.lit(name), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))])
    value = lambda field: F.when(field == "TO", F.lit("_random_")).when(kind == "touching_object_menu", touched).otherwise(text)
    leaf = let(F.try_element_at(leaves, leaf_kind), lambda made: F.when(made.isNotNull(), _look(made["code"], made["field"], value(made["field"]))))

    same = F.when(~kind.isin(NO_VARIABLE), F.get(F.filter(variables, lambda v: F.lower(v) == F.lower(text)), F.lit(0)))
    looked = lambda known: F.when(known.isNotNull(), both(known, nothing)).otherwise(expression)
    operand = let(same, lambda name: F.when(name.isNotNull(), both(_look("VARIABLE", None, name), nothing)).otherwise(let(leaf, looked)))
    return F.when(kind == "condition", condition).otherwise(operand)


def operand_tree(text: Column, kind: str = "condition", variables: Column | None = None) -> Column:
    """array<struct<parent, input, opcode, field, value>> of a text, the root first.

    ``kind``: "condition", "any" for expressions and reporters, or one of LEAVES.
    ``variables``: known names; a text that is one of them, in any case, is the
    block VARIABLE.  ``parent`` is the index of the parent's node, null for the
    root; ``opcode`` is null where a condition isn't understood.  A null text gives null.
    """
    if kind not in ("condition", "any", *LEAVES):
        raise ValueError(f"unknown kind of input: {kind}")
    known = variables if variables is not None else F.array().cast("array<string>")
    begin = strip(text) if kind == "condition" else text
    nulls = [F.lit(None).cast("string")] * 3
    root = F.array(F.struct(F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(kind), begin, *nulls).cast(_NODE))

    def step(nodes: Column, k: Column) -> Column:
        def put(node: Column) -> Column:
            def join(found: Column) -> Column:
                look = found["look"]
                done = F.struct(node["parent"], node["input"], node["kind"], node["text"], look["opcode"], look["field"], look["value"]).cast(_NODE)
                return F.concat(F.slice(nodes, F.lit(1), k), F.array(done), F.slice(nodes, k + 2, F.size(nodes)), found["nodes"])

            return let(_expand(node, k, known), join)

        return F.when(k < F.size(nodes), let(F.get(nodes, k), put)).otherwise(nodes)

    steps = F.sequence(F.lit(0), F.char_length(text) + 1)
    built = F.aggregate(steps, root, step)
    return F.transform(built, lambda n: F.struct(*[n[c].alias(c) for c in ("parent", "input", "opcode", "field", "value")]))


def condition_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each node of each condition in a program: id_col, seq (of the line), node, parent, input, opcode, field, value.

    Conditions are those of if, repeat until and wait until.  Programs without any, or null, give no row.
    """
    rows = df.select(id_col, F.posexplode(program_lines(F.coalesce(F.col(text_col), F.lit("")))).alias("seq", "line"))
    rows = rows.withColumn("_code", opcode(F.col("line"))).filter(F.col("_code").isin(list(HOLDERS)))
    text = F.lit(None).cast("string")
    for code, pattern in HOLDERS.items():
        text = F.when(F.col("_code") == code, F.regexp_extract("line", pattern, 1)).otherwise(text)
    tree = operand_tree(text)
    return rows.select(id_col, "seq", F.posexplode(tree).alias("node", "_n")).select(id_col, "seq", "node", "_n.*")
