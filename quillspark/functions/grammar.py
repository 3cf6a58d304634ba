"""Acceptance of block programs, and their blocks as rows.

Lines are classified by patterns; a fold over them keeps whether a script has
begun and which control blocks are open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import let, none, strip

# Statements (opcode, pattern), the first match wins.
STATEMENTS = [
    ("looks_say", r"^say \[(.+)\]$"), ("looks_sayforsecs", r"^say \[(.+)\] for \((.+)\) seconds$"),
    ("looks_think", r"^think \[(.+)\]$"), ("looks_thinkforsecs", r"^think \[(.+)\] for \((.+)\) seconds$"),
    ("looks_switchcostumeto", r"^switch costume to \[(.+?)\]$"), ("data_changevariableby", r"^change \[(.+?) v\] by \((.+?)\)$"),
    ("data_setvariableto", r"^set \[(.+?) v\] to \[(.+?)\]$"), ("data_setvariableto", r"^set \[(.+?) v\] to \((.+?)\)$"),
    ("motion_pointindirection", r"^point in direction \((.+?)\)$"), ("motion_setx", r"^set x to \((.+?)\)$"), ("motion_sety", r"^set y to \((.+?)\)$"),
    ("motion_changexby", r"^change x by \((.+?)\)$"), ("motion_changeyby", r"^change y by \((.+?)\)$"), ("motion_goto", r"^go to \((.+?) v\)$"),
    ("motion_gotoxy", r"^go to x: \((.+)\) y: \((.+)\)$"), ("motion_movesteps", r"^move \((.+)\) steps$"), ("motion_glideto", r"^glide \((.+)\) secs to \((.+) v\)$"),
    ("motion_glidesecstoxy", r"^glide \((.+)\) secs to x: \((.+)\) y: \((.+)\)$"), ("motion_turnleft", r"^turn left \((.+?)\) degrees$"), ("motion_turnright", r"^turn right \((.+?)\) degrees$"),
    ("event_broadcast", r"^broadcast \[(.+?) v\]$"), ("event_broadcastandwait", r"^broadcast \[(.+?) v\] and wait$"), ("control_create_clone_of", r"^create clone of \[(.+?)\]$"),
    ("control_delete_this_clone", r"^delete this clone$"), ("control_stop", r"^stop \[(all|this script|other scripts in sprite) v\]$"), ("control_wait", r"^wait \((.+?)\) seconds$"),
    ("control_wait_until", r"^wait until <(.+?)>$"), ("sound_stopallsounds", r"^stop all sounds$"), ("sound_play", r"^play sound \((.+?) v\)$"),
    ("sound_playuntildone", r"^play sound \\((.+) v\\) until done"), ("looks_hide", r"hide"), ("looks_show", r"show"), ("sensing_askandwait", r"^ask (.+) and wait"),
]
# Hats (opcode, pattern); a received message is never accepted.
HATS = [
    ("event_whenflagclicked", r"^when (?:@greenFlag|green flag|flag) clicked$"), ("event_whenthisspriteclicked", r"^when this sprite clicked$"),
    ("event_whenbackdropswitchesto", r"when backdrop switches to \[(.+?)\]"), ("rejected", r"when I receive \[(.+?)\]"),
    ("event_whenkeypressed", r"when \((.+?) v\) key pressed"), ("event_whengreaterthan", r"when \[(.+?) v\] > \((.+?)\)"),
]


def program_lines(c: Column) -> Column:
    """Trimmed lines of a program's text that aren't empty."""
    return F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")


def _one_fails(x: Column) -> Column:
    key = x.rlike(r"key \((.*) v\) presse?") & ~x.rlike(r"key \((.*) v\) pressed")
    contains = F.contains(x, F.lit(" contains ")) & ~x.rlike(r"\((.+)\) contains \((.+)\)\?")
    color = F.contains(x, F.lit(" is touching color ")) & ~x.rlike(r"color \((.+)\) is touching color \((.+)\)\?")
    return key | contains | color


def condition_fails(c: Column, depth: int = 3) -> Column:
    """Does a condition raise an error?  It is looked at as a whole, and in the parts that or, and and not join."""
    return let(F.array(strip(c)), lambda level: _level_fails(level, depth))


def _level_fails(level: Column, depth: int) -> Column:
    if depth == 0:
        return F.lit(False)
    halves = lambda x, word: F.when(F.contains(x, F.lit(word)), F.slice(F.split(x, word, -1), 1, 2)).otherwise(none())
    rest = lambda x: F.when(F.startswith(x, F.lit("not ")), F.array(F.substring(x, F.lit(5), F.char_length(x)))).otherwise(none())
    below = F.flatten(F.transform(level, lambda x: F.transform(F.concat(halves(x, " or "), halves(x, " and "), rest(x)), strip)))
    return F.exists(level, _one_fails) | let(below, lambda parts: _level_fails(parts, depth - 1))


def opcode(line: Column) -> Column:
    """Opcode of a trimmed line; null if nothing matches, "rejected" if the line can never be accepted."""
    fails = lambda pattern: condition_fails(F.regexp_extract(line, pattern, 1))
    is_if = r"if\s*<(.+?)>\s*then"
    begins = lambda p: F.startswith(line, F.lit(p))
    hat, statement = F.lit("rejected"), F.lit(None).cast("string")
    for name, pattern in reversed(HATS):
        hat = F.when(line.rlike(pattern), name).otherwise(hat)
    for name, pattern in reversed(STATEMENTS):
        bad = fails(pattern) if name == "control_wait_until" else F.lit(False)
        statement = F.when(line.rlike(pattern), F.when(bad, "rejected").otherwise(name)).otherwise(statement)
    until = r"^repeat until\s*<(.+?)>"
    return (
        F.when(line == "end", "end")
        .when(begins("when"), hat)
        .when(line == "forever", "control_forever")
        .when(line.rlike(r"^repeat\s*\((.+?)\)"), "control_repeat")
        .when(line.rlike(until), F.when(fails(until), "rejected").otherwise("control_repeat_until"))
        .when(begins("if"), F.when((line == "if on edge, bounce") | ~line.rlike(is_if) | fails(is_if), "rejected").otherwise("control_if"))
        .when(begins("else"), "else")
        .when(begins("go to (random position v)"), "motion_goto")
        .otherwise(statement)
    )


CONTROLS = ["control_forever", "control_repeat", "control_repeat_until", "control_if"]


def accepts(codes: Column) -> Column:
    """Is a program of these opcodes accepted?  It needs a hat before any block, and no unmatched end or else."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(False).alias("script"), none().alias("stack"))

    def step(s: Column, code: Column) -> Column:
        stack, depth = s["stack"], F.size(s["stack"])
        hat, control = F.coalesce(F.startswith(code, F.lit("event_when")), F.lit(False)), F.coalesce(code.isin(CONTROLS), F.lit(False))
        fine = (
            F.when(code.isNull() | (code == "rejected"), False)
            .when(hat, True)
            .when(code == "end", depth > 0)
            .when(code == "else", F.coalesce(F.try_element_at(stack, F.lit(-1)) == "control_if", F.lit(False)))
            .otherwise(s["script"])
        )
        grown = F.when(control, F.array_append(stack, code)).when(code == "else", F.array_append(stack, F.lit("control_if_else"))).when((code == "end") & (depth > 0), F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0)))).otherwise(stack)
        return F.struct((s["ok"] & fine).alias("ok"), (s["script"] | hat).alias("script"), grown.alias("stack"))

    return F.aggregate(codes, start, step, lambda s: s["ok"] & s["script"])


def accepted(df: DataFrame, text_col: str, out: str = "parse_ok") -> DataFrame:
    """df with ``out``: is the program accepted?  Null counts as empty, which isn't."""
    codes = F.transform(program_lines(F.coalesce(F.col(text_col), F.lit(""))), opcode)
    return df.withColumn("_codes", codes).withColumn(out, accepts(F.col("_codes"))).drop("_codes")


def program_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each block: id_col, seq, opcode, line, depth, parent_seq (the open control block or hat), next_seq."""
    lines = program_lines(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(id_col, F.posexplode(lines).alias("seq", "line")).withColumn("opcode", opcode(F.col("line")))
    order = Window.partitionBy(id_col).orderBy("seq")
    opens = F.col("opcode").isin([*CONTROLS, "else"])
    hat = F.startswith("opcode", F.lit("event_when"))
    rows = rows.withColumn("depth", F.sum(F.when(opens, 1).when(F.col("opcode") == "end", -1).otherwise(0)).over(order) - opens.cast("int"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_hat", F.max(F.when(hat, F.col("seq"))).over(before))
    opener = F.max(F.when(opens, F.struct("seq", "depth"))).over(before)
    level = Window.partitionBy(id_col, "depth").orderBy("seq")
    rows = rows.withColumn("_opener", opener)
    last_above = F.last(F.when(F.col("_opener.depth") == F.col("depth") - 1, F.col("_opener.seq")), ignorenulls=True).over(level)
    rows = rows.withColumn("parent_seq", F.when(hat, F.lit(None)).when(F.col("depth") > 0, last_above).otherwise(F.col("_hat")))
    blocks = rows.filter(~F.col("opcode").isin("end", "else", "rejected"))
    siblings = Window.partitionBy(id_col, "depth", "parent_seq").orderBy("seq")
    return blocks.withColumn("next_seq", F.lead("seq").over(siblings)).select(id_col, "seq", "opcode", "line", "depth", "parent_seq", "next_seq")
