"""Repair of generated programs before they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import let, lines_of, none, strip, strip_special_tokens

# Words that begin a block; a program in one line is broken before them.
BLOCK_WORDS = "when|move|turn|say|think|wait|broadcast|forever|repeat|if|else|end|set|change|go|glide|point|show|hide|play|stop|ask|switch|next|clear|pen|stamp|add|delete|replace|insert"


def _begins(low: Column, prefix: str) -> Column:
    return F.startswith(low, F.lit(prefix))


def _plain(line: Column) -> Column:
    """Without a joining word at either end, and with the flag hat in its usual spelling."""
    bare = F.regexp_replace(F.regexp_replace(strip(line), r"(?iU)^(and|then)\s+", ""), r"(?iU)\s+(and|then)$", "")
    return F.regexp_replace(bare, r"(?iU)^when\s+green\s+flag\s+clicked\b", "when @greenFlag clicked")


def _wait(line: Column, low: Column) -> Column:
    line = F.when(_begins(low, "forever:"), F.lit("forever")).otherwise(line)
    until = F.rtrim(strip(F.substring(line, F.lit(12), F.char_length(line))), F.lit(">"))
    return F.when(_begins(low, "wait until ") & ~_begins(low, "wait until <"), F.concat(F.lit("wait until <"), until, F.lit(">"))).otherwise(line)


def _touching(line: Column, low: Column) -> Column:
    closed = F.nullif(F.regexp_extract(line, r"(?i)^if touching\s+\[?([^\]\?]+)\]?\??>", 1), F.lit(""))
    opened = F.nullif(F.regexp_extract(line, r"(?i)^if touching\s+([A-Za-z0-9_ ]+)\??", 1), F.lit(""))
    named = let(F.coalesce(closed, opened), lambda thing: F.concat(F.lit("if <touching ("), strip(thing), F.lit(" v)?> then")))
    edge = _begins(low, "if touching") & F.contains(low, F.lit("edge"))
    return F.when(edge, F.lit("if <touching (edge v)?> then")).otherwise(F.coalesce(named, line))


def _test(line: Column, low: Column) -> Column:
    opened = lambda x: F.when(F.startswith(x, F.lit("<")), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))
    closed = lambda x: F.concat(F.lit("if "), x, F.when(F.endswith(x, F.lit(">")), F.lit("")).otherwise(F.lit(">")), F.lit(" then"))
    wrapped = let(let(strip(F.substring(line, F.lit(4), F.char_length(line))), opened), closed)
    return F.when(_begins(low, "if ") & ~F.contains(low, F.lit(" then")), wrapped).otherwise(line)


def rewrite_lines(lines: Column) -> Column:
    """The line rewrites, in order; all after the first look at what it gave, in lower case."""
    pairs = F.transform(F.transform(lines, _plain), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    for rule in (_wait, _touching, _test):
        pairs = _apply(pairs, rule)
    return F.transform(pairs, lambda p: p["line"])


def _apply(pairs: Column, rule) -> Column:
    return F.transform(pairs, lambda p: F.struct(rule(p["line"], p["low"]).alias("line"), p["low"].alias("low")))


def fix_blocks(lines: Column) -> Column:
    """Drop unmatched end and else and nested forever, close what is open, and drop empty forever blocks."""
    start = F.struct(none().alias("stack"), none().alias("out"))

    def step(s: Column, line: Column) -> Column:
        low, top, depth = F.lower(line), F.try_element_at(s["stack"], F.lit(-1)), F.size(s["stack"])
        opens = F.when(F.startswith(low, F.lit("repeat ")), "repeat").when(low == "forever", "forever").when(F.startswith(low, F.lit("if ")) & F.endswith(low, F.lit("then")), "if")
        nested = (opens == "forever") & F.array_contains(s["stack"], "forever")
        drop = ((low == "end") & (depth == 0)) | ((low == "else") & ~F.coalesce(top == "if", F.lit(False))) | F.coalesce(nested, F.lit(False))
        stack = F.when((low == "end") & (depth > 0), F.slice(s["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0)))).when(opens.isNotNull() & ~F.coalesce(nested, F.lit(False)), F.array_append(s["stack"], opens)).otherwise(s["stack"])
        return F.struct(stack.alias("stack"), F.when(drop, s["out"]).otherwise(F.array_append(s["out"], line)).alias("out"))

    closed = F.aggregate(lines, start, step, lambda s: F.concat(s["out"], F.array_repeat(F.lit("end"), F.size(s["stack"]))))
    begin = F.struct(F.lit(False).alias("held"), none().alias("out"), F.lit("").alias("line"))

    def prune(s: Column, line: Column) -> Column:
        low = F.lower(line)
        # a forever is held back until the next line shows that it isn't empty
        empty = s["held"] & (low == "end")
        kept = F.when(s["held"] & (low != "end"), F.array_append(s["out"], s["line"])).otherwise(s["out"])
        holds = ~empty & (low == "forever")
        return F.struct(holds.alias("held"), F.when(empty | holds, kept).otherwise(F.array_append(kept, line)).alias("out"), line.alias("line"))

    return F.aggregate(closed, begin, prune, lambda s: F.when(s["held"], F.array_append(s["out"], s["line"])).otherwise(s["out"]))


def truncate_repetition(lines: Column, least: int = 5) -> Column:
    """Cut after the first copy of a block of ``least`` lines or more that follows itself: the shortest, then earliest."""
    return let(lines, lambda own: _cut_repetition(own, least))


def _cut_repetition(lines: Column, least: int) -> Column:
    n = F.size(lines)
    sizes = F.when(n >= 2 * least, F.sequence(F.lit(least), F.floor(n / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    same = lambda k, i: F.slice(lines, i + 1, k) == F.slice(lines, i + k + 1, k)
    ends = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(0), n - 2 * k), lambda i: F.when(same(k, i), i + k))))
    return let(F.get(F.array_compact(ends), F.lit(0)), lambda end: F.when(end.isNull(), lines).otherwise(F.slice(lines, F.lit(1), F.coalesce(end, F.lit(0)))))


def _broken(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n")), text).otherwise(F.regexp_replace(text, rf"(?iU)\s+(?=({BLOCK_WORDS})\b)", "\n"))


def postprocess(c: Column) -> Column:
    """Cut special tokens, break a one-line program into lines, rewrite lines, repair blocks and cut repetitions."""
    text = let(strip(strip_special_tokens(F.coalesce(c, F.lit("")))), _broken)
    return strip(F.array_join(truncate_repetition(fix_blocks(rewrite_lines(lines_of(text)))), "\n"))
