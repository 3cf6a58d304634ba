"""Candidate spans in whole texts, found by regular expressions in the JVM.

``split`` gives what lies between the matches of a pattern and
``regexp_extract_all`` the matches; both walk the text from left to right, so
adding up their lengths gives every match's offset, in code points.  The sums
are a window over one text's matches, so memory is bounded by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters before and after a match that features of context look at; a window of features, not of the search.
BEFORE, AFTER = 48, 16


@dataclass(frozen=True)
class Generator:
    """kind: what the span may be; name: the generator's own; guard: a text that doesn't match it holds no match."""

    kind: str
    name: str
    pattern: str
    guard: str


def number_rows(docs: DataFrame, row_col: str = "_row") -> DataFrame:
    """A number for each row, so that rows of equal ids stay apart; write the result before use."""
    return docs.withColumn(row_col, F.monotonically_increasing_id())


def _matches(k: int, parts: Column, hits: Column) -> Column:
    """The k-th generator's matches with what stands around them."""
    return F.transform(
        hits,
        lambda hit, i: F.struct(
            F.lit(k).alias("g"),
            i.alias("i"),
            F.char_length(F.get(parts, i)).alias("lead"),
            F.right(F.get(parts, i), F.lit(BEFORE)).alias("before"),
            hit.alias("hit"),
            F.left(F.get(parts, i + 1), F.lit(AFTER)).alias("after"),
        ),
    )


def proposals(docs: DataFrame, generators: list[Generator], text_col: str = "text") -> DataFrame:
    """docs with _found: array of (g, i, lead, before, hit, after) of each generator's i-th match."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    guarded = lambda g, x: F.when(text.rlike(g.guard), x).otherwise(F.array().cast("array<string>"))
    out = docs.withColumns(
        {f"_parts{k}": guarded(g, F.split(text, g.pattern, -1)) for k, g in enumerate(generators)}
        | {f"_hits{k}": guarded(g, F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0))) for k, g in enumerate(generators)}
    )
    found = [_matches(k, F.col(f"_parts{k}"), F.col(f"_hits{k}")) for k in range(len(generators))]
    out = out.withColumn("_found", F.concat(*found))
    return out.drop(*(f"_{x}{k}" for x in ("parts", "hits") for k in range(len(generators))))


def located(found: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row for each proposal: keep (_row and what belongs to it), g, start, end, before, hit, after.

    Offsets count code points, end is exclusive.
    """
    keep = keep or ["_row"]
    rows = found.select(*keep, F.explode("_found").alias("_f")).select(*keep, "_f.*")
    upto = Window.partitionBy("_row", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("lead").cast("long") + F.char_length("hit")).over(upto)
    rows = rows.withColumn("end", end)
    return rows.withColumn("start", F.col("end") - F.char_length("hit")).drop("i", "lead")


def last_word_in(before: Column, words: list[str]) -> Column:
    """Is one of the words among what stands before the match?"""
    return F.lower(before).rlike("(?:^|[^a-z])(?:" + "|".join(words) + ")")


def char_class(c: Column) -> Column:
    """Of a one-character (or empty) string: 0 empty or white space, 1 letter, 2 digit, 3 anything else."""
    return F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)
