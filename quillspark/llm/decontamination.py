"""Benchmark decontamination with a positional inverted index.

One pass over the corpus stores the postings (row, position, term) of all terms
that the benchmark uses.  A benchmark item is cut into windows of consecutive
words, and the terms of each window are ranked by how many postings they have.
The list of the rarest term, shifted by its offset in the window, gives where the
window may start; it is intersected with the shifted list of the next rarest, and
what is left with those of the other terms.  Where all agree there is an exact
phrase match; where all terms are near the rarest, a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import drop_shared, lower_ascii, write_shared

#: What stands between words: ASCII characters that are neither digit nor letter.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark of up to so many windows is broadcast (some 200 bytes each); a larger one is shuffled.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def item_windows(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(_item, _window: array of words): all runs of ``size`` words; a shorter item is one window."""
    own = items.select(F.col(item_col).alias("_item"), words(F.col(text_col)).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - size + 1))
    return own.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, size))).alias("_window")).distinct()


def build_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, small: bool) -> DataFrame:
    """Stored postings (_x, _pos, _term) of the terms (_term), from one pass over the texts.

    ``_x`` numbers the rows.  A posting at -1 stands for the row itself and has its
    _id and number of words.
    """
    own = docs.select(F.monotonically_increasing_id().alias("_x"), F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_words"))
    own = own.select("_x", "_id", F.size("_words").alias("_n"), F.posexplode(F.concat(F.array(F.lit("")), "_words")).alias("_at", "_term"))
    wanted = terms.select(F.col("_term").alias("_t")).unionAll(terms.sparkSession.createDataFrame([("",)], "_t string")).distinct()
    own = own.join(F.broadcast(wanted) if small else wanted, F.col("_term") == F.col("_t"), "left_semi")
    itself = F.col("_at") == 0  # no word is empty
    return write_shared(own.select("_x", (F.col("_at") - 1).alias("_pos"), "_term", F.when(itself, F.col("_id")).alias("_id"), F.when(itself, F.col("_n")).alias("_n")), "postings")


def postings(index: DataFrame) -> DataFrame:
    """The index without the rows that stand for documents."""
    return index.filter("_pos >= 0").select("_x", "_pos", "_term")


def ranked_windows(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Each distinct window, with a number _w and _by: its (count, offset, term) from the rarest term on; of those that can occur."""
    once = windows.select("_window").distinct().withColumn("_w", F.monotonically_increasing_id())
    terms = once.select("_w", "_window", F.posexplode("_window").alias("_offset", "_term"))
    counts = index.filter("_pos >= 0").groupBy("_term").agg(F.count(F.lit(1)).alias("_count"))
    rated = terms.join(counts, "_term", "left").fillna(0, ["_count"])
    ranked = rated.groupBy("_w", "_window").agg(F.array_sort(F.collect_list(F.struct("_count", "_offset", "_term"))).alias("_by"))
    return ranked.filter(F.col("_by")[0]["_count"] > 0)


def _phrases(index: DataFrame, ranked: DataFrame, small: bool) -> DataFrame:
    """(_x, _w, _start, _n): where windows occur word for word."""
    first, second = F.col("_by")[0], F.get("_by", F.lit(1))
    lists = ranked.select("_w", first["_term"].alias("_term"), first["_offset"].alias("_o"), second["_term"].alias("_t2"), second["_offset"].alias("_o2"), F.slice("_by", 3, 1 << 30).alias("_rest"), F.size("_by").alias("_n"))
    met = postings(index).join(F.broadcast(lists) if small else lists, "_term")
    at = write_shared(met.withColumn("_start", F.col("_pos") - F.col("_o")).filter("_start >= 0").select("_x", "_w", "_start", "_t2", "_o2", "_rest", "_n"), "starts")
    # the next rarest list, shifted: only the postings of terms that are second in some window
    twos = lists.select(F.col("_t2").alias("_t")).filter("_t IS NOT NULL").distinct()
    others = postings(index).join(F.broadcast(twos) if small else twos, F.col("_term") == F.col("_t"), "left_semi")
    others = others.select(F.col("_x").alias("_y"), F.col("_pos").alias("_p"), F.col("_term").alias("_t"))
    pairs = at.join(others, (F.col("_x") == F.col("_y")) & (F.col("_start") + F.col("_o2") == F.col("_p")) & (F.col("_t2") == F.col("_t")), "left_semi")
    pairs = write_shared(pairs.unionAll(at.filter("_t2 IS NULL")).select("_x", "_w", "_start", "_rest", "_n"), "starts")
    # and those of all other terms, in the rows that are left
    rest = pairs.select("_x", "_w", "_start", "_n", F.explode("_rest").alias("_r"))
    rest = rest.select("_x", "_w", "_start", "_n", (F.col("_start") + F.col("_r._offset")).alias("_pos"), F.col("_r._term").alias("_term"))
    near = postings(index).join(pairs.filter("_n > 2").select("_x").distinct(), "_x", "left_semi")
    agreed = rest.join(near, ["_x", "_pos", "_term"]).groupBy("_x", "_w", "_start", "_n").agg(F.count(F.lit(1)).alias("_k")).filter("_k = _n - 2").drop("_k")
    out = agreed.unionAll(pairs.filter("_n <= 2").select("_x", "_w", "_start", "_n"))
    out = write_shared(out, "phrases")
    drop_shared(at, pairs)
    return out


def _passages(index: DataFrame, ranked: DataFrame, size: int, small: bool) -> DataFrame:
    """(_x, _w, _start, _n): stretches from the first to the last of a window's words that lie near an occurrence of its rarest."""
    first = F.col("_by")[0]
    lists = ranked.select("_w", "_window", first["_term"].alias("_term"))
    met = postings(index).join(F.broadcast(lists) if small else lists, "_term").select("_x", "_w", F.col("_pos").alias("_p"), "_window")
    often = lambda t: F.size(F.filter("_window", lambda v: v == t))
    asked = met.select("_x", "_w", "_p", F.size(F.array_distinct("_window")).alias("_d"), F.explode(F.transform(F.array_distinct("_window"), lambda t: F.struct(t.alias("t"), often(t).alias("m")))).alias("_a"))
    # positions go to buckets of ``size``, so a term is looked for in its neighbourhood alone
    asked = asked.select("*", F.explode(F.array(*[F.floor(F.col("_p") / size) + i for i in (-1, 0, 1)])).alias("_b"))
    spots = postings(index).join(met.select("_x").distinct(), "_x", "left_semi").select(F.col("_x").alias("_y"), "_pos", F.col("_term").alias("_t"), F.floor(F.col("_pos") / size).alias("_c"))
    found = asked.join(spots, (F.col("_x") == F.col("_y")) & (F.col("_a.t") == F.col("_t")) & (F.col("_b") == F.col("_c")) & (F.abs(F.col("_pos") - F.col("_p")) < size))
    by_term = found.groupBy("_x", "_w", "_p", "_d", "_a").agg(F.count(F.lit(1)).alias("_k"), F.min("_pos").alias("_low"), F.max("_pos").alias("_high")).filter(F.col("_k") >= F.col("_a.m"))
    all_terms = by_term.groupBy("_x", "_w", "_p", "_d").agg(F.count(F.lit(1)).alias("_k"), F.min("_low").alias("_start"), F.max("_high").alias("_end")).filter("_k = _d")
    return all_terms.select("_x", "_w", "_start", (F.col("_end") - F.col("_start") + 1).alias("_n"))


def searched(docs: DataFrame, items: DataFrame, size: int, exact: bool, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """The stored index, and distinct (_x, _item, _start, _n) of the matches."""
    windows = write_shared(item_windows(items, size, item_col, item_text_col), "windows")
    small = windows.count() <= BROADCAST_WINDOWS
    index = build_index(docs, windows.select(F.explode("_window").alias("_term")), id_col, text_col, small)
    ranked = write_shared(ranked_windows(windows, index), "ranked")
    found = _phrases(index, ranked, small) if exact else _passages(index, ranked, size, small)
    numbers = ranked.select("_w", "_window").join(windows, "_window").select("_w", "_item")
    return index, found.join(F.broadcast(numbers) if small else numbers, "_w").select("_x", "_item", "_start", "_n").distinct()


def matches(docs: DataFrame, items: DataFrame, *, size: int = 8, exact: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Distinct (id_col, _x, _item, _start, _n): the stretches of _n words, from word _start on, that match an item; _x numbers the rows of docs.

    ``exact``: a window, word for word.  Else all words of a window, as often as it
    has them, lie less than ``size`` words from an occurrence of its rarest term, in
    any order; the stretch runs from the first of them to the last.
    """
    index, found = searched(docs, items, size, exact, id_col, text_col, item_col, item_text_col)
    return found.join(index.filter("_pos = -1").select("_x", F.col("_id").alias(id_col)), "_x").select(id_col, "_x", "_item", "_start", "_n")


def contamination(docs: DataFrame, items: DataFrame, *, size: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, n_words, n_hit and items (item ids as sorted strings).

    A word inside any occurrence of a window of an item is hit.  Null and empty
    texts have no words and no items; equal rows have equal results; items
    without words match nothing, and items of one id count once; empty tables
    give empty (or unhit) results; other columns are not read.
    """
    index, found = searched(docs, items, size, True, id_col, text_col, item_col, item_text_col)
    found = write_shared(found, "matches")
    spans = found.groupBy("_x", "_start").agg(F.max("_n").alias("_n"))
    before = Window.partitionBy("_x").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)  # one text's spans
    end = F.col("_start") + F.col("_n")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("_start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    hit = spans.withColumn("_new", new).groupBy("_x").agg(F.sum("_new").alias("n_hit"))
    items_of = found.select("_x", F.col("_item").cast("string").alias("_i")).distinct().groupBy("_x").agg(F.array_sort(F.collect_list("_i")).alias("items"))
    rows = index.filter("_pos = -1").select("_x", F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_words"))
    out = rows.join(hit.join(items_of, "_x"), "_x", "left").drop("_x")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
