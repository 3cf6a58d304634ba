"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (by 64-bit hash) is cut into fragments.  Two sets of
Jaccard similarity t or more differ in at most d = (1 - t) / (1 + t) (|A| + |B|)
n-grams, so with more than d fragments they agree on one; a document emits a
signature for each of its fragments, and documents of a signature form a block.
Within a block documents are compared with a leader, not with each other; of the
other pairs only those are compared that aren't in one component yet and whose
differences from the leader leave a link possible.  Comparing counts the partial
overlap of each vertical fragment by itself and sums the counts per pair.

Documents with equal sets form one class, which takes part once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import drop_shared, small_batches, write_shared

#: Vertical fragments in which overlaps are counted.
PARTS = 8
#: Buckets of the bitmap that keeps classes without candidates from being read again; its size is fixed.
BITMAP = 1 << 20


class Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ODD = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``size`` words; all words as one run if there are fewer."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    w = np.array(list(map(words.__getitem__, own)), np.uint64)
    run = min(size, len(w))
    total = np.full(len(w) - run + 1, np.uint64(run))
    for i in range(run):
        total += w[i : len(w) - run + 1 + i] * _ODD[i]
    return np.unique(_mix(total))


def class_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that sets share only if they are equal."""
    import xxhash

    return struct.unpack("<2q", xxhash.xxh3_128_digest(hashes.tobytes()))


def most_different(total: int, percent: int) -> int:
    """Most n-grams in which sets of so many n-grams together may differ."""
    return (100 - percent) * total // (100 + percent)


def meetings(n: int, percent: int) -> list[tuple[int, int, int]]:
    """Size classes in which a set of n n-grams may meet another: (class, fragments, most differing n-grams).

    Sizes 2^p to 2^(p+1) - 1 meet in class 2p; pairs astride N = 2^(p+1) meet in 2p + 1.
    """
    out = []
    p = n.bit_length() - 1
    reach = 100 * n // percent

    def add(number: int, largest: int, partner: int) -> None:
        d = most_different(largest, percent)
        out.append((number, d + 2 + d // 40, most_different(n + partner, percent)))

    high = (2 << p) - 1
    add(2 * p, 2 * high, min(high, reach))
    for q in range(max(0, p - 1), p + 1):  # astride 2^(q + 1)
        edge = 2 << q
        top = 100 * (edge - 1) // percent
        if n < edge and reach >= edge or edge <= n <= top:
            add(2 * q + 1, edge - 1 + top, reach if n < edge else edge - 1)
    return out


def signatures(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Signatures of the set's fragments in all size classes; none if only an equal set can be similar.

    The lowest two bits of a signature tell its size class from the set's
    others.  Second come the numbers of signatures that any similar set shares
    with this one at least, in one byte for each value of those bits.
    """
    n, out, least = len(hashes), [], 0
    mixed = _mix(hashes ^ np.uint64(0x9E3779B97F4A7C15))
    for number, k, d in meetings(n, percent):
        if d == 0:
            continue
        fragment = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
        own = fragment[first]
        shared = len(own) - d
        made = [_mix(np.add.reduceat(mixed, first) ^ _mix(own + np.uint64(number << 40)))]
        if shared < 1:  # so many empty fragments that only these may agree
            shared = k - d
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), own)
            made.append(_mix(_mix(empty + np.uint64(number << 40)) ^ np.uint64(1)))
        out += [m & ~np.uint64(3) | np.uint64(number % 4) for m in made]
        least |= min(shared, 255) << 8 * (number % 4)
    return (np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)), int(np.uint32(least).astype(np.int32))


def described(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(x, _id, t, n, k1, k2, sigs, need): each row's number, its text's hash, and its set's size, class and signatures.

    Only the first row of a class in each partition has signatures, so copies
    are left out before anything is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = Words(), set()
        for batch in batches:
            rows, held = [], 0
            for i, t, text in zip(batch["_id"], batch["t"], batch["_text"]):
                own = shingles(text, size, words)
                key = class_key(own)
                sigs, need = None, 0
                if len(own) and key not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    sigs, need = signatures(own, percent)
                    held += len(sigs)
                rows.append((i, t, len(own), *key, sigs, need))
                if held > 200_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    names = ["_id", "t", "n", "k1", "k2", "sigs", "need"]
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("t"), text.alias("_text"))
    return own.mapInPandas(run, f"_id {kind}, t long, n long, k1 long, k2 long, sigs array<long>, need int").withColumn("x", F.monotonically_increasing_id())


def classes(rows: DataFrame) -> DataFrame:
    """(x, _id, t, n, need, c): rows (as described) with their class, which is named by its least row."""
    firsts = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("x").alias("c"))
    return rows.drop("sigs").join(firsts, ["k1", "k2"], "left").drop("k1", "k2")


def blocks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(block, c, n): classes that agree on a fragment; blocks of the same members are one.

    Signatures are counted first (combined before the shuffle), then joined to
    the rows that have them; the join's side of rows can be split, however many
    rows share a signature.
    """
    sigs = rows.filter("sigs IS NOT NULL").select("x", F.explode("sigs").alias("sig"))
    met = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("sig")
    found = sigs.join(met.hint("shuffle_hash"), "sig").join(nodes.select("x", "c", "n", "need"), "x").select("sig", "c", "n", "need").distinct()
    found = write_shared(found.withColumn("w", F.col("sig").bitwiseAND(F.lit(3))), "signatures")
    # a class stays if it shares as many signatures as it must share with any similar one
    met = found.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("sig")
    enough = found.join(met, "sig").groupBy("c", "need", "w").agg(F.count(F.lit(1)).alias("k"))
    enough = enough.filter(F.expr("k >= (shiftright(need, cast(8 * w as int)) & 255)")).select("c", "w")
    held = write_shared(found.join(enough, ["c", "w"], "left_semi").select("sig", "c", "n"), "signatures")
    of = held.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("of")).filter("m > 1")
    of = of.select("sig", F.xxhash64("of", "m").alias("block"))
    out = write_shared(held.join(of, "sig").select("block", "c", "n").distinct(), "blocks")
    drop_shared(found, held)
    return out


def fragments(docs: DataFrame, wanted: DataFrame, size: int, text_col: str) -> DataFrame:
    """(c, part, grams): the n-grams of the wanted classes (c, t, k1, k2), cut into PARTS.

    A bitmap of text hashes, of fixed size, tells which texts needn't be read
    again; once in each partition the others are cut, so copies take part once.
    """
    place = F.pmod("t", F.lit(BITMAP))
    bits = wanted.groupBy(F.floor(place / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))).alias("bits"))
    bitmap = np.zeros(BITMAP // 32, np.uint32)
    for row in bits.collect():  # BITMAP / 32 rows at most
        bitmap[row["word"]] = row["bits"]
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen, keep = Words(), set(), held.value
        for batch in batches:
            rows = []
            at = batch["t"].to_numpy() % BITMAP
            for i in np.flatnonzero(keep[at // 32] >> (at % 32).astype(np.uint32) & 1):
                own = shingles(batch["_text"].iat[i], size, words)
                key = class_key(own)
                if not len(own) or key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                cuts = np.searchsorted(own, (np.arange(1, PARTS, dtype=np.uint64) << np.uint64(61)))
                rows.extend((*key, k, part.astype(np.int64)) for k, part in enumerate(np.split(own, cuts)) if len(part))
                if len(rows) > 2_000:
                    yield pd.DataFrame(rows, columns=["k1", "k2", "part", "grams"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["k1", "k2", "part", "grams"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("t"), text.alias("_text")).mapInPandas(run, "k1 long, k2 long, part int, grams array<long>")
    rows = rows.join(wanted.select("c", "k1", "k2"), ["k1", "k2"])
    return rows.groupBy("c", "part").agg(F.first("grams").alias("grams"))


def overlaps(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """pairs (a, na, b, nb) with common (n-grams) and linked: partial overlaps by fragment, summed per pair."""
    left = grams.select(F.col("c").alias("a"), "part", F.col("grams").alias("ga"))
    right = grams.select(F.col("c").alias("b"), "part", F.col("grams").alias("gb"))
    met = pairs.join(left, "a").join(right, ["b", "part"])
    counts = met.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("common"))
    out = pairs.join(counts, ["a", "b"], "left").fillna(0, ["common"])
    return out.withColumn("linked", 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))


def components(edges: DataFrame) -> DataFrame:
    """(c, label): the least class reachable over the edges (a, b), for each class that has an edge.

    Large-star and small-star steps in turn; each step's edges are written to
    the shared folder.
    """
    now = write_shared(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(floor.select("u", F.col("m").alias("v")))
        new = write_shared(small.filter("u != v").distinct(), "edges")
        got = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_shared(now)
        now = new
        if got == state:
            break
        state = got
    labels = now.select(F.col("u").alias("c"), F.col("v").alias("label"))
    out = write_shared(labels.unionAll(now.select(F.col("v").alias("c"), F.col("v").alias("label")).distinct()), "labels")
    drop_shared(now)
    return out


def open_pairs(members: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(a, na, b, nb): the pairs of a leader's members that may link and aren't in one component.

    members: (lead, x, n, e, m, label, at_lead) of blocks with such pairs, with e =
    n-grams that x has and the leader lacks, m = those that it lacks.  A and B differ in
    |Ea ^ Eb| + |Ma ^ Mb| n-grams, which must be d at most; so they share at least
    (ea + eb + |ma - mb| - d) / 2 of what they have beyond the leader.  Pairs for
    which that isn't positive are found by the numbers alone, the others by what
    they share.  Members linked with the leader are in one component, so one of
    a pair is an outer member; n-grams of the same members count as one.
    """
    numbers = ["lead", "n", "e", "m"]
    side = lambda df, k: df.select("lead", *[F.col(c).alias(f"{c}{k}") for c in df.columns if c != "lead"])
    d = (100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent)
    need = F.col("ea") + F.col("eb") + F.abs(F.col("ma") - F.col("mb")) - d
    similar = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    outer = members.filter(~F.col("at_lead")).drop("at_lead")
    others = members.drop("at_lead")
    # a leader's members have few different numbers, however many they are
    profiles = members.groupBy(*numbers).agg(F.count(F.lit(1)).alias("k"))
    itself = (F.col("na") == F.col("nb")) & (F.col("ea") == F.col("eb")) & (F.col("ma") == F.col("mb")) & (F.col("kb") == 1)
    met = side(outer.select(*numbers).distinct(), "a").join(side(profiles, "b"), "lead").filter(similar & (need <= 0) & ~itself).drop("kb")
    columns = ["xa", "na", "xb", "nb"]
    by_number = side(outer, "a").join(met, ["lead", "na", "ea", "ma"]).join(side(others, "b"), ["lead", "nb", "eb", "mb"]).filter("labela != labelb").select(*columns)
    own = members.select("lead", "x").join(grams.select(F.col("c").alias("x"), "part", "grams"), "x")
    theirs = grams.select(F.col("c").alias("lead"), "part", F.col("grams").alias("led"))
    extra = own.join(theirs, ["lead", "part"], "left").select("lead", "x", F.explode(F.array_except("grams", F.coalesce("led", F.array().cast("array<long>")))).alias("gram"))
    extra = write_shared(extra, "extra")
    alike = extra.groupBy("lead", "gram").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("x").cast("decimal(20,0)")).alias("of")).filter("k > 1")
    alike = alike.withColumn("of", F.xxhash64("of", "k"))
    sets = extra.join(alike.select("lead", "gram", "of"), ["lead", "gram"]).groupBy("lead", "of", "x").agg(F.count(F.lit(1)).alias("w"))
    kept = write_shared(sets, "shared")
    sums = kept.groupBy("lead", "x").agg(F.sum("w").alias("s"))
    sets = kept.join(sums, ["lead", "x"])
    left, right = side(sets.join(outer, ["lead", "x"]).withColumnRenamed("of", "lead_of"), "a"), side(sets.join(others, ["lead", "x"]).withColumnRenamed("of", "lead_of"), "b")
    # they can share no more than what each has in common with anyone
    may = similar & (F.col("labela") != F.col("labelb")) & (need <= 2 * F.least("sa", "sb"))
    shared = left.join(right, (left["lead"] == right["lead"]) & (F.col("lead_ofa") == F.col("lead_ofb")) & may).drop(right["lead"])
    by_share = shared.groupBy("lead", *columns, "ea", "eb", "ma", "mb").agg(F.sum("wa").alias("shared")).filter(need <= 2 * F.col("shared")).select(*columns)
    pairs = by_number.unionAll(by_share).filter(similar).select(F.col("xa").alias("a"), "na", F.col("xb").alias("b"), "nb")
    low = F.col("a") < F.col("b")
    out = pairs.select(F.least("a", "b").alias("a"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
    out = write_shared(out, "pairs")
    drop_shared(extra, kept)
    return out


def links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, *, size: int = 4, percent: int = 85, text_col: str = "text") -> DataFrame:
    """(c, label): the least class reachable by links, for each class (of rows and nodes, as described) that has one."""
    held = blocks(rows, nodes)
    sized = held.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    central = held.join(sized, "block").groupBy("c").agg(F.sum("members").alias("central"))
    wanted = rows.select("t", "k1", "k2", F.col("x").alias("c")).join(central.select("c"), "c", "left_semi")
    grams = write_shared(fragments(docs, wanted, size, text_col), "fragments")
    lead = held.join(central, "c").groupBy("block").agg(F.max(F.struct("central", "n", F.col("c").alias("a"))).alias("l")).select("block", F.col("l.a").alias("a"), F.col("l.n").alias("na"))
    members = write_shared(held.join(lead, "block").filter("a != c").select("block", "a", "na", F.col("c").alias("b"), F.col("n").alias("nb")), "members")
    drop_shared(held)
    tested = write_shared(overlaps(members.drop("block").distinct(), grams, percent), "tested")
    near = components(tested.filter("linked"))
    label = lambda df, c, out: df.join(near.select(F.col("c").alias(c), F.col("label").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))
    # pairs are left in blocks that have two members or more beside the leader, not all in one component
    inside = label(label(members, "b", "labelb"), "a", "labela")
    left = inside.groupBy("block").agg(F.min("labelb").alias("least"), F.max("labelb").alias("most")).filter("least != most").select("block")
    inside = inside.join(left, "block").select("a", "b", F.col("labelb").alias("label"), (F.col("labela") == F.col("labelb")).alias("at_lead")).distinct()
    numbers = tested.select("a", "b", F.col("nb").alias("n"), (F.col("nb") - F.col("common")).alias("e"), (F.col("na") - F.col("common")).alias("m"))
    stars = write_shared(inside.join(numbers, ["a", "b"]).withColumnsRenamed({"a": "lead", "b": "x"}), "stars")
    drop_shared(members, near)
    rest = open_pairs(stars, grams, percent)
    found = tested.select("a", "b", "linked").unionAll(overlaps(rest, grams, percent).select("a", "b", "linked")).filter("linked").select("a", "b")
    found = write_shared(found, "links")
    drop_shared(stars, rest, grams, tested)
    out = components(found)
    drop_shared(found)
    return out


def near_duplicates(docs: DataFrame, *, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, n_shingles and component_id, the least id reachable by links.

    Two documents link when 100 * common >= percent * all of their distinct runs
    of ``size`` words (a shorter text is one run).  A text without words (null,
    empty, white space) links with nothing and is its own component; rows that
    repeat get equal results; an empty table gives an empty one; other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    rows = write_shared(described(docs, size, percent, id_col, text_col), "described")
    nodes = write_shared(classes(rows), "classes")
    labels = links(docs, nodes, rows, size=size, percent=percent, text_col=text_col)
    drop_shared(rows)
    firsts = nodes.filter("n > 0").groupBy("c").agg(F.min("_id").alias("first"))
    labelled = firsts.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = labelled.groupBy("label").agg(F.min("first").alias("least"))
    of_class = labelled.join(least, "label").select("c", "least")
    out = nodes.join(of_class, "c", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "_id")).otherwise(F.col("_id")).alias("component_id"))
