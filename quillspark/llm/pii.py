"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap.  Base kinds (email, ip,
card, phone) are decided by their format alone and stay.  What other generators
propose (obfuscated mail addresses, national telephone numbers, account and
identity numbers) is scored by boosted trees on features of format and context;
thresholds calibrated on held-out examples select the spans that are added.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.candidates import Generator, char_class, last_word_in, located, number_rows, proposals
from quillspark.llm.common import write_shared
from quillspark.llm.trees import Ensemble, boost, threshold

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]

# The contract's patterns.  They begin where a run begins or the last match ended
# (\G): no match can begin within a run whose beginning doesn't match.  Possessive
# loops match what greedy ones do, as what follows is never in the loop's class,
# and don't recurse, so long runs neither overflow the stack nor take square time.
BASE = [
    Generator("email", "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", "ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]"),
    Generator("card", "card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    Generator("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+"),
]
# No loop has an upper bound that could cut a span, except where the format itself has one.
MORE = [
    Generator("email", "spelled email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++", r"(?i)[(\[]at[)\]]"),
    Generator("phone", "national phone", r"(?<![0-9+.-])(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,5}[ ./-])[0-9]{2,5}(?:[ .-][0-9]{2,5}(?![0-9]))++(?![.-]?[0-9])", "[0-9]{2}"),
    Generator("iban", "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    Generator("ssn", "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]"),
]
GENERATORS = BASE + MORE

# Words near a span that speak for or against personal data.
FOR = ["phone", "tel", "call", "mobile", "fax", "whatsapp", "mail", "contact", "iban", "account", "konto", "ssn", "social security", "telefon", "appel", "llame"]
AGAINST = ["version", "release", "isbn", "order", "invoice", "serial", "part", "lot", "build", "page", "figure", "section", "range", "score", "total", "sku"]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Remainder of an account number's check (ISO 7064): the first four characters go to the end, letters count from 10."""
    a = F.upper(F.regexp_replace(account, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(a, 5, 1 << 30), F.left(a, F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.when(digit, rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add)


def base_valid(g: Column, hit: Column) -> Column:
    """Is a match of a base generator (by its place in BASE) a finding?"""
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    d = digits(hit)
    count = F.length(d)
    card = F.when(count.between(14, 19), luhn(d)).otherwise(False)
    return F.when(g == 0, True).when(g == 1, hit.rlike(rf"^{part}(?:\.{part}){{3}}$")).when(g == 2, card).otherwise(count.between(10, 15))


def features(spans: DataFrame) -> tuple[DataFrame, list[str]]:
    """spans (g, before, hit, after) with integer features f0, f1, ..."""
    d = digits(F.col("hit"))
    first, last = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    made = [
        F.col("g") - len(BASE),
        F.least(F.length(d), F.lit(20)).cast("int"),
        F.least(F.length(F.regexp_replace("hit", "[^ ]", "")), F.lit(6)).cast("int"),
        F.least(F.length(F.regexp_replace("hit", "[^.-]", "")), F.lit(4)).cast("int"),
        F.col("hit").contains("(").cast("int"),
        (F.length(F.regexp_replace(d, "^(.)\\1*", "")) == 0).cast("int"),
        last_word_in(F.col("before"), FOR).cast("int"),
        last_word_in(F.col("before"), AGAINST).cast("int"),
        char_class(first),
        char_class(last),
        F.col("hit").rlike("^(?:000|666|9[0-9][0-9])-|-00-|-0000$").cast("int"),
        F.col("before").rlike(r"[#$€£=%/]\s?$").cast("int"),
        F.when(F.col("g") == GENERATORS.index(MORE[2]), F.when(mod97(F.col("hit")) == 1, 2).otherwise(1)).otherwise(0),
        F.least(F.size(F.split("hit", "[^0-9]+")), F.lit(9)).cast("int"),
        F.col("hit").rlike(r"\. ").cast("int"),
    ]
    names = [f"f{i}" for i in range(len(made))]
    return spans.withColumns({n: c.cast("int") for n, c in zip(names, made)}), names


def examples(n: int = 4000, seed: int = 11) -> list[tuple[int, str, int]]:
    """Labelled snippets (id, text, is the last span personal), made by rule: what people and programs write."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9)))

    def account(country: str, rest: str) -> str:
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        return f"{country}{check:02d}{rest}"

    fours = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    real = [
        lambda: f"{word()}.{word()} (at) {word()}.com",
        lambda: f"{word()}[at]{word()}[dot]org",
        lambda: f"({rng.randrange(200, 999)}) {num(3)}-{num(4)}",
        lambda: f"{rng.randrange(200, 999)}-{num(3)}-{num(4)}",
        lambda: f"0{num(3)} {num(3)} {num(4)}",
        lambda: f"0{num(2)} {num(3)} {num(4)} {num(4)}",
        lambda: fours(account("DE", num(18))),
        lambda: account("FR", num(20) + rng.choice("ABC") + num(2)),
        lambda: account("GB", "".join(rng.choice("ABCDKLMNW") for _ in range(4)) + num(14)),
        lambda: f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
    ]
    false = [
        lambda: f"{num(3)}.{num(3)}.{num(4)}",
        lambda: f"{rng.randrange(10, 99)}/{num(3)}-{num(3)}",
        lambda: f"{num(5)} {num(4)} {num(5)}",
        lambda: f"000-{num(2)}-{num(4)}",
        lambda: f"{rng.randrange(900, 999)}-{num(2)}-0000",
        lambda: f"111 1111-1111",
        lambda: f"AB{num(2)}{''.join(rng.choice('ABCDEFGH0123') for _ in range(12))}",
        lambda: f"{num(3)}-{num(3)}-{num(3)}",
        lambda: f"{rng.choice(['DE', 'FR', 'GB', 'XK', 'PN'])}{num(2)}{''.join(rng.choice('0123456789ABCDEFGHKLMNPRST') for _ in range(rng.choice([12, 16, 18, 20])))}",
        lambda: fours(f"{rng.choice(['DE', 'IT', 'QX'])}{num(2)}{num(18)}"),
        lambda: " ".join(num(rng.choice([2, 3, 3, 4])) for _ in range(rng.randrange(3, 9))),
        lambda: f"{rng.randrange(10, 32)}-{rng.randrange(10, 13)}-{num(4)}",
        lambda: f"{num(2)}.{num(2)}.{num(4)}",
        lambda: f"{word()} [at] {word()}. {num(1)}",
        lambda: f"{word()} (at) {word()}. {word().title()}",
    ]
    out = []
    for i in range(n):
        yes = rng.random() < 0.5
        span = rng.choice(real if yes else false)()
        cue = rng.random()
        if yes:
            lead = rng.choice(FOR) + rng.choice([" ", ": "]) if cue < 0.5 else word() + " "
        else:
            lead = rng.choice(AGAINST) + rng.choice([" ", " #", ": "]) if cue < 0.7 else word() + rng.choice([" ", " #", "=", "/"])
        out.append((i, f"{word()} {lead}{span}{rng.choice(['', ' ', '. ', ', '] if yes else ['', ' ', '%', 'x ', ', '])}{word() if rng.random() < 0.5 else ''}", int(yes)))
    return out


@lru_cache(maxsize=4)
def _trained(rows: tuple, precision: float) -> tuple[Ensemble, tuple[float, ...]]:
    train = [(x, y, w) for x, y, w, held, _ in rows if not held]
    model = boost(train)
    limits = []
    for k in range(len(MORE)):
        held = [(model.predict(x), y, w) for x, y, w, h, g in rows if h and g == k]
        limit = threshold(held, precision)
        # no span that is likelier not personal; where held-out examples never go wrong, 0.9 is enough
        limits.append(limit if limit > 1 else min(0.9, max(0.5, limit)))
    return model, tuple(limits)


def train(spark, precision: float = 0.95) -> tuple[Ensemble, tuple[float, ...]]:
    """Boosted trees, and for each generator of MORE the score from which on precision holds on held-out examples."""
    made = spark.createDataFrame([(2 * i + y, text) for i, text, y in examples()], "_row long, text string")
    found = write_shared(proposals(made, GENERATORS).select("_row", "_found"), "pii-examples")
    spans, names = features(located(found))
    spans = spans.select("g", (F.col("_row") % 2).cast("int").alias("y"), (F.floor(F.col("_row") / 2) % 3 == 0).alias("held"), *names)
    counted = spans.groupBy("g", "y", "held", *names).agg(F.count(F.lit(1)).alias("w")).collect()
    rows = sorted((tuple(r[n] for n in names), r["y"], float(r["w"]), r["held"], r[names[0]]) for r in counted if r["g"] >= len(BASE))
    return _trained(tuple(rows), precision)


def find_pii(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), precision: float = 0.95) -> DataFrame:
    """The columns ``keep`` of docs, with _base and _spans, a row for each row.

    Both are arrays of (start, order, end, kind), sorted; offsets count code
    points and end is exclusive.  ``_base`` has the base kinds' findings;
    ``_spans`` adds what the trees select, best score first (ties: the earlier
    start), unless it overlaps a base finding or an added span that stays.  Null and empty texts have none; equal rows are kept
    apart; an empty table gives an empty one; columns outside ``keep`` are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    found = proposals(number_rows(narrow), GENERATORS, "_text").drop("_text")
    found = write_shared(found, "pii")
    spans = located(found.select("_row", "_found"))
    is_base = F.col("g") < len(BASE)
    spans = spans.withColumn("_is_base", is_base).filter(~is_base | base_valid(F.col("g"), F.col("hit")))
    model, limits = train(spark, precision)
    # written, lest the optimiser put the features' expressions into every node of every tree
    spans, names = features(spans)
    spans = write_shared(spans.select("_row", "g", "start", "end", "_is_base", *names), "pii-spans")
    is_base = F.col("_is_base")
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in limits]), F.col("g") - len(BASE) + 1)
    spans = spans.withColumn("_p", F.when(is_base, F.lit(2.0)).otherwise(model.column(names)))
    spans = spans.filter(is_base | (F.col("_p") >= F.when(is_base, 0.0).otherwise(limit)))
    kind = F.element_at(F.array(*[F.lit(g.kind) for g in GENERATORS]), F.col("g") + 1)
    order = F.element_at(F.array(*[F.lit(KINDS.index(g.kind)) for g in GENERATORS]), F.col("g") + 1)
    # An added span gives way to any base span that it overlaps, and to a better added one.
    spans = spans.withColumns({"kind": kind, "order": order})
    base = spans.filter("_is_base").select(F.col("_row").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    more = spans.filter("NOT _is_base").join(base, (F.col("_row") == F.col("_r")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    # Spans that touch each other, directly or by others, form a chain; within one, the better-scored are taken first.
    upto = Window.partitionBy("_row").orderBy("start", "end", "order")
    reach = F.max("end").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    more = more.withColumn("_new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("long"))
    more = more.withColumn("_chain", F.sum("_new").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_p")).alias("p"), "start", "order", "end", "kind")))
    apart = lambda kept, s: F.forall(kept, lambda k: (k["end"] <= s["start"]) | (s["end"] <= k["start"]))
    none = F.array().cast("array<struct<p: double, start: bigint, order: int, end: bigint, kind: string>>")
    chains = more.groupBy("_row", "_chain").agg(ranked.alias("_ranked"))
    kept = F.aggregate("_ranked", none, lambda kept, s: F.when(apart(kept, s), F.concat(kept, F.array(s))).otherwise(kept))
    more = chains.select("_row", F.explode(kept).alias("s")).select("_row", "s.*", F.lit(False).alias("_is_base"))
    columns = ["_row", "start", "order", "end", "kind", "_is_base"]
    spans = spans.filter("_is_base").select(*columns).unionByName(more.select(*columns))
    item = F.struct("start", "order", "end", "kind")
    by_row = spans.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(F.col("_is_base"), item))).alias("_base"),
        F.array_sort(F.collect_list(item)).alias("_spans"),
    )
    out = found.drop("_found").join(by_row, "_row", "left").drop("_row")
    none = F.array().cast("array<struct<start: bigint, order: int, end: bigint, kind: string>>")
    out = out.withColumns({"_base": F.coalesce("_base", none), "_spans": F.coalesce("_spans", none)})
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(keep)})


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """docs, a row for each row, with every span in text_col replaced by [kind]; null stays null.

    Spans are found and cut out row by row, so rows of equal ids, or none, each
    get their own.  Where base findings of different kinds overlap, what they
    cover is replaced once, by the kind of the first.
    """

    def cut(state: Column, span: Column) -> Column:
        later = span["start"] >= state["at"]
        between = F.substring(state["text"], state["at"] + 1, (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.when(later, F.concat(state["out"], between, F.lit("["), span["kind"], F.lit("]"))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["end"].cast("int")).alias("at"),
            state["text"].alias("text"),
        )

    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    found = find_pii(own, text_col=names[docs.columns.index(text_col)], keep=tuple(names), precision=precision)
    text = F.col(names[docs.columns.index(text_col)])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.coalesce(text, F.lit("")).alias("text"))
    done = F.aggregate("_spans", start, cut, lambda s: F.concat(s["out"], F.substring(s["text"], s["at"] + 1, F.length(s["text"]))))
    return found.select(*[F.when(text.isNotNull(), done).alias(c) if c == text_col else F.col(n).alias(c) for n, c in zip(names, docs.columns)])
