"""Secret scan with a random forest against false positives.

Patterns propose candidates: known key formats, values assigned to names that
sound secret, and long tokens of mixed characters.  A forest on the candidate's
length, its character transitions, how much of it dictionary words cover, the
path (source) it was found in and the words around it tells real credentials
from placeholders, digests and identifiers.  It is trained on labelled findings.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.candidates import Generator, char_class, last_word_in, located, number_rows, proposals
from quillspark.llm.common import write_shared
from quillspark.llm.trees import Ensemble, forest, threshold

GENERATORS = [
    Generator("cloud key", "cloud key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", "A[KS]IA"),
    Generator("service key", "service key", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{20,}+|xox[abp]-[A-Za-z0-9-]{20,}+|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])", "gh[pousr]_|sk_live_|xox[abp]-|AIza"),
    Generator("private key", "private key", r"-----BEGIN (?:(?!PRIVATE )[A-Z0-9]++ )*+PRIVATE KEY(?: BLOCK)?-----", "-----BEGIN"),
    Generator("assigned", "assigned", r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|secret|token|passw(?:or)?d|pwd|auth)\s?[:=]\s?[\x22']?[^\s\x22',;]{8,}+", r"(?i)(?:key|secret|token|passw(?:or)?d|pwd|auth)\s?[:=]"),
    Generator("mixed token", "mixed token", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+", "[A-Za-z0-9_+/=-]{20}"),
]

# Names before a value that speak for and against a secret, parts
# of placeholders, and common words that secrets don't hold.
FOR = ["token", "secret", "password", "passwd", "pwd", "key", "auth", "credential", "bearer", "login"]
AGAINST = ["sha", "md5", "commit", "digest", "hash", "uuid", "checksum", "etag", "revision", "integrity", "example", "session id", "trace"]
PLACEHOLDERS = ["example", "changeme", "your", "dummy", "placeholder", "xxxx", "1234567", "abcdef", "redacted", "insert", "todo", "sample", "test", "none", "null", "process.env", "getenv", "\\$\\{", "<", "\\*\\*\\*"]
WORDS = ["password", "secret", "token", "value", "string", "config", "name", "user", "admin", "default", "system", "service", "public", "private", "the", "and", "this", "that", "with", "here", "data", "file", "path", "key", "index", "number", "function", "return", "class", "version", "document", "content", "section", "license", "general", "under"]
PATHS_AGAINST = ["test", "spec", "example", "fixture", "mock", "doc", "readme", "sample"]


def value_of(hit: Column) -> Column:
    """What is assigned, without its name and quote; else the hit itself."""
    return F.regexp_replace(hit, r"(?i)^(?:api[_-]?key|secret|token|passw(?:or)?d|pwd|auth)\s?[:=]\s?[\x22']?", "")


def transitions(value: Column) -> Column:
    """How often the class of characters (lower, upper, digit, other) changes along the value."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]+", "."), "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "c")
    return F.length(F.regexp_replace(classes, "c", "0")) - 1


def features(spans: DataFrame, path_col: str) -> tuple[DataFrame, list[str]]:
    """spans (g, before, hit, after, path_col) with integer features f0, f1, ..."""
    spans = spans.withColumn("_value", value_of(F.col("hit"))).withColumn("_length", F.length("_value"))
    v, n = F.col("_value"), F.greatest(F.col("_length"), F.lit(1))
    covered = n - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(WORDS, key=len, reverse=True)), ""))
    distinct = F.size(F.array_distinct(F.split(v, "(?!^)")))
    path = F.lower(F.coalesce(F.col(path_col).cast("string"), F.lit("")))
    made = [
        F.col("g"),
        F.least(n / 4, F.lit(16)),
        F.least(10 * transitions(v) / n, F.lit(9)),
        F.least(10 * covered / n, F.lit(10)),
        F.least(8 * distinct / F.least(n, F.lit(32)), F.lit(8)),
        v.rlike("^[0-9a-f]+$").cast("int") + v.rlike("^[0-9A-Fa-f-]{36}$").cast("int") * 2,
        v.rlike("^[A-Za-z]+$").cast("int") + v.rlike("^[0-9]+$").cast("int") * 2,
        v.rlike("(?i)" + "|".join(PLACEHOLDERS)).cast("int"),
        (last_word_in(F.col("before"), FOR) | last_word_in(F.col("hit"), FOR)).cast("int"),
        last_word_in(F.col("before"), AGAINST).cast("int"),
        path.rlike("|".join(PATHS_AGAINST)).cast("int"),
        char_class(F.right("before", F.lit(1))),
    ]
    names = [f"f{i}" for i in range(len(made))]
    return spans.withColumns({k: F.coalesce(c.cast("int"), F.lit(0)) for k, c in zip(names, made)}), names


def labelled_findings(n: int = 2400, seed: int = 23) -> list[tuple[int, str, str, int]]:
    """Findings (id, text, path, is it a secret), made by rule after what reviews of scans call true and false."""
    rng = random.Random(seed)
    take = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: take("aeioulnrst", rng.randrange(3, 9))
    value = lambda: rng.choice([lambda: take(num + "abcdef", rng.choice([16, 18, 20, 24, 32, 40])), lambda: take(low + up + num, rng.randrange(12, 44)), lambda: take(low + up + num + "!@#$%^&*_+-", rng.randrange(10, 30))])()
    real = [
        lambda: "AKIA" + take(up + "234567", 16),
        lambda: "ghp_" + take(low + up + num, 36),
        lambda: "sk_live_" + take(low + up + num, 24),
        lambda: f'{rng.choice(["token", "api_key", "secret", "auth"])} = "{value()}"',
        lambda: f'{rng.choice(["password", "passwd", "pwd"])}={value()}',
        lambda: f"bearer {take(low + up + num, rng.randrange(24, 60))}",
        lambda: "-----BEGIN RSA PRIVATE KEY-----",
    ]
    false = [
        lambda: "AKIA" + rng.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "YOURKEYEXAMPLE12"]),
        lambda: f'{rng.choice(["token", "secret", "password"])} = "{rng.choice(["changeme", "your_token_here", "xxxxxxxxxxxx", "example_value", "<insert-here>", "${SECRET_KEY}", "process.env.TOKEN"])}"',
        lambda: f"password={word()}{word()}",
        lambda: f"{rng.choice(['commit', 'sha', 'md5', 'digest', 'etag', 'checksum'])} {take(num + 'abcdef', rng.choice([32, 40, 64]))}",
        lambda: f"uuid {take(num + 'abcdef', 8)}-{take(num + 'abcdef', 4)}-{take(num + 'abcdef', 4)}-{take(num + 'abcdef', 4)}-{take(num + 'abcdef', 12)}",
        lambda: f"{word()}-{word()}-{word()}-{word()}-{take(num, 2)}",
        lambda: f"secret: {rng.choice(['default', 'function', 'configuration', 'undefined'])}",
        lambda: f"{rng.choice(['section', 'value', 'index', 'default'])}_{rng.choice(['name', 'number', 'content', 'version'])}_{take(num, rng.randrange(8, 14))}",
    ]
    out = []
    for i in range(n):
        yes = rng.random() < 0.5
        path = rng.choice(["src", "app", "deploy", "conf", "src", "tests/fixtures", "docs"] if yes else ["tests", "docs/example", "src", "app", "sample", "conf"]) + f"/{word()}"
        out.append((i, f"{word()} {word()} {rng.choice(real if yes else false)()} {word()}", path, int(yes)))
    return out


@lru_cache(maxsize=4)
def _trained(rows: tuple, precision: float) -> tuple[Ensemble, float, float]:
    model = forest([(x, y, w) for x, y, w, held in rows if not held])
    held = [(model.predict(x), y, w) for x, y, w, h in rows if h]
    limit = min(threshold(held, precision), 0.95)
    right = sum(w for s, y, w in held if (s >= limit) == bool(y)) / max(1.0, sum(w for *_, w in held))
    return model, limit, right


def train(spark, precision: float = 0.97) -> tuple[Ensemble, float, float]:
    """The forest, the score from which on precision holds on held-out findings, and the accuracy on them."""
    made = spark.createDataFrame([(2 * i + y, text, path) for i, text, path, y in labelled_findings()], "_row long, text string, path string")
    found = write_shared(proposals(made, GENERATORS).select("_row", "path", "_found"), "secret-examples")
    spans, names = features(located(found, ["_row", "path"]), "path")
    spans = spans.select((F.col("_row") % 2).cast("int").alias("y"), (F.floor(F.col("_row") / 2) % 3 == 0).alias("held"), *names)
    counted = spans.groupBy("y", "held", *names).agg(F.count(F.lit(1)).alias("w")).collect()
    return _trained(tuple(sorted((tuple(r[n] for n in names), r["y"], float(r["w"]), r["held"]) for r in counted)), precision)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", precision: float = 0.97) -> DataFrame:
    """A row for each finding: id_col, kind, start, end, value, probability, is_secret.

    Every candidate of every whole text is returned; ``is_secret`` says whether
    the forest lets it pass.  Offsets count code points, end is exclusive.  Where
    one candidate lies within another of a more specific generator, the latter
    stands for both.  Null and empty texts have none; equal rows are kept apart;
    a null path counts as empty; an empty table gives an empty one; other columns
    are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_path"), F.col(text_col).alias("_text"))
    found = proposals(number_rows(narrow), GENERATORS, "_text").drop("_text").filter(F.size("_found") > 0)
    found = write_shared(found, "secrets")
    spans = located(found, ["_row", "_id", "_path"])
    other = spans.select(F.col("_row").alias("_r"), F.col("g").alias("_g"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    spans = spans.join(other, (F.col("_row") == F.col("_r")) & (F.col("_g") < F.col("g")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    model, limit, _ = train(spark, precision)
    # written, lest the optimiser put the features' expressions into every node of every tree
    spans, names = features(spans, "_path")
    spans = write_shared(spans.select("_id", "g", "start", "end", "_value", *names), "secret-spans")
    kind = F.element_at(F.array(*[F.lit(g.kind) for g in GENERATORS]), F.col("g") + 1)
    return spans.select(
        F.col("_id").alias(id_col),
        kind.alias("kind"),
        "start",
        "end",
        F.col("_value").alias("value"),
        F.round(model.column(names), 9).alias("probability"),
    ).withColumn("is_secret", F.col("probability") >= limit)
