"""Toxic passages by maximum-scoring segments.

Tokens (words and their beginnings) get log-odds of occurring in toxic rather
than clean documents, under an informative Dirichlet prior; what counts is the
bound that the log-odds surpass with confidence, and a word takes the weight of
the most specific of its tokens that is known.  A linear scan finds all
maximal-scoring segments of a document (Ruzzo and Tompa), which are then scored
with repeats of a word damped; the score that chance segments of clean documents reach
follows an extreme-value law, E = K n exp(-L s) for n tokens, which turns each
segment into a p-value.  The evidence of a document's significant segments is
added up and calibrated to a probability.  Law and calibration are fitted to
scores that documents get from the log-odds of the other half of the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_shared, small_batches, write_shared

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are tokens too.
STEMS = (3, 4, 5, 6, 7, 8, 9)
#: A segment counts if chance gives its like to fewer than this share of clean documents.
SIGNIFICANT = 0.05


@dataclass
class ToxicityModel:
    """weights: (log-odds, z-score) by token; drift: what any other token adds; rate and k: the extreme-value law."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    drift: float = -0.2
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = -20.0

    def weight(self, word: str) -> float:
        return next((self.weights[t][0] for t in tokens(word) if t in self.weights), self.drift)

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-self.k * n * math.exp(-self.rate * score))

    def probability(self, evidence: float) -> float:
        x = self.slope * evidence + self.bias
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def tokens(word: str) -> list[str]:
    """The word and its beginnings, the most specific first."""
    return [word, *(word[:n] + "*" for n in reversed(STEMS) if len(word) > n)]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum up to its end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, low, total))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def damped(words: list[str], scores: list[float], seen: Counter) -> float:
    """A segment's score in which each repeat of a word counts half of the one before; ``seen``: how often it came so far.

    A word that a text repeats line after line would else outweigh any passage.
    """
    total = best = 0.0
    for word, s in zip(words, scores):
        if s > 0:
            s *= 0.5 ** seen[word]
            seen[word] += 1
            best = max(best, s)
        total += s
    return max(total, best)


def lowered(text: str) -> str:
    """The text in lower case, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Scorer:
    """Scores texts with one model; remembers the weights of words."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of words, and the maximal segments as (start, end, score, fresh) in characters.

        Repeats are damped within the segment for its score, and over the text up
        to its end for ``fresh``, what it adds to the evidence.
        """
        known, weight = self.known, self.model.weight
        low = lowered(text)
        words = WORD.findall(low)
        for w in set(words).difference(known):
            known[w] = weight(w)
        scores = [known[w] for w in words]
        if len(known) > 250_000:
            known.clear()
        if not scores or max(scores) <= 0:
            return len(words), []
        found = maximal_segments(scores)
        spans = [m.span() for m in WORD.finditer(low)]
        seen: Counter = Counter()
        return len(words), [(spans[a][0], spans[b - 1][1], damped(words[a:b], scores[a:b], Counter()), damped(words[a:b], scores[a:b], seen)) for a, b, _ in found]

    def evidence(self, n: int, segments: list[tuple[int, int, float, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Sum of -ln p over the segments that are significant for what is fresh in them (else that of the best one), and the significant segments."""
        p = lambda score: max(self.model.p_value(score, n), 1e-300)
        adds = [-math.log(p(fresh)) for *_, fresh in segments]
        kept = [(a, b, s, q) for a, b, s, _ in segments if (q := p(s)) < SIGNIFICANT]
        return max(max(adds, default=0.0), sum(x for x in adds if x > -math.log(SIGNIFICANT))), kept


def fit_extreme_values(best: list[tuple[int, float]]) -> tuple[float, float]:
    """Maximum-likelihood (rate, k) of E = k n exp(-rate s), from (n, best score) of clean documents."""
    best = [(n, s) for n, s in best if n > 0 and s > 0]
    if len(best) < 20:
        return 1.0, 1.0

    def slope(rate: float) -> float:
        w = [n * math.exp(-rate * s) for n, s in best]
        return len(best) / rate - sum(s for _, s in best) + len(best) * sum(x * s for x, (_, s) in zip(w, best)) / sum(w)

    low, high = 1e-3, 50.0
    for _ in range(60):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    rate = low
    return rate, len(best) / sum(n * math.exp(-rate * s) for n, s in best)


def fit_logistic(evidence: list[float], toxic: list[int], shares: tuple[float, float], ridge: float = 0.01) -> tuple[float, float]:
    """(slope, bias) of P(toxic | evidence), classes weighed to their shares among the labels."""
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    if not n1 or not n0:
        return 0.0, -20.0
    w = [shares[y] * len(toxic) / (n1 if y else n0) for y in toxic]
    x = [math.log1p(e) for e in evidence]
    a, b = 0.0, math.log(shares[1] / shares[0])
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for xi, yi, wi in zip(x, toxic, w):
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, a * xi + b))))
            r, q = wi * (yi - p), wi * p * (1 - p)
            g0 += r
            g1 += r * xi
            h00 += q
            h01 += q * xi
            h11 += q * xi * xi
        g0, g1 = g0 - ridge * b, g1 - ridge * a
        h00, h11 = h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a + da / size, b + db / size
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def log_odds(y1: Column, y0: Column, n1: float, n0: float, prior: float) -> tuple[Column, Column]:
    """Log-odds ratio of a token between the classes under the Dirichlet prior, and its z-score.

    The prior is the corpus itself at ``prior`` times its weight, so a token
    unseen in one class is shrunk the more, the rarer it is.
    """
    rate = (y1 + y0) / (n1 + n0)
    a1, a0 = prior * n1 * rate, prior * n0 * rate
    odds = lambda y, a, n: F.log((y + a) / F.greatest(F.lit(0.5), n * (1 + prior) - y - a))
    delta = odds(y1, a1, n1) - odds(y0, a0, n0)
    return delta, delta / F.sqrt(1 / (y1 + a1) + 1 / (y0 + a0))


def token_weights(words: DataFrame, n1: int, n0: int, prior: float, least_z: float, least_delta: float) -> dict[str, tuple[float, float]]:
    """(log-odds, z-score) of the telling tokens, from words (token, y1, y0: documents of either class that have it)."""
    # a beginning counts words, not documents: "los*" isn't toxic for one frequent word
    stems = F.array(*[F.when(F.length("token") > k, F.concat(F.substring("token", 1, k), F.lit("*"))) for k in STEMS])
    share = (F.col("y1") / n1) / (F.col("y1") / n1 + F.col("y0") / n0)
    stems = words.select(F.explode(F.array_compact(stems)).alias("token"), share.alias("y1"), (1 - share).alias("y0"))
    stems = stems.groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    types = words.agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("y1"), F.coalesce(F.sum(1 - share), F.lit(0.0)).alias("y0")).first()

    def rated(table: DataFrame, n1: float, n0: float) -> DataFrame:
        delta, z = log_odds(F.col("y1"), F.col("y0"), n1, n0, prior)
        return table.withColumns({"delta": delta, "z": z})

    table = rated(words, n1, n0)
    if types["y1"] > 0 and types["y0"] > 0:
        table = table.unionByName(rated(stems, types["y1"], types["y0"]))
    strong = table.filter((F.abs("z") >= least_z) & (F.abs("delta") >= least_delta))
    # |z| - least_z standard errors: what the log-odds surpass with confidence
    bound = F.col("delta") * (1 - least_z / F.abs("z"))
    return {r["token"]: (r["bound"], r["z"]) for r in strong.select("token", "z", bound.alias("bound")).collect()}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_class: int = 8_000,
    prior: float = 0.02,
    least_z: float = 1.65,
    least_delta: float = 1.0,
) -> ToxicityModel:
    """Fit a model on at most ``rows_per_class`` labelled documents of each class, taken in hash order.

    A document labelled twice is toxic if either label says so.  Copies and near
    copies (the same least hash of word pairs) count once.  The driver gets the
    telling tokens of that sample and the segments' scores of its documents.
    """
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in ids.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel()
    order = F.xxhash64("_id")
    picked = ids.filter("_y = 0").orderBy(order, "_id").limit(rows_per_class).unionAll(ids.filter("_y = 1").orderBy(order, "_id").limit(rows_per_class))
    texts = docs.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sample = texts.join(F.broadcast(picked), F.col("_i") == F.col("_id"))  # 2 * rows_per_class rows at most

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zlib import crc32

        for batch in batches:
            sketch = []
            for text in batch["_text"]:
                words = WORD.findall(lowered(text))
                sketch.append(min((crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])), default=crc32(text.encode())))
            yield pd.DataFrame({"sketch": sketch, "y": batch["_y"], "text": batch["_text"]})

    sample = sample.select("_y", "_text").mapInPandas(sketched, "sketch long, y int, text string")
    sample = sample.groupBy("sketch", "y").agg(F.min("text").alias("text"))
    sample = write_shared(sample.select("y", F.pmod(F.xxhash64("sketch"), F.lit(2)).cast("int").alias("half"), "text"), "toxicity-sample")
    n = {(r["y"], r["half"]): r["n"] for r in sample.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda y, halves: sum(n.get((y, h), 0) for h in halves)
    if not size(1, (0, 1)) or not size(0, (0, 1)):
        return ToxicityModel()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], Counter] = {(y, h): Counter() for y in (0, 1) for h in (0, 1)}

        def out() -> pd.DataFrame:
            keys = list(set().union(*seen.values()))
            frame = pd.DataFrame({"token": keys} | {f"y{y}{h}": [c[k] for k in keys] for (y, h), c in seen.items()})
            for c in seen.values():
                c.clear()
            return frame

        for batch in batches:
            for y, half, text in zip(batch["y"], batch["half"], batch["text"]):
                seen[y, half].update(set(WORD.findall(lowered(text))))
                if sum(map(len, seen.values())) > 1_000_000:
                    yield out()
        yield out()

    names = [f"y{y}{h}" for y in (0, 1) for h in (0, 1)]
    words = sample.mapInPandas(counted, "token string, " + ", ".join(f"{c} long" for c in names))
    words = write_shared(words.groupBy("token").agg(*[F.sum(c).cast("double").alias(c) for c in names]), "toxicity-words")

    def learned(halves: tuple[int, ...]) -> dict[str, tuple[float, float]]:
        n1, n0 = size(1, halves), size(0, halves)
        if not n1 or not n0:
            return {}
        sums = [sum((F.col(f"y{y}{h}") for h in halves), F.lit(0.0)).alias(f"y{y}") for y in (1, 0)]
        return token_weights(words.select("token", *sums).filter("y1 + y0 > 0"), n1, n0, prior, least_z, least_delta)

    model = ToxicityModel(learned((0, 1)))
    # the weights that a document is scored with here come from the half that it isn't in
    others = {half: ToxicityModel(learned((1 - half,))) for half in (0, 1)}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = {half: Scorer(m) for half, m in others.items()}
        for batch in batches:
            rows = []
            for y, half, text in zip(batch["y"], batch["half"], batch["text"]):
                words, found = scorers[half].segments(text)
                rows.append((y, words, [fresh for *_, fresh in found]))
            yield pd.DataFrame(rows, columns=["y", "n", "scores"])

    rated = [(r["y"], r["n"], r["scores"]) for r in sample.mapInPandas(best, "y int, n int, scores array<double>").collect()]
    drop_shared(sample, words)
    model.rate, model.k = fit_extreme_values([(words, max(s)) for y, words, s in rated if y == 0 and s])
    scorer = Scorer(model)
    evidence = [scorer.evidence(words, [(0, 0, s, s) for s in scores])[0] for _, words, scores in rated]
    share = counts[1] / (counts[0] + counts[1])
    model.slope, model.bias = fit_logistic(evidence, [y for y, _, _ in rated], (1 - share, share))
    return model


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, with _score and _passages, a row for each row.

    ``_passages``: the significant segments (start, end, score, p) in characters.
    Null and empty texts have no segment and score as any document without one;
    rows that repeat are scored each; an empty table gives an empty one; columns
    outside ``keep`` are not read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)
    text_name = f"_c{names.index(text_col)}" if text_col in names else "_text"

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for batch in batches:
            scores, passages = [], []
            for text in batch[text_name]:
                n, found = scorer.segments(text or "")
                evidence, kept = scorer.evidence(n, found)
                scores.append(held.value.probability(math.log1p(evidence)))
                passages.append([{"start": a, "end": b, "score": s, "p": p} for a, b, s, p in kept])
            out = batch[[f"_c{i}" for i in range(len(names))]].copy()
            out["_score"], out["_passages"] = scores, passages
            yield out

    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(names)]
    schema = ", ".join([*(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), "_score double", "_passages array<struct<start: int, end: int, score: double, p: double>>"])
    if text_name == "_text":
        columns.append(F.col(text_col).alias("_text"))
    out = docs.select(*columns).mapInPandas(scored, schema)
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(names)})
