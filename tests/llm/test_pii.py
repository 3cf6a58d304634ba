import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm.pii import KINDS, find_pii, joined, redact, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        if not 14 <= len(digits) <= 19:
            return False
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0
    return True


def brute(text):
    found = []
    for k, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            if passes(k, m.group(0)):
                found.append((m.start(), KINDS.index(k), m.end(), k))
    return sorted(found)


PIECES = ["a@b.c", "a.b@c.d_e@f.g", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0255.1.01.9", "4111 1111 1111 1111", "4111-1111-1111-1111", "5 5 5",
          "+1 (743) 555-3824", "+49 30 1234567 ", "+12", "+1........", "é", "🙂", "日本", " ", "\n", "word", "-", "%", "(", "12345678901234", "00000000000000", "0", "9" * 25, "(663) 555-6869", "me (at) home.com", "DE12 3456 7890 1234 5678 90"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    return [None, "", *["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30))) for _ in range(1500)],
            "9" * 600, "x" * 1000, "a." * 400 + "@", "a@" + "b." * 300 + "c", "1." * 300, "+" + "1 " * 300, "a@b.c " * 400]


def test_base_findings(spark, texts):
    docs = spark.createDataFrame([(i % 1000, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, _spans string").repartition(6)
    got = find_pii(docs, keep=("doc_id", "text")).select("doc_id", "text", joined(F.col("_base")).alias("base"), "_spans", "_base").collect()
    assert len(got) == len(texts)
    for r in got:
        want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(r["text"]))
        assert r["base"] == want, r["text"][:200]
        assert set(r["_base"]) <= set(r["_spans"]) and list(r["_spans"]) == sorted(r["_spans"])


def test_very_long_texts(spark):
    rows = [(1, "9" * 60_000), (2, "x" * 100_000), (3, "a." * 40_000 + "@"), (4, "a@" + "b." * 30_000 + "c"), (5, "1." * 30_000), (6, "+" + "1 " * 30_000), (7, "a@b.c " * 4_000)]
    got = {r["doc_id"]: r["_base"] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[i]) for i in range(1, 8)] == [0, 0, 0, 1, 7500, 0, 4000]
    assert (got[7][-1]["start"], got[7][-1]["end"]) == (23_994, 23_999)


def test_added_spans_and_redaction(spark):
    rows = [(1, "call me: (663) 555-6869 now"), (2, "mail anna.b (at) home.com please"), (3, "version 12 345 67890"), (4, "tel +1 (743) 555-3824."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = find_pii(docs)
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", joined(F.col("_spans")).alias("s")).collect()}
    assert got == {1: "phone:9:23", 2: "email:5:25", 3: "", 4: "phone:4:21", 5: ""}
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert clean[1] == "call me: [phone] now" and clean[4] == "tel [phone]." and clean[3] == rows[2][1] and clean[5] is None


def test_redaction_keeps_rows_apart(spark):
    rows = [(1, "a@b.c x", "s"), (1, "a@b.c x", "s"), (None, "to +49 30 1234567 and 1.2.3.4", None), (None, None, "t"), (2, "", None), (3, "1.2.3.4@b.c.", "u"), (4, "a@b.c " * 3000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string").repartition(4)
    got = redact(docs)
    assert got.columns == docs.columns
    cut = {"a@b.c x": "[email] x", "to +49 30 1234567 and 1.2.3.4": "to [phone] and [ip]", "1.2.3.4@b.c.": "[email].", "a@b.c " * 3000: "[email] " * 3000}
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((a, cut.get(t, t), c)) for a, t, c in rows)


def test_long_values_are_whole(spark):
    name, host = "n" * 5000, "h" * 300 + ".x" * 20
    texts = [f"mail {name}(at){host} now", "tel 030 123 4567 8901 please", "tel (030) 12 34 56 78, thanks"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in find_pii(docs).select("doc_id", joined(F.col("_spans")).alias("s")).collect()}
    assert got == {0: f"email:5:{5 + len(name) + 4 + len(host)}", 1: "phone:4:21", 2: "phone:4:21"}


def test_account_numbers_by_check_digits(spark):
    from quillspark.llm.pii import mod97

    good = ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606", "NL91ABNA0417164300"]
    bad = ["DE88 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 91", "FR1420041010050500013M02607", "NL19ABNA0417164300"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", (mod97(F.col("x")) == 1).alias("ok")).collect()
    assert [r["x"] for r in rows if r["ok"]] == good
    rng = random.Random(4)
    parts = ["AB" + "".join(rng.choice("0123456789") for _ in range(2)) + "".join(rng.choice("ABCDEFGHKLMN0123456789") for _ in range(16)) for _ in range(200)]
    texts = [f"my account {x} is open" for x in good] + [f"part {x} in stock" for x in parts]
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    hits = {r["doc_id"] for r in found.collect() if any(s["kind"] == "iban" for s in r["_spans"])}
    assert {0, 1, 2, 3} <= hits and len(hits) <= 8


def brute_added(spans, base):
    """The rule of selection: best score first, unless it overlaps a base span or one that was taken."""
    taken = []
    for p, start, order, end, kind in sorted(spans, key=lambda s: (-s[0], s[1], s[2], s[3])):
        if all(e <= start or end <= s for s, e in base) and all(t[3] <= start or end <= t[1] for t in taken):
            taken.append((p, start, order, end, kind))
    return sorted((start, order, end, kind) for _, start, order, end, kind in taken)


def test_added_spans_against_brute_force(spark, texts):
    """Candidates by Python's regular expressions and scores from the trained trees must give the same added spans."""
    import regex

    from quillspark.llm.candidates import located, number_rows, proposals
    from quillspark.llm.common import write_shared
    from quillspark.llm.pii import BASE, GENERATORS, MORE, features

    more = ["call (663) 555-6869", "0301 555 1234 ", "123-45-6789", "DE89 3704 0044 0532 0130 00 ", "123 45-6789-1234 ", "me [at] home [dot] org ", "tel 663-555-6869 x", "sku 99 100 2000 "]
    rng = random.Random(3)
    own = [*texts[:300], *["".join(rng.choice(more) for _ in range(rng.randrange(1, 6))) for _ in range(300)]]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(4)
    model, limits = train(spark)
    rows = write_shared(proposals(number_rows(docs.withColumn("_id", F.col("doc_id"))), GENERATORS).select("_row", "_id", "_found"), "test")
    spans, names = features(located(rows, ["_row", "_id"]))
    scored = {}
    for r in spans.filter(F.col("g") >= len(BASE)).collect():
        scored.setdefault(r["_id"], {})[r["g"], r["start"], r["end"]] = model.predict(tuple(r[n] for n in names))
    got = {r["doc_id"]: r for r in find_pii(docs).collect()}
    assert sum(len(x) for x in scored.values()) > 200
    for i, text in enumerate(own):
        want = {(k + len(BASE), m.start(), m.end()) for k, g in enumerate(MORE) for m in regex.finditer(g.pattern, text or "")}
        assert want == set(scored.get(i, {})), text
        base = [(s, e) for s, _, e, _ in brute(text)]
        chosen = [(p, start, KINDS.index(MORE[g - len(BASE)].kind), end, MORE[g - len(BASE)].kind) for (g, start, end), p in scored.get(i, {}).items() if p >= limits[g - len(BASE)]]
        added = [tuple(s) for s in got[i]["_spans"] if s not in got[i]["_base"]]
        assert added == brute_added(chosen, base), text


def test_held_out_precision_and_recall(spark):
    """Sentences of another make than the training's: what is personal is found, what isn't stays."""
    model, limits = train(spark)
    assert len(limits) == 4 and all(0.05 < x <= 1 for x in limits)
    yes = ["Please ring our office, tel. 020 7946 0958, before noon.", "reach me on (415) 555-0132 or by post", "My mobile: 0171 555 1234.", "write to jane.roe (at) example.org today", "contact: sam[at]mail[dot]net", "refund to account GB29 NWBK 6016 1331 9268 19 please", "IBAN: DE89370400440532013000", "SSN 219-09-9999 was given", "social security 457-55-5462, born in May", "call 212-555-0187 now"]
    no = ["see section 12 345 678 of the report", "order 900-12-0000 was shipped", "release 2024.10.1234 of the tool", "part number AB12CDEF34567890GH is sold out", "lot 111 1111-1111 recalled", "the score was 12-10-2024 in the end", "sku #123.456.7890 in stock", "figure 3 shows 22 33 44 55 66 77", "build 450-123-999 failed", "serial XK12ABCD0123EFGH4567 engraved"]
    docs = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    hits = {r["doc_id"] for r in find_pii(docs).collect() if r["_spans"]}
    found, wrong = len([i for i in hits if i < len(yes)]), len([i for i in hits if i >= len(yes)])
    assert found >= 0.8 * len(yes) and wrong <= 0.2 * len(no), (sorted(hits), limits)


def test_empty(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
