import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm.token_counts import Pieces, cuts_at_spaces, spliced_count, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def whole(model, text):
    return len(model.encode(text, add_special_tokens=False).ids)


PIECES = ["the ", "thonre", " a", "\n", "   ", "\n\n", "é", "日本", "🙂", "<|endoftext|>", "<|endof", "'s", " 12", "3.4", "!!", "\t ", "x" * 40, " ", " don't"]


@pytest.mark.parametrize("seed", range(40))
def test_splices_equal_the_whole(model, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(400, 3000)))
    encode = lambda t: model.encode(t, add_special_tokens=False)
    assert spliced_count(encode, text, 700, 200) == whole(model, text)


@pytest.mark.parametrize("text", ["x" * 9000, " " * 5000, "a" * 3000 + " b" * 900, "!" * 4000 + "z", "\n" * 4000, "🙂" * 3000])
def test_no_common_boundary_widens(model, text):
    encode = lambda t: model.encode(t, add_special_tokens=False)
    assert spliced_count(encode, text, 700, 200) == whole(model, text)


@pytest.mark.parametrize("seed", range(30))
def test_pieces_equal_the_whole(model, seed):
    rng = random.Random(seed)
    more = [*PIECES, "\u00a0", "\u3000x", "\x1c", "\x1f a", "\x85 b", " \u2028 ", "_ _", "\u0301 ", "ß ñ", "١٢ ٣", " 's", "' s", "\r ", "\u200b "]
    texts = ["".join(rng.choice(more) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    lengths = lambda batch: [len(x) for x in model.encode_batch_fast(batch, add_special_tokens=False)]
    count = Pieces(lengths, ["<|endoftext|>"])
    assert count(texts) == [whole(model, t) for t in texts]
    plain = ["".join(c for c in t if c not in "<|>") for t in texts]
    assert Pieces(lengths, [])(plain) == [whole(model, t) for t in plain]


def test_all_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, PATH).collect()}
    assert got == {r["doc_id"]: whole(model, r["text"] or "") for r in docs.collect()}


def test_other_vocabularies_are_not_cut(spark):
    import json

    path = public_tokenizers.path("word_bpe_49k.json")
    assert cuts_at_spaces(json.load(open(PATH))) and not cuts_at_spaces(json.load(open(path)))
    model = Tokenizer.from_file(path)
    texts = ["Hello  World", "a b c " * 50, "", "é <|endoftext|> x"]
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: whole(model, t) for i, t in enumerate(texts)}


def test_rows(spark, model):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (1, "hello world", "x"), (None, "a<|endoftext|>b", "z"), (5, "word " * 30_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts(docs, PATH).collect(), key=str)
    want = sorted(((i, len((t or "").encode()), whole(model, t or "")) for i, t, _ in rows), key=lambda r: str(r))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0
