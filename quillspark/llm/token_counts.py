"""Token counts by overlap resynchronisation.

A text of up to ``chunk_chars`` is encoded at once.  A longer one is encoded in
chunks that overlap; two neighbouring chunks are spliced at a character offset
where both begin a pre-token.  Such an offset is a boundary of the whole text
too: the pre-tokeniser matches from left to right and looks ahead by one
character only, so from a common boundary on, the right chunk's pre-tokens are
those of the whole text, and up to it the left chunk's are.  ``MARGIN`` keeps
the offset further from either cut than that lookahead and than any added
token's string.  Where an overlap holds no such offset (one huge word), the
left chunk is widened, at last up to the text's end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches

#: Characters between a splice and either cut; added tokens must be shorter.
MARGIN = 64
#: Characters encoded by one call over short texts.
BATCH_CHARS = 1 << 18


#: A space between two characters that aren't white space: a byte-level pre-tokeniser always begins a token there.
CUT = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")


def cuts_at_spaces(config: dict) -> bool:
    """Is it a byte-level BPE whose tokens never span such a space, whatever stands around?"""
    before, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    return plain and config.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")


class Pieces:
    """Token counts of texts by their pieces, each of which is encoded once and then remembered."""

    def __init__(self, lengths, added: list[str]) -> None:
        self.lengths, self.added, self.known = lengths, added, {}

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [[t] if any(a in t for a in self.added) else CUT.split(t) for t in texts]
        fresh = list(set().union(*cut).difference(self.known))
        if len(self.known) > 250_000:
            self.known = {}
            fresh = list(set().union(*cut))
        self.known.update(zip(fresh, self.lengths(fresh)))
        return [sum(map(self.known.__getitem__, pieces)) for pieces in cut]


def _word_starts(encoding, base: int) -> dict[int, int]:
    """Absolute offset of each pre-token's first character -> index of its first token."""
    found, last = {}, object()
    for i, (word, (start, end)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if (word is None or word != last) and start < end:
            found.setdefault(base + start, i)
        last = word
    return found


def spliced_count(encode, text: str, chunk_chars: int, overlap_chars: int) -> int:
    """Number of tokens of text; ``encode`` gives a tokenizers.Encoding."""
    if overlap_chars <= 2 * MARGIN or chunk_chars <= 2 * overlap_chars:
        raise ValueError("overlap_chars must exceed 2 * MARGIN, and chunk_chars 2 * overlap_chars")
    n, total = len(text), 0
    start, end = 0, min(len(text), chunk_chars)
    left, skip = encode(text[start:end]), 0
    while end < n:
        at = max(start, end - overlap_chars)
        right_end = min(n, at + chunk_chars)
        right = encode(text[at:right_end])
        ours, theirs = _word_starts(left, start), _word_starts(right, at)
        low = at + MARGIN if at > start else at
        common = [b for b in theirs if low <= b <= end - MARGIN and ours.get(b, -1) >= skip]
        if common:
            b = common[len(common) // 2]
            total += ours[b] - skip
            start, end, left, skip = at, right_end, right, theirs[b]
        else:
            end = min(n, end + (end - start))
            left = encode(text[start:end])
    return total + len(left.ids) - skip


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 32_768,
    overlap_chars: int = 1_024,
) -> DataFrame:
    """Tokens of every whole text: (id_col, n_bytes, n_tokens), a row for each row.

    A null text counts as empty (0 and 0); rows that repeat are counted each;
    other columns are ignored, whatever their names; an empty table gives an
    empty one.  ``.json`` files are read by tokenizers and ``.model`` files by
    sentencepiece (those whole, as their merges may cross white space).  Special
    strings within a text are taken as the library does by default; nothing is
    added, cut or padded.  The driver reads the vocabulary file and sends it.
    """
    with open(tokenizer_path, "rb") as file:
        blob = docs.sparkSession.sparkContext.broadcast(file.read())
    small_batches(docs.sparkSession)
    pieces = tokenizer_path.endswith(".model")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if pieces:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=blob.value)
            lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_str(blob.value.decode())
            model.no_truncation()
            model.no_padding()
            encode = lambda text: model.encode(text, add_special_tokens=False)
            lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            config = json.loads(blob.value)
            if cuts_at_spaces(config):
                lengths = Pieces(lengths, [t["content"] for t in config.get("added_tokens") or []])
        for batch in batches:
            counts, group, held = [0] * len(batch), [], 0
            for i, text in enumerate(batch["_text"]):
                if len(text) > chunk_chars and not pieces:
                    counts[i] = spliced_count(encode, text, chunk_chars, overlap_chars)
                    continue
                group.append(i)
                held += len(text)
                if held >= BATCH_CHARS:
                    for k, c in zip(group, lengths([batch["_text"].iat[k] for k in group])):
                        counts[k] = c
                    group, held = [], 0
            if group:
                for k, c in zip(group, lengths([batch["_text"].iat[k] for k in group])):
                    counts[k] = c
            yield pd.DataFrame({"_id": batch["_id"], "n_bytes": batch["n_bytes"], "n_tokens": counts})

    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInPandas(count, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)
