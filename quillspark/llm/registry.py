"""Queries op1 to op10, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.llm.common import table, write_shared
from quillspark.llm.decontamination import contamination
from quillspark.llm.jaccard_join import near_duplicates
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.media import draw, find_copies, page_text
from quillspark.llm.mixing import mix, sized
from quillspark.llm.pii import KINDS, find_pii, joined
from quillspark.llm.secrets import find_secrets
from quillspark.llm.sharding import measured, reshard
from quillspark.llm.token_counts import token_counts
from quillspark.llm.toxicity import fit, score


def op1_decontamination(spark, sf_dir):
    """Words of every document that lie in eight-word windows of benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def fit_toxicity(docs, labels):
    """A model of labels.toxic that learns nothing from held-out rows."""
    return fit(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def op2_toxicity(spark, sf_dir):
    """Toxicity of every document; predicted: 0.7 or more."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.7).cast("int").alias("predicted"),
        F.size("_passages").alias("n_passages"),
    )


def op3_mix_sources(spark, sf_dir):
    """Words that a mix by source weights takes of every document, and when each copy is due."""
    docs = sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "_size", "_hash")
    mixed = mix(write_shared(docs, "op3"), is_sized=True)
    out = mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
        F.col("_positions").alias("positions"),
    )
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(1.0))
    return out.withColumn("_due", first).repartitionByRange("_due", "doc_id").sortWithinPartitions("_due", "doc_id").drop("_due")


def op4_secrets(spark, sf_dir):
    """Every candidate credential of every document, and whether the forest lets it pass."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "kind", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op5_line_dedup(spark, sf_dir):
    """Lines of every document that lie in repeated three-line windows, and what is left."""
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op6_media_copies(spark, sf_dir):
    """Copies among the pictures of all pages of those whose id is divisible by 100."""
    pages = table(spark, sf_dir, "pages").select("page_id", page_text().alias("shown"))
    return find_copies(pages, pages.filter("page_id % 100 = 0"), id_col="page_id", data_col="shown", read=draw).withColumnsRenamed({"query": "query_page_id", "id": "page_id"})


def op7_jaccard_join(spark, sf_dir):
    """Components of documents that share 85 % of their four-word runs."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op8_token_counts(spark, sf_dir):
    """Tokens of every document; over_limit: more than 512."""
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_pii(spark, sf_dir):
    """Personal data in every document: base findings by kind, and all spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
    )


def op10_reshard(spark, sf_dir):
    """Documents from 7 hash shards into 8 of equal bytes, moving as few bytes as can be."""
    docs = measured(table(spark, sf_dir, "documents")).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    docs = write_shared(docs.select("doc_id", "_size", "_hash", "text_crc32"), "op10")
    placed, _ = reshard(docs, 8, n_old=7, is_measured=True)
    return placed.select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_secrets": op4_secrets,
    "op5_line_dedup": op5_line_dedup,
    "op6_media_copies": op6_media_copies,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_reshard": op10_reshard,
}
ORACLE_SQL = {
    "op1_decontamination": r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bw as (
  select distinct item_id, least(len(w), 8) as n, array_to_string(w[i : i + 7], ' ') as s
  from b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as u(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (
  select r, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from d, sizes, unnest(range(1, len(w) - n + 2)) as u(i)),
m as (select r, i, dw.n, item_id from dw join bw on dw.s = bw.s and dw.n = bw.n),
h as (select r, count(distinct p) as n_hit from m, unnest(range(i, i + n)) as u(p) group by r),
t as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from m group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_items, 0) >= 2 as contaminated
from d left join h using (r) left join t using (r)
""",
    "op5_line_dedup": r"""
with d as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as lines from documents),
one as (select min(r) as r, doc_id, text, any_value(lines) as lines from d where text is not null group by doc_id, text),
w as (
  select r, doc_id, i, least(len(lines), 3) as n, lines[i : i + 2] as s
  from one, unnest(range(1, greatest(len(lines) - 2, 1) + 1)) as u(i)
  where regexp_matches(array_to_string(lines[i : i + 2], ''), '\S')),
o as (select *, row_number() over (partition by s order by doc_id, i) as k from w),
gone as (select distinct r, p from o, unnest(range(i, i + n)) as v(p) where k > 1),
g as (select doc_id, text, list(p) as ps from gone join one using (r) group by doc_id, text)
select d.doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines, cast(coalesce(len(ps), 0) as bigint) as n_removed,
       md5(coalesce(case when ps is null then d.text
         else array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda x: not list_contains(ps, x)), lambda x: lines[x]), chr(10)) end, '')) as kept_md5
from d left join g on d.doc_id = g.doc_id and d.text = g.text
""",
    "op7_jaccard_join": r"""
with recursive d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct r, array_to_string(w[i : i + 3], ' ') as g
  from d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as u(i) where len(w) > 0),
sizes as (select r, count(*) as n from s group by r),
common as (select a.r as a, b.r as b, count(*) as n from s a join s b using (g) where a.r <> b.r group by a.r, b.r),
links as (
  select a, b from common c join sizes x on x.r = a join sizes y on y.r = b
  where 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach(r, q) as (select r, r from d union select reach.r, links.b from reach join links on links.a = reach.q),
least_of as (select reach.r, min(d.doc_id) as component_id from reach join d on d.r = reach.q group by reach.r)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id
from d join least_of using (r) left join sizes using (r)
""",
}
