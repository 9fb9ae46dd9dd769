"""One query per training-data operator over its whole table, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm import byte_bpe, decontaminate, fim, filter_audit, jaccard, language, neardup, packing, quality, secret_scan, sharding, token_counts, toxicity

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).alias("_bytes"), F.crc32(text).alias("text_crc32"))
    out = sharding.byte_shards(docs, F.col("_bytes") + 8, [F.col("doc_id")], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def remainder(n: int) -> Column:
    """crc32 of the id as text modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(-1))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, remainder(4) != 2).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), remainder(3) != 1).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", F.size("toxic_sentences").cast("long").alias("n_toxic_sentences"), F.array_join(F.transform("toxic_sentences", lambda x: F.concat_ws(":", x["first"].cast("string"), x["last"].cast("string"))), ",").alias("toxic_spans"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer_file())).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens", "n_pretokens")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    spelled = encoded.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).withColumn("n_tokens", F.size("ids").cast("long"))
    return byte_bpe.decode(spelled, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fim.restored(F.col("form"), F.col("output"))
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_sharding": op2_sharding,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_jaccard": op8_jaccard,
    "op9_secrets": op9_secrets,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op5_decontamination": rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from iw where len(w) > 0)),
lens as (select distinct n from win),
grams as (
  select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from dw, lens where len(w) >= n)),
hits as (select doc_id, item_id, p, win.n from grams join win on grams.s = win.s and grams.n = win.n),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as h from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join words using (doc_id) left join items using (doc_id)""",
    "op8_jaccard": rf"""
with recursive dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select distinct doc_id, array_to_string(w[p:p + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as p from dw where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
both_ways as (select a, b from links union select b, a from links),
reach as (select a as doc_id, a as node from both_ways union select doc_id, b from reach join both_ways on a = node),
least as (select doc_id, min(node) as component_id from reach group by doc_id)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component_id, d.doc_id) as component_id
from dw d left join sizes using (doc_id) left join least using (doc_id)""",
    "op11_filter_audit": r"""
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as x from documents),
w as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as w from t),
g as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
low as (select x, min(doc_id) as low from t group by x),
f as (
  select part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
    100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) as c, regexp_matches(x, '[#$%&*|]') as d,
    coalesce(doc_id > low, false) as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from w join low using (x) left join g using (doc_id)),
n as (select part, [a, b, c, d, e] as fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
letters as (select unnest(range(1, 6)) as i),
orders as (
  select [p.i, q.i, r.i, s.i, u.i] as o from letters p, letters q, letters r, letters s, letters u
  where len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
steps as (select o, i as step, o[1:i - 1] as before, o[i] as own from orders, letters),
per as (
  select n.part, o, step, own, n.n, good, toxic, fails[own] as fails_own,
    len(list_filter(before, lambda k: fails[k])) > 0 as gone, len(list_filter(fails, lambda k: k)) as n_fails
  from n, steps),
counted as (
  select part, o, step, own, sum(n) filter (not gone and not fails_own) as kept, sum(n) filter (not gone and fails_own) as removed,
    sum(n) filter (gone and fails_own) as redundant, sum(n) filter (fails_own and n_fails = 1) as unique_fails,
    sum(good) filter (not gone and fails_own) as good_lost, sum(toxic) filter (not gone and fails_own) as toxic_lost
  from per group by part, o, step, own)
select part, array_to_string([substr('ABCDE', k, 1) for k in o], '') as filter_order, cast(step as int) as step,
  cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
  cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(sum(coalesce(removed, 0)) over (partition by part, own) as bigint) as shapley
from counted""",
    "op13_fill_in_middle": r"""
with t as (select doc_id, coalesce(text, '') as x, sha256('7:' || doc_id) as h from documents),
u as (
  select *, regexp_extract_all(x, '[^\n]*\n|[^\n]+') as lines, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
v as (
  select *, len(lines) as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as c1, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as c2,
    case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (
  select *, array_to_string(lines[1:c1], '') as prefix, array_to_string(lines[c1 + 1:c2], '') as middle, array_to_string(lines[c2 + 1:], '') as suffix from v)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then x else prefix || middle || suffix end) as restored_sha256
from p""",
}
