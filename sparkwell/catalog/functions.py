"""Scalar functions and chunking over documents, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwell.catalog import model as M
from sparkwell.functions import text as T
from sparkwell.operators import chunking, similarity
from sparkwell.operators.embedding import embed

NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

_FROM, _TO = T.accent_table()


def _folded(c: str) -> str:
    out = f"translate({c}, '{_FROM}', '{_TO}')"
    for a, b in T.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _grams(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def docs(s: SparkSession, d: str) -> DataFrame:
    return M.table(s, d, "documents")


def fn_normalize(s, d):
    return docs(s, d).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


def fn_fold_accents(s, d):
    return docs(s, d).select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


def fn_slug(s, d):
    p = M.table(s, d, "part")
    return p.select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), T.path_slug(F.array("p_brand", F.lit("!"), "p_name")).alias("path"))


def fn_estimate_tokens(s, d):
    return docs(s, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def fn_trigrams(s, d):
    return M.table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(T.trigrams(F.col("p_name"))), "|").alias("grams"))


def fn_trgm_similarity(s, d):
    p = M.table(s, d, "part")
    a, b = T.trigrams(F.col("p_name")), T.trigrams(F.concat_ws(" ", F.lower("p_type"), F.substring_index("p_name", " ", -1)))
    return p.select("p_partkey", F.round(T.trigram_similarity(a, b), 9).alias("similarity"))


def fn_edit_distance_suggest(s, d):
    p = M.table(s, d, "part")
    wrong = p.select(F.col("p_partkey").alias("id"), F.expr("concat(substr(p_name, 1, 2), substr(p_name, 4), CASE WHEN p_partkey % 3 = 0 THEN ' xyzzy' ELSE '' END)").alias("word"))
    return similarity.suggest(wrong, "word", p.select(F.col("p_name").alias("key")).distinct()).select("id", "word", "suggestion", F.coalesce("distance", F.lit(-1)).alias("distance"))


def fn_canonical_hash(s, d):
    return docs(s, d).select("doc_id", T.canonical_hash(lang=F.col("lang"), n_chars=F.col("n_chars"), source=F.col("source")).alias("hash"))


def fn_uuid5(s, d):
    return docs(s, d).select("doc_id", T.uuid5(NAMESPACE, F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("uuid"))


def fn_semantic_text(s, d):
    return M.concepts(s, d).select("concept_id", T.joined_lines(F.col("name"), F.col("alias"), F.col("domain")).alias("semantic_text"))


def fn_search_text(s, d):
    names = M.chunk_concepts(s, d).join(M.concepts(s, d).select("concept_id", "name"), "concept_id").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("names"))
    c = M.chunks(s, d).join(names, "chunk_id", "left")
    return c.select("chunk_id", F.col("title").alias("weight_a"), F.md5("content").alias("weight_b_md5"), F.coalesce("names", F.lit("")).alias("weight_c"), F.md5(F.concat_ws("\n", "title", "content", F.coalesce("names", F.lit("")))).alias("search_md5"))


def fn_valid_date(s, d):
    o = M.table(s, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    odd = F.when(F.col("o_orderkey") % 4 == 0, day).when(F.col("o_orderkey") % 4 == 1, F.concat(F.substring(day, 1, 8), F.lit("31"))).when(F.col("o_orderkey") % 4 == 2, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(F.concat(F.substring(day, 1, 5), F.lit("02-29")))
    return o.select("o_orderkey", odd.alias("value")).select("o_orderkey", "value", T.valid_date(F.col("value")).alias("valid"))


def fn_contains_any(s, d):
    return M.table(s, d, "part").where(T.contains_any(F.lit("RED"), F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey", "p_name")


def fn_embed_fixture(s, d):
    return M.table(s, d, "benchmark").select("item_id", F.posexplode(T.fixture_embedding(F.col("text"), 64)).alias("i", "x")).select("item_id", "i", F.round("x", 9).alias("x"))


def _hash_vectors(texts):
    """The fixture embedding as a provider: 64 numbers from two chained digests."""
    import hashlib

    out = []
    for t in texts:
        first = hashlib.sha256(t.encode()).digest()
        out.append([b / 255 - 0.5 for b in first + hashlib.sha256(first).digest()])
    return out


def fn_embed_provider(s, d):
    got = embed(M.table(s, d, "benchmark"), "text", _hash_vectors, 64)
    return got.select("item_id", F.posexplode("vector").alias("i", "x")).select("item_id", "i", F.round("x", 9).alias("x"))


def ck_hard_split(s, d):
    return M.chunks(s, d).select("item_id", "ordinal", "part_key", F.md5("content").alias("content_md5"))


def ck_paragraph_pack(s, d):
    """Conversations as documents: one paragraph a turn."""
    turns = M.table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("body"))
    return turns.select("conv_id", F.posexplode(chunking.pack_paragraphs(F.col("body"), 1500)).alias("ordinal", "content")).select("conv_id", "ordinal", F.length("content").alias("n"), F.md5("content").alias("content_md5"))


def _marked(s, d):
    """Conversations as Markdown: a heading for every turn."""
    line = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    turns = M.table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "\n").alias("body"))
    return turns.withColumn("body", F.concat(F.lit("conversation\n"), "body"))


def ck_sections(s, d):
    return chunking.sections(_marked(s, d), "conv_id", "body").select("conv_id", "ordinal", "section_key", "heading", F.array_join("heading_path", " > ").alias("path"), F.md5("content").alias("content_md5"))


def ck_chunk(s, d):
    return chunking.chunk_documents(_marked(s, d), "conv_id", "body", 800).select("conv_id", "ordinal", "chunk_key", F.length("content").alias("n"), F.md5("content").alias("content_md5"))


def ck_inherit(s, d):
    c = M.chunks(s, d)
    return c.select("chunk_id", "item_id", "status", "priority", F.round("authority", 9).alias("authority"), "effective_from", "effective_to", "selection_group", "token_count", F.sha2("content", 256).alias("content_hash"))


QUERIES = {f.__name__: f for f in (fn_normalize, fn_fold_accents, fn_slug, fn_estimate_tokens, fn_trigrams, fn_trgm_similarity, fn_edit_distance_suggest, fn_canonical_hash, fn_uuid5, fn_semantic_text, fn_search_text, fn_valid_date, fn_contains_any, fn_embed_fixture, fn_embed_provider, ck_hard_split, ck_paragraph_pack, ck_sections, ck_chunk, ck_inherit)}

_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_TURNS = "(select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as body from conversations group by conv_id)"
# every turn is a section of its own, and no text has a blank line or a heading
_SECTIONS = r"""t as (select conv_id, role || ' ' || cast(turn as varchar) as heading, '## ' || role || ' ' || cast(turn as varchar) || chr(10) || text as line, turn from conversations),
sec as (
  select conv_id, cast(row_number() over (partition by conv_id order by turn, line) as int) as ordinal, lower(replace(heading, ' ', '-')) as section_key, heading, regexp_replace(line, '^\s+|\s+$', '', 'g') as content from t
  union all select distinct conv_id, 0, 'intro', null, 'conversation' from conversations)"""

SQL = {
    "fn_normalize": r"select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as normalized from documents",
    "fn_fold_accents": f"select doc_id, {_folded('text')} as folded from documents",
    "fn_slug": f"select p_partkey, {_SLUG.format(chr(39).join(['p_name || ', ' / ', ' || p_type']))} as slug, {_SLUG.format('p_brand')} || '--' || {_SLUG.format('p_name')} as path from part",
    "fn_estimate_tokens": "select doc_id, cast(ceil(length(text) / 4.0) as bigint) as tokens from documents",
    "fn_trigrams": f"select p_partkey, array_to_string(list_sort({_grams('p_name')}), '|') as grams from part",
    "fn_trgm_similarity": f"""with g as (select p_partkey, {_grams('p_name')} as a, {_grams("lower(p_type) || ' ' || split_part(p_name, ' ', -1)")} as b from part)
select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) as similarity from g""",
    "fn_edit_distance_suggest": """with w as (select p_partkey as id, substr(p_name, 1, 2) || substr(p_name, 4) || case when p_partkey % 3 = 0 then ' xyzzy' else '' end as word from part),
k as (select distinct p_name as key from part), a as (select distinct word from w),
r as (select word, key, levenshtein(word, key) as dist, row_number() over (partition by word order by levenshtein(word, key), key) as n from a, k)
select id, word, case when dist <= greatest(2, length(word) / 3.0) then key end as suggestion, case when dist <= greatest(2, length(word) / 3.0) then cast(dist as int) else -1 end as distance from w join r using (word) where n = 1""",
    "fn_canonical_hash": "select doc_id, sha256(to_json({'lang': lang, 'n_chars': n_chars, 'source': source})) as hash from documents",
    "fn_uuid5": f"""select doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab89ab89ab89ab', cast('0x' || substr(h, 17, 1) as int) + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) as uuid
from (select doc_id, sha1(unhex('{NAMESPACE}') || encode(source || ':' || cast(doc_id as varchar))) as h from documents)""",
    "fn_semantic_text": f"with {M.CONCEPTS} select concept_id, name || chr(10) || alias || chr(10) || domain as semantic_text from concepts",
    "fn_search_text": f"""with {M.CHUNKS}, {M.CHUNK_CONCEPTS}, {M.CONCEPTS},
n as (select chunk_id, string_agg(name, ' ' order by name) as names from (select distinct chunk_id, name from chunk_concepts join concepts using (concept_id)) group by chunk_id)
select chunk_id, title as weight_a, md5(content) as weight_b_md5, coalesce(names, '') as weight_c, md5(title || chr(10) || content || chr(10) || coalesce(names, '')) as search_md5 from chunks left join n using (chunk_id)""",
    "fn_valid_date": r"""with v as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
w as (select o_orderkey, case o_orderkey % 4 when 0 then day when 1 then substr(day, 1, 8) || '31' when 2 then replace(day, '-', '/') else substr(day, 1, 5) || '02-29' end as value from v)
select o_orderkey, value, coalesce(regexp_full_match(value, '\d{4}-\d{2}-\d{2}') and try_cast(value as date) is not null, false) as valid from w""",
    "fn_contains_any": "select p_partkey, p_name from part where contains(lower(p_name), 'red') or contains(lower(p_brand), 'red') or contains(lower(p_type), 'red')",
    "fn_embed_fixture": """with h as (select item_id, sha256(text) as a from benchmark), b as (select item_id, a || sha256(unhex(a)) as h from h)
select item_id, cast(i as int) as i, round(cast('0x' || substr(h, 2 * i + 1, 2) as int) / 255.0::double - 0.5, 9) as x from (select item_id, h, unnest(range(0, 64)) as i from b)""",
    "fn_embed_provider": """with h as (select item_id, sha256(text) as a from benchmark), b as (select item_id, a || sha256(unhex(a)) as h from h)
select item_id, cast(i as int) as i, round(cast('0x' || substr(h, 2 * i + 1, 2) as int) / 255.0::double - 0.5, 9) as x from (select item_id, h, unnest(range(0, 64)) as i from b)""",
    "ck_hard_split": f"with {M.CHUNKS} select item_id, ordinal, part_key, md5(content) as content_md5 from chunks",
    "ck_paragraph_pack": f"""with recursive p as (select conv_id, list_filter(regexp_split_to_array(body, '\\n[ \\t]*\\n+'), lambda x: trim(x) <> '') as ps from {_TURNS}),
f as (select conv_id, ps, 1 as i, ps[1] as cur, cast([] as varchar[]) as out from p where len(ps) > 0
  union all select conv_id, ps, i + 1, case when length(cur) + 2 + length(ps[i + 1]) <= 1500 then cur || chr(10) || chr(10) || ps[i + 1] else ps[i + 1] end,
    case when length(cur) + 2 + length(ps[i + 1]) <= 1500 then out else list_append(out, cur) end from f where i < len(ps)),
e as (select conv_id, list_append(out, cur) as out from f where i = len(ps))
select conv_id, cast(o as int) as ordinal, cast(length(out[o + 1]) as int) as n, md5(out[o + 1]) as content_md5 from (select conv_id, out, unnest(range(0, len(out))) as o from e)""",
    "ck_sections": f"""with {_SECTIONS} select conv_id, ordinal, section_key, heading, coalesce(heading, '') as path, md5(content) as content_md5 from sec""",
    "ck_chunk": f"""with {_SECTIONS}, cut as (select conv_id, ordinal, section_key, content, greatest(1, cast(ceil(length(content) / 800.0) as int)) as n, unnest(range(0, greatest(1, cast(ceil(length(content) / 800.0) as int)))) as p from sec),
piece as (select *, substr(content, p * 800 + 1, 800) as part from cut)
select conv_id, cast(row_number() over (partition by conv_id order by ordinal, p) - 1 as int) as ordinal, section_key || case when n > 1 then '--part-' || lpad(cast(p + 1 as varchar), cast(greatest(2, length(cast(p + 1 as varchar))) as int), '0') else '' end as chunk_key, cast(length(part) as int) as n, md5(part) as content_md5 from piece""",
    "ck_inherit": f"with {M.CHUNKS} select chunk_id, item_id, status, priority, round(authority, 9) as authority, effective_from, effective_to, selection_group, token_count, sha256(content) as content_hash from chunks",
}
