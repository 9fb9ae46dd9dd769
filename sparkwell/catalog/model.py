"""How the given tables stand for items, chunks, requests, concepts, edges, rules and tools; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.functions import text as T

#: Longest chunk in code points.
CHUNK_LIMIT = 6000
#: Chunk ids are item * STRIDE + ordinal.
STRIDE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Documents with title, status (from labels), priority, authority and effective window."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    i = F.col("doc_id")
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(
        i.alias("item_id"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.col("text").alias("body"),
        "source",
        "lang",
        F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 0, "draft").otherwise("published").alias("status"),
        (i % 7).cast("int").alias("priority"),
        F.when(i % 10 != 0, (i % 11) / 10.0).alias("authority"),
        F.when(i % 6 == 0, F.expr("timestamp'2024-01-01' + make_dt_interval(int(doc_id % 300))")).alias("effective_from"),
        F.when(i % 9 == 0, F.expr("timestamp'2024-06-01' + make_dt_interval(int(doc_id % 300))")).alias("effective_to"),
        F.when(i % 8 == 0, F.concat("source", F.lit("-"), (i % 40).cast("string"))).alias("selection_group"),
    )


ITEMS = """items as (
  select d.doc_id as item_id, substr(split_part(text, chr(10), 1), 1, 80) as title, text as body, source, lang,
    case when toxic = 1 then 'deprecated' when quality = 0 then 'draft' else 'published' end as status,
    cast(d.doc_id % 7 as int) as priority, case when d.doc_id % 10 <> 0 then (d.doc_id % 11) / 10.0::double end as authority,
    case when d.doc_id % 6 = 0 then timestamp '2024-01-01' + to_days(cast(d.doc_id % 300 as int)) end as effective_from,
    case when d.doc_id % 9 = 0 then timestamp '2024-06-01' + to_days(cast(d.doc_id % 300 as int)) end as effective_to,
    case when d.doc_id % 8 = 0 then source || '-' || cast(d.doc_id % 40 as varchar) end as selection_group
  from documents d left join (select doc_id, max(toxic) as toxic, max(quality) as quality from labels group by doc_id) l on l.doc_id = d.doc_id)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Items cut at CHUNK_LIMIT code points; a chunk inherits from its item."""
    from sparkwell.operators.chunking import hard_split

    cut = hard_split(items(spark, d), "body", CHUNK_LIMIT)
    heading = F.when(F.col("part_key") != "", F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, 80))  # a part's own first line
    return cut.withColumn("chunk_id", F.col("item_id") * STRIDE + F.col("ordinal")).withColumn("token_count", T.estimate_tokens(F.col("content"))).withColumn("heading", heading).drop("body")


CHUNKS = f"""{ITEMS},
chunks as (
  select item_id, title, source, lang, status, priority, authority, effective_from, effective_to, selection_group,
    cast(o as int) as ordinal, substr(body, o * {CHUNK_LIMIT} + 1, {CHUNK_LIMIT}) as content,
    case when length(body) > {CHUNK_LIMIT} then 'part-' || lpad(cast(o + 1 as varchar), cast(greatest(2, length(cast(o + 1 as varchar))) as int), '0') else '' end as part_key,
    item_id * {STRIDE} + o as chunk_id, case when length(body) > {CHUNK_LIMIT} then substr(split_part(substr(body, o * {CHUNK_LIMIT} + 1, {CHUNK_LIMIT}), chr(10), 1), 1, 80) end as heading,
    cast(ceil(length(substr(body, o * {CHUNK_LIMIT} + 1, {CHUNK_LIMIT})) / 4.0) as bigint) as token_count
  from (select *, unnest(range(0, greatest(1, cast(ceil(length(body) / {CHUNK_LIMIT}.0) as bigint)))) as o from items))"""


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as concepts: key, name, alias, domain (brand) and status."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("concept_id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_name").alias("name"),
        F.concat(F.lower("p_type"), F.lit(" "), F.substring_index("p_name", " ", -1)).alias("alias"),
        F.col("p_brand").alias("domain"),
        F.when(F.col("p_size") % 10 == 0, "draft").otherwise("published").alias("status"),
        F.col("p_size").alias("priority"),
    )


CONCEPTS = """concepts as (
  select p_partkey as concept_id, replace(p_name, ' ', '-') || '-' || cast(p_partkey as varchar) as key, p_name as name,
    lower(p_type) || ' ' || split_part(p_name, ' ', -1) as alias, p_brand as domain,
    case when p_size % 10 = 0 then 'draft' else 'published' end as status, p_size as priority from part)"""


def chunk_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of document i is tagged with two parts."""
    n = table(spark, d, "part").count()
    ids = chunks(spark, d).select("chunk_id", "item_id")
    return ids.select("chunk_id", F.explode(F.array((7 * F.col("item_id")) % n, (13 * F.col("item_id")) % n)).alias("concept_id")).distinct()


CHUNK_CONCEPTS = """chunk_concepts as (
  select distinct chunk_id, unnest([(7 * item_id) % n, (13 * item_id) % n]) as concept_id from chunks, (select count(*) as n from part))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed concept edges: consecutive distinct parts of an order, the type is the return flag."""
    lines = table(spark, d, "lineitem")
    a = lines.select("l_orderkey", F.col("l_partkey").alias("source"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("relation"), "l_linestatus", "l_quantity")
    b = lines.select("l_orderkey", F.col("l_partkey").alias("target"), (F.col("l_linenumber") - 1).alias("n"))
    e = a.join(b, ["l_orderkey", "n"]).where("source <> target")
    return e.groupBy("source", "target", "relation").agg(F.min("l_orderkey").alias("edge_id"), F.max("l_linestatus").alias("line_status"), F.max("l_quantity").alias("quantity"))


EDGES = """edges as (
  select a.l_partkey as source, b.l_partkey as target, a.l_returnflag as relation, min(a.l_orderkey) as edge_id, max(a.l_linestatus) as line_status, max(a.l_quantity) as quantity
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_partkey <> b.l_partkey group by all)"""


def tool_edges(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies between parts: from the larger key to the smaller; those of large lines with status F are required."""
    return (
        edges(spark, d)
        .groupBy(F.greatest("source", "target").alias("source"), F.least("source", "target").alias("target"))
        .agg(F.when((F.min("line_status") == "F") & (F.max("quantity") >= 46), "required").otherwise("optional").alias("requirement"))
    )


TOOL_EDGES = f"""{EDGES},
tool_edges as (
  select greatest(source, target) as source, least(source, target) as target, case when min(line_status) = 'F' and max(quantity) >= 46 then 'required' else 'optional' end as requirement
  from edges group by 1, 2)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as requests: text, query (blank for some), a text that names a concept, and an as-of time."""
    n = table(spark, d, "part").count()
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), "text", ((13 * F.col("item_id")) % n).alias("concept_id"))
    c = concepts(spark, d).select("concept_id", "key", "name", "alias")
    m = F.col("request_id") % 5
    named = F.when(m == 0, F.col("key")).when(m == 1, F.upper("name")).when(m == 2, F.expr("substr(name, 1, length(name) - 2)")).when(m == 3, F.col("alias")).otherwise(F.concat(F.lit("the "), F.col("name"), F.lit("s")))
    return b.join(c, "concept_id").select("request_id", "text", F.when(F.col("request_id") % 10 == 9, "  ").otherwise(F.col("text")).alias("query"), named.alias("concept_text"), F.expr("timestamp'2024-03-01' + make_dt_interval(int(request_id))").alias("as_of"), (F.col("request_id") % 3 == 0).alias("include_draft"))


REQUESTS = f"""{CONCEPTS},
requests as (
  select item_id as request_id, text, case when item_id % 10 = 9 then '  ' else text end as query,
    case item_id % 5 when 0 then key when 1 then upper(name) when 2 then substr(name, 1, length(name) - 2) when 3 then alias else 'the ' || name || 's' end as concept_text,
    timestamp '2024-03-01' + to_days(cast(item_id as int)) as as_of, item_id % 3 = 0 as include_draft
  from benchmark join concepts on concept_id = (13 * item_id) % (select count(*) from part))"""
