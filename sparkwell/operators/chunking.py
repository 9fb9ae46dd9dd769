"""Documents to chunks: sections, paragraphs, and cuts at a width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions import text as T


def hard_split(rows: DataFrame, body: str, limit: int) -> DataFrame:
    """rows plus ordinal, content and part_key: body cut every `limit` code points; one piece has no part key."""
    n = F.greatest(F.lit(1), F.ceil(F.length(body) / limit)).cast("int")
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("ordinal"))
    number = (F.col("ordinal") + 1).cast("string")
    key = F.when(F.length(body) > limit, F.concat(F.lit("part-"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")))).otherwise("")
    return cut.withColumn("content", F.substring(F.col(body), F.col("ordinal") * limit + 1, F.lit(limit))).withColumn("part_key", key)


def pack_paragraphs(body: Column, limit: int) -> Column:
    """Blank-line paragraphs joined greedily into pieces of at most `limit` code points; a longer paragraph stands alone."""
    paragraphs = F.filter(F.split(body, r"\n[ \t]*\n+"), lambda p: F.trim(p) != "")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + 2 + F.length(p) <= limit
        return (
            F.when(s["cur"] == "", F.struct(p.alias("cur"), s["out"].alias("out")))
            .when(fits, F.struct(F.concat(s["cur"], F.lit("\n\n"), p).alias("cur"), s["out"].alias("out")))
            .otherwise(F.struct(p.alias("cur"), F.concat(s["out"], F.array(s["cur"])).alias("out")))
        )

    return F.aggregate(paragraphs, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))


def sections(docs: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, ordinal, section_key, heading, heading_path, content): text before the first H2 is "intro", then each heading's own lines.

    ATX headings of depth 2 to 6 outside code fences; the key is an explicit {#id} or the slug of the path.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")).alias("n", "line"))
    by = Window.partitionBy(id_col).orderBy("n")
    fence = F.col("line").rlike(r"^ {0,3}(```|~~~)")
    lines = lines.withColumn("fenced", F.sum(fence.cast("int")).over(by) % 2 == 1)
    depth = F.when(~F.col("fenced") & F.col("line").rlike(r"^#{2,6}\s+\S"), F.length(F.regexp_extract("line", "^(#+)", 1)))
    lines = lines.withColumn("depth", depth).withColumn("part", F.sum(F.col("depth").isNotNull().cast("int")).over(by))
    title = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"\s*\{#[^}]*\}\s*$", ""))
    explicit = F.regexp_extract("line", r"\{#([A-Za-z0-9._-]+)\}\s*$", 1)
    path = []
    for k in range(2, 7):
        # a heading of depth k holds until the next one of depth k or less
        since = F.max(F.when(F.col("depth") <= k, F.col("n"))).over(by)
        mine = F.max(F.when(F.col("depth") == k, F.struct("n", title.alias("title")))).over(by)
        path.append(F.when((F.col("depth_here") >= k) & (mine["n"] == since), mine["title"]))
    here = lines.withColumn("depth_here", F.max(F.when(F.col("depth").isNotNull(), F.struct("n", "depth"))).over(by)["depth"])
    flagged = here.select(id_col, "n", "line", "part", "depth", title.alias("title"), explicit.alias("explicit"), F.array_compact(F.array(*path)).alias("path"))
    out = flagged.groupBy(id_col, "part").agg(
        F.min_by("title", "n").alias("title"), F.min_by("explicit", "n").alias("explicit"), F.min_by("path", "n").alias("heading_path"), F.min_by("depth", "n").alias("depth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    out = out.where((F.col("depth").isNotNull()) | (F.trim("content") != ""))
    key = F.when(F.col("depth").isNull(), "intro").when(F.col("explicit") != "", F.col("explicit")).otherwise(T.path_slug(F.col("heading_path")))
    return out.select(id_col, F.col("part").alias("ordinal"), key.alias("section_key"), F.when(F.col("depth").isNotNull(), F.col("title")).alias("heading"), "heading_path", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content"))


def chunk_documents(docs: DataFrame, id_col: str, body: str, limit: int) -> DataFrame:
    """(id, ordinal, chunk_key, content): a section that fits is one chunk, a longer one is packed by paragraphs, a longer paragraph is cut.

    Fragments of one section are numbered --part-01 and so on. Each step is a transformation of columns, so only
    headings need the lines of a document together.
    """
    parts = sections(docs, id_col, body)
    fits = F.length("content") <= limit
    packed = F.when(fits, F.array("content")).otherwise(pack_paragraphs(F.col("content"), limit))
    cut = F.flatten(F.transform(packed, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length(p) / limit)).cast("int") - 1), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))))
    rows = parts.withColumn("_cut", cut).select(id_col, "ordinal", "section_key", F.size("_cut").alias("n"), F.posexplode("_cut").alias("part", "content"))
    number = (F.col("part") + 1).cast("string")
    key = F.when(F.col("n") > 1, F.concat("section_key", F.lit("--part-"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")))).otherwise(F.col("section_key"))
    order = Window.partitionBy(id_col).orderBy("ordinal", "part")
    return rows.select(id_col, (F.row_number().over(order) - 1).alias("ordinal"), key.alias("chunk_key"), "content")
