"""Authored files as rows: paths with kinds, and the entities of collection files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, folder: str, kinds: dict[str, str]) -> DataFrame:
    """(path, kind, text) of every file below a folder; kinds maps a path pattern to a kind, the first that matches wins.

    Files are only opened where their text is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.col("_metadata.file_path")
    kind: Column = F.lit(None).cast("string")
    for pattern, name in reversed(kinds.items()):
        kind = F.when(path.rlike(pattern), name).otherwise(kind)
    return files.select(path.alias("path"), kind.alias("kind"), F.col("content").cast("string").alias("text"))


#: Stand-ins for an escaped backslash and quote while strings are looked for; no text may hold them.
_BACKSLASH, _QUOTE = "\ufdd0", "\ufdd1"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"


def clean_json(text: Column) -> Column:
    """JSON without the commas that trail before a closing bracket, where only white space and comments may stand between.

    Strings and comments are matched whole, so that what looks like such a comma inside them stays.
    """
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    cleaned = F.regexp_replace(marked, rf'("[^"]*"|{_COMMENT})|,((?:\s|{_COMMENT})*[}}\]])', "$1$2")
    return F.replace(F.replace(cleaned, F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))


def read_entities(files: DataFrame, schema: str) -> DataFrame:
    """(path, kind, pointer, entity...) of every member of a file's array: JSON with comments; trailing commas are let pass.

    A text that is no such array gives no rows.
    """
    parsed = files.select("path", "kind", F.from_json(clean_json(F.col("text")), f"array<{schema}>", {"allowComments": "true"}).alias("x"))
    return parsed.select("path", "kind", F.posexplode("x").alias("i", "e")).select("path", "kind", F.concat(F.lit("/"), F.col("i").cast("string")).alias("pointer"), "e.*")


def split_front(files: DataFrame) -> DataFrame:
    """files(path, kind, text) plus front, body, body_line and code: what stands between a first line of three dashes and the next such line, and what follows.

    Fences may have white space around them. body_line is the number of the body's first line, from 1. A file without
    the one fence or the other has neither part, and code says which.
    """
    lines = F.split("text", "\n")
    fence = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "") == "---")
    close = F.array_position(F.slice(fence, 2, F.size(fence)), True).cast("int")
    at = files.withColumn("open", F.coalesce(F.get(fence, F.lit(0)), F.lit(False))).withColumn("close", close)
    code = F.when(~F.col("open"), "MISSING_OPENING_FENCE").when(F.col("close") == 0, "MISSING_CLOSING_FENCE")
    part = lambda start, n: F.when(code.isNull(), F.array_join(F.slice(lines, start, n), "\n"))
    front, body = part(2, F.greatest(F.col("close") - 1, F.lit(0))), part(F.col("close") + 2, F.size(lines))
    return at.select(*files.columns, front.alias("front"), body.alias("body"), F.when(code.isNull(), F.col("close") + 2).alias("body_line"), code.alias("code"))


def read_documents(files: DataFrame, schema: str) -> DataFrame:
    """(path, kind, entity..., body, body_line, code) of files with front matter in JSON, comments and trailing commas let pass; INVALID_JSON where it is none.

    schema: a struct as in "struct<id:bigint>".
    """
    told = {"allowComments": "true", "columnNameOfCorruptRecord": "_wrong"}
    parsed = split_front(files).withColumn("_e", F.from_json(clean_json(F.col("front")), f"{schema.rstrip()[:-1]},_wrong:string>", told))
    wrong = F.col("code").isNull() & (F.col("_e").isNull() | F.col("_e._wrong").isNotNull())
    out = parsed.withColumn("code", F.coalesce("code", F.when(wrong, "INVALID_JSON")))
    return out.select("path", "kind", "_e.*", "body", "body_line", "code").drop("_wrong")
