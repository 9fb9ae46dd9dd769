"""Keyset pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest page that may be asked for.
MOST = 200


def keyset_page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """Up to `size` rows with key > after in key order, with a cursor each and whether more follow."""
    if not 1 <= size <= MOST:
        raise ValueError(f"page size must be 1 to {MOST}")
    some = rows.where(F.col(key) > after).orderBy(key).limit(size + 1)
    more = some.agg((F.count("*") > size).alias("has_next_page"))
    cursor = F.base64(F.encode(F.concat(F.lit("cursor:"), F.col(key).cast("string")), "UTF-8"))
    return some.orderBy(key).limit(size).withColumn("cursor", cursor).join(F.broadcast(more))  # one row


def page_per_kind(rows: DataFrame, size: int) -> DataFrame:
    """rows(kind, id, key) to the first `size` of every kind by id, with how many there are and whether more follow."""
    if not 1 <= size <= MOST:
        raise ValueError(f"page size must be 1 to {MOST}")
    totals = rows.groupBy("kind").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("id", "key"))
    return rows.withColumn("place", place).where(F.col("place") <= size).join(totals, "kind").withColumn("has_next_page", F.col("total") > size)


def lookup(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(request_id, kind, found, code) for asked(request_id, kind, id, key, parent): an entity by id or by key, never both.

    entities(kind, id, key, parent): a key is unique within its kind and parent (a chunk's item; null for others).
    Asking by both or neither is INVALID_INPUT; what is not there is ENTITY_NOT_FOUND.
    """
    wrong = F.col("id").isNull() == F.col("key").isNull()
    by_id = asked.where(~wrong & F.col("id").isNotNull()).join(entities.select("kind", "id", F.col("id").alias("found")), ["kind", "id"], "left")
    e = entities.select(F.col("kind").alias("k"), F.col("key").alias("x"), F.col("parent").alias("p"), F.col("id").alias("found"))
    keyed = asked.where(~wrong & F.col("key").isNotNull())
    by_key = keyed.join(e, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("x")) & F.col("parent").eqNullSafe(F.col("p")), "left")
    bad = asked.where(wrong).withColumn("found", F.lit(None).cast("long"))
    out = by_id.select("request_id", "kind", "found").unionByName(by_key.select("request_id", "kind", "found")).withColumn("code", F.when(F.col("found").isNull(), "ENTITY_NOT_FOUND"))
    return out.unionByName(bad.select("request_id", "kind", "found", F.lit("INVALID_INPUT").alias("code")))


def children(links: DataFrame) -> DataFrame:
    """(parent_kind, parent, child_kind, n, first, last) of links(parent_kind, parent, child_kind, child, place): how many there are and both ends in order of place, then child.

    Combined before the shuffle, so a parent with very many children is a few rows.
    """
    at = F.struct("place", "child")
    ends = links.groupBy("parent_kind", "parent", "child_kind").agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    return ends.select("parent_kind", "parent", "child_kind", "n", F.col("a.child").alias("first"), F.col("b.child").alias("last"))


def backlinks(uses: DataFrame) -> DataFrame:
    """(kind, id, used_by_kind, n, first) of uses(kind, id, used_by_kind, used_by): who refers to an entity, each once."""
    once = uses.distinct()
    return once.groupBy("kind", "id", "used_by_kind").agg(F.count("*").alias("n"), F.min("used_by").alias("first"))
