"""Incremental builds: hashes, the plan of upserts and deletes, its application, and what must be embedded again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.functions import text as T
from sparkwell.operators.cuts import written
from sparkwell.operators.embedding import embed


def hashes(rows: DataFrame) -> DataFrame:
    """rows(id, title, body, lang, source, priority) plus source_hash, semantic_hash, lexical_hash and compiled_hash.

    A new priority changes the compiled hash alone.
    """
    c = F.col
    return rows.select(
        "*",
        T.canonical_hash(body=c("body"), lang=c("lang"), source=c("source"), title=c("title")).alias("source_hash"),
        F.sha2(T.joined_lines(c("title"), c("body")), 256).alias("semantic_hash"),
        F.sha2(F.concat_ws("\n", F.lower("title"), F.lower("body")), 256).alias("lexical_hash"),
        T.canonical_hash(body=c("body"), lang=c("lang"), priority=c("priority"), source=c("source"), title=c("title")).alias("compiled_hash"),
    )


def plan(stored: DataFrame, built: DataFrame, stale: bool = False) -> DataFrame:
    """(id, action) with action upsert or delete: what differs in compiled or lexical hash (all that is built, when stale), and what is gone."""
    a = stored.select("id", F.col("compiled_hash").alias("old_c"), F.col("lexical_hash").alias("old_l"))
    b = built.select("id", F.col("compiled_hash").alias("new_c"), F.col("lexical_hash").alias("new_l"))
    changed = ~(F.col("old_c").eqNullSafe(F.col("new_c")) & F.col("old_l").eqNullSafe(F.col("new_l")))
    action = F.when(F.col("new_c").isNull(), "delete").when(changed | F.lit(stale), "upsert")
    return a.join(b, "id", "full_outer").select("id", action.alias("action")).where("action IS NOT NULL")


def apply(stored: DataFrame, built: DataFrame, actions: DataFrame) -> DataFrame:
    """The next snapshot: what no action touches, and the built rows of the upserts."""
    keep = stored.join(actions.select("id"), "id", "left_anti")
    return keep.unionByName(built.join(actions.where("action = 'upsert'").select("id"), "id", "left_semi"))


def verify(snapshot: DataFrame, actions: DataFrame) -> DataFrame:
    """(n_missing, n_left): upserted ids that the snapshot lacks and deleted ones that it still has."""
    seen = actions.join(snapshot.select("id", F.lit(True).alias("here")), "id", "left")
    return seen.agg(F.count_if((F.col("action") == "upsert") & F.col("here").isNull()).alias("n_missing"), F.count_if((F.col("action") == "delete") & F.col("here")).alias("n_left"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks; none when an incremental build equals a clean one."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def embed_work(stored: DataFrame, built: DataFrame) -> DataFrame:
    """(semantic_hash, id): one row for every text without a stored vector, with the least id that has it."""
    return built.join(stored.select("semantic_hash").distinct(), "semantic_hash", "left_anti").groupBy("semantic_hash").agg(F.min("id").alias("id"))


def semantic_vectors(rows: DataFrame, store: DataFrame, config: str, provider: Callable[[list[str]], list[list[float]]], dim: int) -> tuple[DataFrame, DataFrame]:
    """(rows plus vector and reused, what the store gains) of rows(semantic_hash, semantic_text, ...).

    store(config_hash, semantic_hash, vector) is addressed by what was embedded and how, so a text that was ever embedded
    under this configuration is not again, whatever row holds it. Every other text goes to the provider once; a vector
    of another dimension than `dim`, in the store or from the provider, fails the job. A null text has no vector.
    """
    wrong = F.raise_error(F.lit(f"EMBEDDING_DIMENSION_MISMATCH: the store has vectors that have not {dim} numbers"))
    mine = store.where(F.col("config_hash") == config).groupBy("semantic_hash").agg(F.first("vector").alias("vector"))
    mine = mine.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(wrong))
    texts = rows.where("semantic_text IS NOT NULL").groupBy("semantic_hash").agg(F.min("semantic_text").alias("semantic_text"))
    missing = written(texts.join(mine, "semantic_hash", "left_anti"))
    made = written(embed(missing, "semantic_text", provider, dim).select("semantic_hash", "vector"))
    known = mine.join(texts, "semantic_hash", "left_semi").select("semantic_hash", "vector", F.lit(True).alias("reused")).unionByName(made.withColumn("reused", F.lit(False)))
    return rows.join(known, "semantic_hash", "left"), made.select(F.lit(config).alias("config_hash"), "semantic_hash", "vector")


def revisions(state: DataFrame, applied: str) -> DataFrame:
    """state(namespace, environment, revision, status) after a build of namespace `applied`: every environment steps on, the active one is superseded."""
    mine = state.where(F.col("namespace") == applied)
    old = mine.withColumn("status", F.when(F.col("status") == "active", "superseded").otherwise(F.col("status")))
    new = mine.where("status = 'active'").withColumn("revision", F.col("revision") + 1)
    return state.where(F.col("namespace") != applied).unionByName(old).unionByName(new)
