"""Evaluations: expectations against delivered results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assertions(expected: DataFrame, delivered: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """expected(case_id, kind, ref_a, ref_b, within) plus passed; delivered(case_id, ref, rank) holds what was packed, resolved(case_id, ref) the concepts.

    include, exclude, topk (rank <= within) and outranks (ref_a before ref_b); a missing rank fails. resolved: ref_a is
    among the concepts of the case.
    """
    a = delivered.select("case_id", F.col("ref").alias("ref_a"), F.col("rank").alias("rank_a"))
    b = delivered.select("case_id", F.col("ref").alias("ref_b"), F.col("rank").alias("rank_b"))
    c = (delivered.limit(0) if resolved is None else resolved).select("case_id", F.col("ref").alias("ref_a")).distinct().withColumn("known", F.lit(True))
    both = expected.join(a, ["case_id", "ref_a"], "left").join(b, ["case_id", "ref_b"], "left").join(c, ["case_id", "ref_a"], "left")
    passed = (
        F.when(F.col("kind") == "include", F.col("rank_a").isNotNull())
        .when(F.col("kind") == "exclude", F.col("rank_a").isNull())
        .when(F.col("kind") == "topk", F.col("rank_a") <= F.col("within"))
        .when(F.col("kind") == "resolved", F.col("known"))
        .when(F.col("kind") == "outranks", F.col("rank_a") < F.col("rank_b"))
    )
    return both.select("case_id", "kind", "ref_a", "ref_b", "within", F.coalesce(passed, F.lit(False)).alias("passed"))


def report(results: DataFrame) -> DataFrame:
    """(kind, n_passed, n_failed, failed_cases): failed cases are kept."""
    failed = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("case_id")))), lambda x: x.cast("string")), ",")
    return results.groupBy("kind").agg(F.count_if(F.col("passed")).alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), failed.alias("failed_cases"))


def references(chunks: DataFrame) -> DataFrame:
    """(ref, chunk_id): item key, "#", chunk key."""
    return chunks.select(F.concat_ws("#", F.col("item_id").cast("string"), F.when(F.col("part_key") == "", "intro").otherwise(F.col("part_key"))).alias("ref"), "chunk_id")
