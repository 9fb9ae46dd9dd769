"""The training-data pipeline: each stage reads what the one before it kept, written as Parquet and read again.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows and ids and other columns
of any name; it returns COLUMNS (the last one its pieces), whole texts, and no rows for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm import decontaminate, jaccard, packing, queries, secret_scan, toxicity
from sparkwell.llm.stash import new_folder, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learnt from the labels that operator 6 may learn from.

    A document without words, and every document when there is nothing to learn from, stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels, queries.remainder(5) != 0).where("predicted = 0").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every group of linked ones; documents without words all stay.

    Rows that repeat a doc_id stay or go together.
    """
    groups = written(jaccard.jaccard_groups(docs))
    stay = groups.where("component_id IS NULL OR doc_id = component_id").select("doc_id").distinct()
    # the ids may be as many as the documents, so the join shuffles at every size
    return docs.join(stay.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; one without words stays, and all do when there is no benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT contaminated").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a marker and n_chars counted again where the text changed; a null text stays null."""
    found = secret_scan.scan_secrets(docs)
    changed: Column = F.col("spans") != ""
    kept = [F.col(c) for c in COLUMNS]
    kept[1] = F.when(changed, F.col("redacted")).otherwise(F.col("text")).alias("text")
    kept[4] = F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*kept)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place there; a document without a text is its end id alone."""
    pieces = packing.pieces(docs.select("doc_id", "text"), queries.tokenizer_file())
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The first stage is a trained classifier, which SQL cannot state; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
