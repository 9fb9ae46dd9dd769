"""Vectors from a function of the user's: texts in, vectors out, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that the function is given at once.
BATCH = 64


def embed(rows: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], dim: int, batch: int = BATCH) -> DataFrame:
    """rows plus vector: every different text is given to the provider once, in batches of at most `batch`.

    A vector that has not `dim` numbers, or an answer with another number of vectors than texts, fails the job. A null
    text has a null vector. The provider runs in the tasks, so it must be a function that can be sent there.
    """
    texts = rows.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.column(0).slice(at, batch)
                vectors = provider(some.to_pylist())
                if len(vectors) != len(some) or any(len(v) != dim for v in vectors):
                    raise ValueError(f"EMBEDDING_DIMENSION_MISMATCH: {len(some)} vectors of {dim} numbers are wanted")
                yield pa.RecordBatch.from_arrays([some, pa.array(vectors, pa.list_(pa.float64()))], names=["text", "vector"])

    return rows.drop("vector").join(texts.mapInArrow(run, "text string, vector array<double>").withColumnRenamed("text", text), text, "left")
