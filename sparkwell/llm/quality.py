"""Quality: hashed word and character n-gram vectors averaged per document, softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.linear import Features, byte_grams, merged, row_sums, sample_by_class, softmax, temperature, train_softmax
from sparkwell.llm.stash import small_batches
from sparkwell.llm.text import NON_SPACE, slices, split_words

BITS = 17
CHARS = (3, 4)
#: Words back to which a word is compared: a repeated word is a word n-gram of its own.
BACK = 8
#: Labelled documents per class that the model is fitted on; a fifth of them calibrate it.
SAMPLE_PER_CLASS = 2000


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(column: pa.Array) -> Iterator[tuple[int, int, list[Features]]]:
    """Runs of rows with the buckets of words, word pairs, repeats of the last words, and raw character n-grams."""
    for lo, hi, data, offsets in slices(column):
        w = split_words(data, offsets, NON_SPACE)
        h, at = w.hashes, w.bounds
        row = np.repeat(np.arange(hi - lo), w.counts)
        batches = [(_bucket(h), at)]
        for k in range(1, BACK + 1):
            again = (h[k:] == h[:-k]) & (row[k:] == row[:-k])
            batches.append((np.full(int(again.sum()), k, np.int64), np.concatenate([[0], np.cumsum(again)])[np.maximum(0, np.minimum(at, len(h)) - k)] if len(h) > k else np.zeros(len(at), np.int64)))
        pair = row[1:] == row[:-1]
        both = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        batches.append((_bucket(both[pair]), np.concatenate([[0], np.cumsum(pair)])[np.maximum(0, at - 1)] if len(h) > 1 else np.zeros(len(at), np.int64)))
        raw = np.where((data >= 9) & (data <= 13), np.uint8(32), data)
        yield lo, hi, [*batches, *byte_grams(raw, offsets, CHARS, BITS)]


class QualityModel:
    def __init__(self, table: np.ndarray, factor: float = 1.0):
        self.table, self.factor = table, factor

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), 2))
        for lo, hi, batches in features(column):
            n = np.maximum(1, sum(np.diff(at) for _, at in batches))
            out[lo:hi] = sum(row_sums(self.table[b], at) for b, at in batches) / n[:, None]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return softmax(self.logits(column) * self.factor)[:, 1]


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """A model from labelled texts; equal texts count once, a fifth is held back for the calibration."""
    pairs = sorted(set(zip(texts, labels, strict=True)))
    column, target = pa.array([t for t, _ in pairs], pa.string()), np.array([int(q) for _, q in pairs], int)
    if len(set(target.tolist())) < 2:
        return QualityModel(np.zeros((1 << BITS, 2), np.float32))
    docs: list = []
    for lo, hi, batches in features(column):
        docs += merged(batches, hi - lo)
    held = np.random.default_rng(1).permutation(len(docs)) % 5 == 4
    model = QualityModel(train_softmax([d for d, h in zip(docs, held, strict=True) if not h], target[~held], 2, 1 << BITS))
    model.factor = temperature(model.logits(column.filter(pa.array(held))), target[held])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, per_class: int, text: str, id_col: str) -> list:
    """(text, label) of about per_class documents of each label of 0 and 1, chosen by a hash of their id."""
    able = labels.where(learn & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label")).distinct()
    chosen = sample_by_class(able, "label", per_class, F.col("id"))  # bounded, so that it can be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), "id").select("text", "label").collect()


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", label: str = "quality", id_col: str = "doc_id", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """docs plus score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    learn: which rows of labels may be learnt from. The fit takes about per_class of each label on the driver; scores
    read nothing but the text, whole, in one pass without a shuffle. A null text counts as empty; an empty text, like
    every text when nothing can be learnt, gets 0.5. Rows are scored one by one, so repeated rows and ids get equal
    scores; an id with both labels is learnt with both; an empty table gives an empty result. Columns called score or
    predicted are replaced, all others stay.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    got = labelled_sample(docs, labels, learn, label, per_class, text, id_col)
    model = docs.sparkSession.sparkContext.broadcast(fit([r[0] for r in got], [r[1] for r in got]))
    names = docs.schema.names
    schema = docs.selectExpr("*", "0D score", "0 predicted").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.value.score(b.column(text)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)
