"""Language identification: averaged vectors of hashed subwords, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.linear import Features, byte_grams, merged, row_sums, sample_by_class, softmax, temperature, train_softmax
from sparkwell.llm.stash import free, small_batches
from sparkwell.llm.text import slices

BITS = 16
GRAMS = (2, 3, 4)
#: Labelled documents per language that the model is fitted on; a fifth of them calibrate it.
SAMPLE_PER_CLASS = 1500
#: Accuracy that accepted documents should have.
TRUST = 0.99
UNKNOWN = "und"

_LETTERS = np.zeros(256, np.uint8)
for _b in range(256):
    _LETTERS[_b] = _b + 32 if 65 <= _b <= 90 else _b if 97 <= _b <= 122 or _b >= 128 else 0


def features(column: pa.Array) -> Iterator[tuple[int, int, list[Features]]]:
    """(first row, last row + 1, features) of runs of rows: n-grams of lower-cased letters, everything else is one gap."""
    for lo, hi, data, offsets in slices(pc.utf8_lower(column.cast(pa.large_string()))):
        low = _LETTERS[data]
        keep = low != 0
        keep[1:] |= low[:-1] != 0
        bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
        yield lo, hi, list(byte_grams(low[keep], bounds, GRAMS, BITS))


class LanguageModel:
    def __init__(self, langs: list[str], table: np.ndarray, factor: float, least: float):
        self.langs, self.table, self.factor, self.least = langs, table, factor, least

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.langs)))
        for lo, hi, batches in features(column):
            n = np.maximum(1, sum(np.diff(at) for _, at in batches))
            out[lo:hi] = sum(row_sums(self.table[b], at) for b, at in batches) / n[:, None]
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of the best language, its calibrated probability)"""
        p = softmax(self.logits(column) * self.factor)
        return p.argmax(1), p.max(1)


def fit(texts: list[str], langs: list[str], seed: int = 3) -> LanguageModel:
    """A model from labelled texts; equal texts count once, a fifth is held back for the calibration."""
    pairs = sorted(set(zip(texts, langs, strict=True)), key=lambda p: (p[1], hash_text(p[0])))
    names = sorted({l for _, l in pairs})
    column, target = pa.array([t for t, _ in pairs], pa.string()), np.array([names.index(l) for _, l in pairs], int)
    docs: list = []
    for lo, hi, batches in features(column):
        docs += merged(batches, hi - lo)
    held = np.arange(len(docs)) % 5 == 4
    table = train_softmax([d for d, h in zip(docs, held, strict=True) if not h], target[~held], len(names), 1 << BITS, seed=seed)
    model = LanguageModel(names, table, 1.0, 0.0)
    rest = column.filter(pa.array(held))
    z = model.logits(rest)
    model.factor = temperature(z, target[held])
    if len(z):
        best, score = model.predict(rest)
        order = np.argsort(-score, kind="stable")
        right = np.cumsum((best == target[held])[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= TRUST)
        model.least = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """docs plus lang_pred, score and accepted.

    learn: which rows may be learnt from (those with a language). The fit takes about per_class of them for each
    language, chosen by a hash of their id, on the driver; prediction reads nothing but the text, whole, in one pass
    without a shuffle. lang_pred is a learnt language, or "und" with score 0 for a null text or one without letters;
    accepted tells whether the calibrated score is one at which TRUST of the held-back documents were right. Without
    anything to learn from every row is "und". Rows are predicted one by one, so repeated rows and ids get equal
    answers; an empty table gives an empty result. Columns called lang_pred, score or accepted are replaced, all others stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score", "accepted")
    able = docs.where(learn & F.col(lang).isNotNull() & F.col(id_col).isNotNull())
    able = able.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen = sample_by_class(able.select("id", "lang"), "lang", per_class, F.col("id")).distinct()
    got = able.join(F.broadcast(chosen), ["id", "lang"]).where(F.col("text").isNotNull()).select("text", "lang").collect()
    model = spark.sparkContext.broadcast(fit([r[0] for r in got], [r[1] for r in got]))
    (letters,) = free(docs, "letters")
    wide = docs.select("*", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letters))
    names = docs.schema.names
    schema = docs.selectExpr("*", "'' lang_pred", "0D score", "false accepted").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            some = b.column(letters).to_numpy(zero_copy_only=False)
            if m.langs and b.num_rows:
                best, score = m.predict(b.column(text))
                pred = [m.langs[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
                score = np.where(some, score, 0.0)
            else:
                pred, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array((score >= m.least) & some & bool(m.langs), pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + new, names=schema.names)

    return wide.mapInArrow(run, schema)
