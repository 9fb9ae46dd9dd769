"""Fuzzy joins: trigram similarity by shared trigrams, and nearest keys by edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from sparkwell.functions import text as T
from sparkwell.operators.cuts import cut

#: Left rows that are broadcast to where the right ones are; more of them meet the right ones by shuffled joins.
TEXT_BLOCK = 1024
#: Slices of the rows of a right text, and tasks to which they are dealt, where pairs of texts become pairs of rows.
SLICES, TASKS = 16, 400
#: Pairs that a task holds at once.
CELLS = 1 << 20


def few_texts(left: DataFrame, left_id: str, left_text: str) -> pa.Table | None:
    """(id, text, trigrams) of left rows with a text, if they are at most TEXT_BLOCK."""
    some = left.where(F.col(left_text).isNotNull()).select(F.col(left_id).alias("id"), F.col(left_text).alias("t"), T.trigrams(F.col(left_text)).alias("g")).limit(TEXT_BLOCK + 1).toArrow()  # of bounded size
    return some if len(some) <= TEXT_BLOCK else None


def _shared(grams: pa.Array, vocabulary: pa.Array, has: np.ndarray) -> np.ndarray:
    """How many of its trigrams each text shares with each left one; has: vocabulary by left texts."""
    row = np.repeat(np.arange(len(grams)), pc.list_value_length(grams).to_numpy(zero_copy_only=False))
    at = pc.fill_null(pc.index_in(grams.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    row, at = row[at >= 0], at[at >= 0]
    out = np.zeros((len(grams), has.shape[1]), np.int16)
    step = max(1, 16 * CELLS // max(1, has.shape[1]))
    for i in range(0, len(at), step):  # a text that is cut here is added up from both sides
        rows, first = np.unique(row[i : i + step], return_index=True)
        out[rows] += np.add.reduceat(has[at[i : i + step]], first, axis=0)
    return out


def matches(some: pa.Table, left_id: StructField, right: DataFrame, right_text: str, least: float = T.SIMILAR, inside: bool = False) -> DataFrame:
    """right without its text, beside left_id, score and held, for pairs with trigram similarity above `least`.

    some: see few_texts. inside: also pairs whose right text holds the left one (held). The left texts are broadcast and
    right rows are compared where they are, equal ones of a batch once, so nothing is shuffled and only matches leave a task.
    """
    kept = [c for c in right.columns if c != right_text]
    rows = right.where(F.col(right_text).isNotNull()).select(*kept, F.col(right_text).alias("_t"), T.trigrams(F.col(right_text)).alias("_g"))
    flat = some["g"].combine_chunks().flatten() if len(some) else pa.array([], pa.string())
    vocabulary = flat.unique()
    n_left = np.array([len(g) for g in some["g"].to_pylist()], np.int32)
    has = np.zeros((len(vocabulary), len(some)), np.int16)
    has[pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(some)), n_left)] = 1
    shared = right.sparkSession.sparkContext.broadcast((some["id"].combine_chunks() if len(some) else some["id"], some["t"].to_pylist(), vocabulary, n_left, has))
    schema = StructType([left_id, *[right.schema[c] for c in kept], StructField("score", DoubleType()), StructField("held", BooleanType())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, words, n_a, at = shared.value
        for whole in batches:
            step = max(1, CELLS // max(1, len(texts)))
            for i in range(0, whole.num_rows if texts else 0, step):
                b = whole.slice(i, step)
                coded = b.column(len(kept)).dictionary_encode()
                of = coded.indices.to_numpy(zero_copy_only=False)
                _, first = np.unique(of, return_index=True)
                grams = b.column(len(kept) + 1).take(pa.array(first))
                n_b = pc.list_value_length(grams).to_numpy(zero_copy_only=False)
                both = _shared(grams, words, at)
                union = n_b[:, None] + n_a[None, :] - both
                score = np.divide(both, union, out=np.zeros(both.shape), where=union > 0)
                held = np.zeros(both.shape, bool)
                if inside:
                    for k, x in enumerate(texts):
                        held[:, k] = pc.match_substring(coded.dictionary, x).to_numpy(zero_copy_only=False) if x else False
                r, k = np.nonzero(((score > least) | held)[of])
                u, r = of[r], pa.array(r)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), *[b.column(j).take(r) for j in range(len(kept))], pa.array(score[u, k]), pa.array(held[u, k])], names=schema.names)

    return rows.mapInArrow(met, schema)


def trigram_join(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str, least: float = T.SIMILAR, digits: int | None = None) -> DataFrame:
    """(left_id, right_id, score) of pairs with trigram similarity above `least`; digits: to which scores are rounded.

    Texts are grouped first, so equal ones are compared once. A text meets others by its rarest trigrams only: with
    more than `least` of the union shared, one of the first n - ceil(least * n) + 1 trigrams (by frequency) is shared.
    Up to TEXT_BLOCK left rows are broadcast instead (see matches). Otherwise pairs of texts are rounded, and then dealt by
    the right text and a slice of its rows, so a text that many rows have is no task of its own.
    """
    exact = F.col("score") if digits is None else F.round("score", digits)
    few = few_texts(left, left_id, left_text)
    if few is not None:
        named = right.select(F.col(right_id), F.col(right_text).alias("tb"))
        return matches(few, left.schema[left_id], named, "tb", least).select(left_id, right_id, exact.alias("score"))

    def texts(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.col(c).alias("t")).where("t IS NOT NULL").distinct().withColumn("g", T.trigrams(F.col("t"))).where(F.size("g") > 0)

    a, b = cut(texts(left, left_text)), cut(texts(right, right_text))
    rare = a.select(F.explode("g").alias("gram")).unionByName(b.select(F.explode("g").alias("gram"))).groupBy("gram").agg(F.count("*").alias("df"))

    def prefixes(df: DataFrame) -> DataFrame:
        ranked = df.select("t", F.size("g").alias("n"), F.explode("g").alias("gram")).join(rare, "gram")
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy("df", "gram")))
        return ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("gram", "t", "n")

    pa, pb = prefixes(a).alias("a"), prefixes(b).alias("b")
    near = pa.join(pb, "gram").where((F.col("a.n") * least <= F.col("b.n")) & (F.col("b.n") * least <= F.col("a.n")))
    pairs = near.select(F.col("a.t").alias("ta"), F.col("b.t").alias("tb")).distinct()
    both = pairs.join(a.select(F.col("t").alias("ta"), F.col("g").alias("ga")), "ta").join(b.select(F.col("t").alias("tb"), F.col("g").alias("gb")), "tb")
    shared = F.size(F.array_intersect("ga", "gb"))
    scored = both.select("ta", "tb", (shared / (F.size("ga") + F.size("gb") - shared)).alias("score")).where(F.col("score") > least)
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)).cast("array<bigint>"))
    named = left.select(F.col(left_id), F.col(left_text).alias("ta")).join(scored.select("ta", "tb", exact.alias("score")), "ta").select(left_id, "tb", "score", slices.alias("slice"))
    dealt = right.select(F.col(right_id), F.col(right_text).alias("tb"), F.pmod(F.xxhash64(right_id), F.lit(SLICES)).alias("slice")).where("tb IS NOT NULL")
    # pairs of rows are many times what is shuffled for them, so its size must not decide how few tasks make them
    return named.repartition(TASKS, "tb", "slice").hint("merge").join(dealt, ["tb", "slice"]).select(left_id, right_id, "score")


def suggest(words: DataFrame, word: str, keys: DataFrame) -> DataFrame:
    """words plus suggestion and distance: the nearest of keys(key), ties to the lexically first, within max(2, length / 3) edits.

    With t edits one of t + 1 segments of a key stands unchanged in the word, at most t places off. So the segments of a
    key meet the equal parts of words with that t. Places and sizes are cut into ranges of 2t + 1, of which a word meets
    two, so a word makes rows in proportion to its letters; a key makes its segments for those t which words of about
    its size have. What met is held against the exact bounds, and then the edits are counted.
    """
    n = F.length("w")
    asked = cut(words.select(F.col(word).alias("w")).where("w IS NOT NULL").distinct().withColumn("t", F.greatest(F.lit(2), F.floor(n / 3)).cast("int")))
    wide = 2 * F.col("t") + 1

    def ranges(centre: Column) -> Column:
        """The ranges that the places up to t away from this one lie in."""
        at = lambda c: F.floor(c / wide).cast("int")
        return F.explode(F.sequence(at(F.greatest(F.lit(0), centre - F.col("t"))), at(centre + F.col("t"))))

    # a word of 3t to 3t + 2 letters, or of at most 8 where t is 2, may be t letters longer or shorter than the key
    size = F.length("key")
    k = keys.select("key").where("key IS NOT NULL").distinct().withColumn("t", F.explode(F.sequence(F.greatest(F.lit(2), F.ceil((size - 2) / 4).cast("int")), F.greatest(F.lit(2), F.floor(size / 2).cast("int")))))
    k = k.join(asked.select("t").distinct(), "t").withColumn("size", size).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t"))))
    short, longer = F.floor(F.col("size") / (F.col("t") + 1)).cast("int"), F.pmod("size", F.col("t") + 1)
    late = F.greatest(F.lit(0), F.col("i") - (F.col("t") + 1 - longer))  # the last `longer` segments have a letter more
    k = k.withColumn("at", F.col("i") * short + late + 1).withColumn("part", F.substring("key", F.col("at"), short + (F.col("i") >= F.col("t") + 1 - longer).cast("int")))
    k = k.select("t", "key", "size", "at", "part", F.floor(F.col("at") / wide).cast("int").alias("at_range"), F.floor(F.col("size") / wide).cast("int").alias("size_range"))
    least, most = (F.floor(F.greatest(F.lit(0), c) / (F.col("t") + 1)).cast("int") for c in (n - F.col("t"), n + F.col("t")))
    w = asked.withColumn("len", F.explode(F.sequence(least, most + 1))).where(F.col("len") <= n).withColumn("from", F.explode(F.sequence(F.lit(1), n - F.col("len") + 1)))
    w = w.withColumn("part", F.substring("w", F.col("from"), F.col("len"))).withColumn("at_range", ranges(F.col("from"))).withColumn("size_range", ranges(n))
    met = w.join(k, ["t", "part", "at_range", "size_range"]).where((F.abs(F.col("from") - F.col("at")) <= F.col("t")) & (F.abs(n - F.col("size")) <= F.col("t")))
    # t comes out of the grouping, so that edits are counted after it, once a pair
    near = met.groupBy("w", "key").agg(F.min("t").alias("t")).withColumn("distance", F.expr("levenshtein(w, key, t)")).where("distance >= 0")
    best = near.groupBy("w").agg(F.min(F.struct("distance", "key")).alias("best")).select(F.col("w").alias(word), F.col("best.key").alias("suggestion"), F.col("best.distance").alias("distance"))
    return words.join(best, word, "left")
