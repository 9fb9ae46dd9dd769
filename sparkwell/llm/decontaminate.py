"""Benchmark decontamination by winnowing: selected k-gram hashes of documents meet those of benchmark items; hits are extended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.llm.jaccard import _member as member
from sparkwell.llm.jaccard import bitmap
from sparkwell.llm.stash import free, small_batches, written
from sparkwell.llm.text import ALNUM, gram_hashes, gram_mask, slices, split_words

#: Words of a window that counts as a hit.
WINDOW = 10
#: Words of a fingerprinted gram; every WINDOW words hold WINDOW - GRAM + 1 grams, the least of which is kept.
GRAM = 5
#: Bytes of benchmark text up to which its index is broadcast; fingerprints of a larger benchmark meet those of documents by a shuffle.
BLOCK_BYTES = 8 << 20
#: Words around a fingerprint that may belong to a window with it: those before its gram, and the gram with those after it.
BEFORE, AFTER = WINDOW - GRAM, WINDOW
#: Parts into which the documents of one fingerprint are dealt in the shuffled join; the items of it go to each.
SALTS = 16
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("item", pa.string())]))


@dataclass
class BlockIndex:
    """Word hashes of some items laid end to end, their fingerprints, and whole short items by length."""

    words: np.ndarray
    bounds: np.ndarray
    ids: list
    prints: np.ndarray
    places: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def winnow(grams: np.ndarray, usable: np.ndarray, span: int) -> np.ndarray:
    """Places of the least gram in every `span` consecutive usable ones (all of them where the least is repeated)."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, whole = grams[:n].copy(), usable[:n].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : j + n], out=least)
        whole &= usable[j : j + n]
    keep = np.zeros(len(grams), bool)
    for j in range(span):
        keep[j : j + n] |= whole & (grams[j : j + n] == least)
    return np.flatnonzero(keep)


def build_index(ids: list, texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> BlockIndex:
    hashes, bounds = [np.zeros(0, np.uint64)], [0]
    for _, _, data, offsets in slices(texts):
        w = split_words(data, offsets, ALNUM)
        hashes.append(w.hashes)
        bounds += (w.bounds[1:] + bounds[-1]).tolist()
    words, bounds = np.concatenate(hashes), np.array(bounds)
    sizes = np.diff(bounds)
    grams = gram_hashes(words, gram)
    at = winnow(grams, gram_mask(bounds, gram, len(words)), window - gram + 1)
    order = np.argsort(grams[at], kind="stable")
    short = {}
    for n in np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist():
        which = np.flatnonzero(sizes == n)
        h = gram_hashes(words, n)[bounds[which]]
        o = np.argsort(h, kind="stable")
        short[n] = (h[o], which[o])
    return BlockIndex(words, bounds, ids, grams[at][order], at[order], short)


def _range(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in values, place in the sorted table) of equal entries."""
    if not len(table) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.searchsorted(table, values)
    hit = np.flatnonzero((lo < len(table)) & (table[np.minimum(lo, len(table) - 1)] == values))
    lo = lo[hit]
    n = np.searchsorted(table, values[hit], "right") - lo
    total = np.cumsum(n)
    return np.repeat(hit, n), np.arange(total[-1] if len(total) else 0) - np.repeat(total - n - lo, n)


def find_spans(hashes: np.ndarray, bounds: np.ndarray, index: BlockIndex, window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(row, first word, last word + 1, item place) of every maximal run that holds an item window."""
    found: set[tuple[int, int, int, int]] = set()
    grams = gram_hashes(hashes, gram)
    at = winnow(grams, gram_mask(bounds, gram, len(hashes)), window - gram + 1)
    where, which = _range(index.prints, grams[at])
    here, there = at[where], index.places[which]
    rows = np.searchsorted(bounds, here, "right") - 1
    items = np.searchsorted(index.bounds, there, "right") - 1
    order = np.lexsort((here, there - here, items, rows))
    reached: dict = {}
    for row, item, p, q in zip(rows[order].tolist(), items[order].tolist(), here[order].tolist(), there[order].tolist(), strict=True):
        line = (row, item, q - p)
        if reached.get(line, -1) >= p + gram:
            continue
        a, b = p, p + gram  # equal hashes, but each word is compared below
        back, ahead = min(p - bounds[row], q - index.bounds[item]), min(bounds[row + 1] - p, index.bounds[item + 1] - q)
        left = hashes[p - back : p] == index.words[q - back : q]
        right = hashes[p : p + ahead] == index.words[q : q + ahead]
        a = p - (back if left.all() else int(np.argmin(left[::-1])))
        b = p + (ahead if right.all() else int(np.argmin(right)))
        reached[line] = b
        if b - a >= window:
            found.add((row, a - int(bounds[row]), b - int(bounds[row]), item))
    for n, (table, owner) in index.short.items():
        g = gram_hashes(hashes, n)
        ok = np.flatnonzero(gram_mask(bounds, n, len(hashes)))
        where, which = _range(table, g[ok])
        for p, item in zip(ok[where].tolist(), owner[which].tolist(), strict=True):
            row = int(np.searchsorted(bounds, p, "right")) - 1
            found.add((row, p - int(bounds[row]), p - int(bounds[row]) + n, item))
    return sorted(found)


def fingerprint_rows(batches: Iterator[pa.RecordBatch], lengths: list[int], items: bool, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The columns before the last, which is the text, for each of its fingerprints, with print, size, place and around.

    Of items those are the winnowed grams (size WINDOW), and the whole of an item of fewer words (size: its words). Of
    documents they are the winnowed grams and the grams of every length of `lengths`, as far as `wanted` marks them.
    around: hashes of the BEFORE words ahead of a winnowed gram and the AFTER from its first on; words outside the text
    are 1 in items and 0 in documents, so they never agree.
    """
    for batch in batches:
        for lo, _, data, offsets in slices(batch.column(batch.num_columns - 1)):
            w = split_words(data, offsets, ALNUM)
            for size in lengths:
                k = GRAM if size == WINDOW else size
                grams, usable = gram_hashes(w.hashes, k), gram_mask(w.bounds, k, len(w.hashes))
                at = winnow(grams, usable, WINDOW - GRAM + 1) if size == WINDOW else np.flatnonzero(usable)
                if wanted is not None:
                    at = at[member(grams[at], wanted)]
                row = np.searchsorted(w.bounds, at, "right") - 1
                if items and size < WINDOW:
                    at, row = at[w.counts[row] == size], row[w.counts[row] == size]
                if not len(at):
                    continue
                near = at[:, None] + np.arange(-BEFORE, AFTER if size == WINDOW else -BEFORE)
                inside = (near >= w.bounds[row][:, None]) & (near < w.bounds[row + 1][:, None])
                words = np.where(inside, w.hashes[np.clip(near, 0, len(w.hashes) - 1)], np.uint64(items))
                around = pa.Array.from_buffers(pa.binary(8 * near.shape[1]), len(at), [None, pa.py_buffer(words.tobytes())]).cast(pa.binary())
                kept = [batch.column(c).take(pa.array(lo + row)) for c in range(batch.num_columns - 1)]
                new = [pa.array(grams[at].view(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array(at - w.bounds[row]), around]
                yield pa.RecordBatch.from_arrays(kept + new, names=[*batch.schema.names[:-1], "print", "size", "place", "around"])


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, piece, item, line, first, last) of met fingerprints around which the words of a whole window agree."""
    for b in batches:
        size, place, there = (b.column(c).to_numpy() for c in ("size", "place", "there"))
        first, last = place.copy(), place + size
        long = np.flatnonzero(size == WINDOW)
        if len(long):
            mine, other = (np.frombuffer(b"".join(b.column(c).take(pa.array(long)).to_pylist()), np.uint64).reshape(len(long), -1) for c in ("around", "facing"))
            same = mine == other
            first[long] -= np.logical_and.accumulate(same[:, :BEFORE][:, ::-1], axis=1).sum(1)
            last[long] = place[long] + np.logical_and.accumulate(same[:, BEFORE:], axis=1).sum(1)
        hit = pa.array(last - first >= size)
        out = [b.column("mark"), b.column("piece"), b.column("item"), pa.array(there - place), pa.array(first), pa.array(last)]
        yield pa.RecordBatch.from_arrays([c.filter(hit) for c in out], names=["mark", "piece", "item", "line", "first", "last"])


def shared_spans(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(mark, found) of the texts(mark, text) that hold a window of items(item, text); found lists the maximal runs.

    Fingerprints of both sides are joined by a shuffle. The benchmark's mark bits of a bitmap of fixed size, so hardly a
    fingerprint leaves a document that meets none, and each carries the words that may form a window with it: runs are
    compared where two meet, no text is fetched. Copies of a text are one mark and go on once. A fingerprint that many
    documents hold is dealt into SALTS parts. Pieces of one run overlap, as each window of it has a fingerprint of its
    own, and are merged along their line (place in the item less place in the text).
    """
    spark = texts.sparkSession
    kinds = "print long, size int, place long, around binary"
    named = items.where("text IS NOT NULL").select("item", F.xxhash64("item", "text").alias("piece"), "text").distinct()
    every = list(range(1, WINDOW + 1))
    theirs = written(named.mapInArrow(lambda batches: fingerprint_rows(batches, every, True), f"item string, piece long, {kinds}"))
    lengths = sorted(r[0] for r in theirs.select("size").distinct().collect())  # WINDOW of them at most
    wanted = spark.sparkContext.broadcast(bitmap(theirs.select("print")))
    ours = texts.mapInArrow(lambda batches: fingerprint_rows(batches, lengths, False, wanted.value), f"mark binary, {kinds}").distinct()
    dealt = ours.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int"))
    facing = theirs.select("item", "piece", "print", "size", F.col("place").alias("there"), F.col("around").alias("facing"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = dealt.join(facing, ["print", "size", "salt"]).select("mark", "piece", "item", "size", "place", "there", "around", "facing")
    runs = met.mapInArrow(agreeing, "mark binary, piece long, item string, line long, first long, last long")
    line = Window.partitionBy("mark", "piece", "item", "line").orderBy("first", "last")
    apart = F.col("first") > F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("long")).withColumn("run", F.sum("apart").over(line))
    whole = islands.groupBy("mark", "piece", "item", "line", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.groupBy("mark").agg(F.collect_set(F.struct("first", "last", "item")).alias("found"))


def _search(column: pa.Array, index: BlockIndex | None) -> tuple[np.ndarray, list[list[dict]]]:
    """Words and, by a broadcast index, spans of every row."""
    spans: list[list] = [[] for _ in range(len(column))]
    counts = np.zeros(len(column), np.int64)
    for lo, hi, data, offsets in slices(column):
        w = split_words(data, offsets, ALNUM)
        counts[lo:hi] = w.counts
        if index is not None:
            for row, a, b, item in find_spans(w.hashes, w.bounds, index):
                spans[lo + row].append({"first": a, "last": b, "item": index.ids[item]})
    return counts, spans


def covered(spans: list[dict]) -> tuple[int, list[str]]:
    """Number of words inside any span, and the sorted distinct item ids."""
    hit, upto = 0, 0
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        hit += max(0, s["last"] - max(upto, s["first"]))
        upto = max(upto, s["last"])
    return hit, sorted({s["item"] for s in spans})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs plus n_words, n_hit, spans (first word, last word + 1, item), items (sorted ids with occurring windows), items_sha256 and contaminated.

    Fingerprints of documents and benchmark are joined: those of a benchmark of up to block_bytes of text are broadcast
    and met in one pass without a shuffle, those of a larger one meet by a shuffle (shared_spans), with equal results.
    Every run of WINDOW shared words holds a kept fingerprint on both sides, so none is missed; runs are then compared
    word by word in both directions.
    Items of fewer words are compared whole. One row per input row: null texts have no words, a document without hits
    has no items and the hash of the empty string; null items and items without words match nothing; an item without
    an id counts under the id "null". Rows are searched one by one, so repeated rows get equal answers; a very long text
    is searched whole; an empty table on either side gives no rows or no hits. Columns of docs with the names of new
    ones are replaced, all others stay.
    """
    small_batches(docs.sparkSession)
    new = ["n_words", "n_hit", "spans", "items", "items_sha256", "contaminated"]
    out = docs.drop(*new)
    found = free(out, "found")[0]
    names = out.schema.names
    schema = out.selectExpr("*", "0L n_words", "0L n_hit", "CAST(array() AS array<struct<first:bigint,last:bigint,item:string>>) spans", "CAST(array() AS array<string>) items", "'' items_sha256", "false contaminated").schema
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    found_type = "array<struct<first:bigint,last:bigint,item:string>>"
    index = None
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes:
        some = items.distinct().collect()  # of bounded size
        index = docs.sparkSession.sparkContext.broadcast(build_index([r["item"] for r in some], pa.array([r["text"] for r in some], pa.string())))
        out = out.withColumn(found, F.expr(f"CAST(array() AS {found_type})"))
    else:
        # copies of a text have one mark; a null text has that of the empty one, and no spans
        mark, salt = free(out, "mark", "salt")
        # copies of one text lie in many partitions, and the rows of a partition go to one part of their mark
        out = out.withColumn(mark, F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))).withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        spans = written(shared_spans(out.select(F.col(mark).alias("mark"), F.col(text).alias("text")), items))
        spans = spans.select(F.col("mark").alias(mark), F.col("found").alias(found), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        out = out.join(spans, [mark, salt], "left").select(*names, F.coalesce(found, F.expr("array()")).cast(found_type).alias(found))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, spans = _search(b.column(text), None if index is None else index.value)
            spans = [sorted(x or y, key=lambda s: (s["first"], s["last"], s["item"])) for x, y in zip(spans, b.column(found).to_pylist(), strict=True)]
            got = [covered(s) for s in spans]
            cols = [b.column(c) for c in names] + [pa.array(counts), pa.array([h for h, _ in got], pa.int64()), pa.array(spans, SPANS), pa.array([i for _, i in got], pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, i in got], pa.string()), pa.array([h > 0 for h, _ in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return out.mapInArrow(finish, schema)
