"""Exact n-gram Jaccard join: candidates share an n-gram among the first of a global order, tries of ordered sets find the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.components import components
from sparkwell.llm.stash import cut, small_batches, written
from sparkwell.llm.text import NON_SPACE, gram_hashes, gram_mask, mix, slices, split_words

WORDS = 5
#: Documents of a block; the pairs of a larger group of candidates are split into pairs of blocks.
BLOCK = 256
#: N-grams that several documents hold are late in the global order: those counted HOT times among the first n-grams of
#: documents, and those that LOCAL of the documents counted together hold. The order decides how much work there is, never which
#: links are found, so a bitmap of fixed size may hold them: n-grams that share a bit are late as well.
HOT, LOCAL = 3, 8
#: N-grams that a task gathers before it counts them.
COUNTED = 2_000_000
BITS = 1 << 26
#: Sets that share an n-gram are tried pair by pair against the bounds on size and place, up to this many.
TRIED = 400
#: Cells of a query membership table.
CELLS = 1 << 24


def shingles(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of every row; a row with fewer words has its whole sequence as one."""
    for _, _, data, offsets in slices(column):
        w = split_words(data, offsets, NON_SPACE)
        ok = gram_mask(w.bounds, k, len(w.hashes))
        grams = gram_hashes(w.hashes, k)[ok]
        rows = (np.searchsorted(w.bounds, np.flatnonzero(ok), "right") - 1).astype(np.int64)
        short = np.flatnonzero((w.counts > 0) & (w.counts < k))
        whole = [gram_hashes(w.hashes[w.bounds[r] : w.bounds[r + 1]], int(w.counts[r])) for r in short]
        grams, rows = np.concatenate([grams, *whole]), np.concatenate([rows, short])
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        grams, rows = grams[new], rows[new]
        at = np.searchsorted(rows, np.arange(len(offsets)))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield grams[a:b]


def set_id(s: np.ndarray) -> int | None:
    """A 64-bit id of a set (None if empty); among N different sets some two agree with a chance of N**2 / 2**65."""
    return None if not len(s) else int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _wanted(n: int) -> int:
    """How many of the first of n n-grams a linked set shares one of: it has at least 0.8 of either set."""
    return n - -(-8 * n // 10) + 1


def _member(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = values & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of a column of longs; at most BITS / 64 rows come to the driver, whatever the number of keys."""
    at = keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit(BITS - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _counted(fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams to count and how many of the sets have them: the first of each set, and those that LOCAL sets share."""
    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *fresh]))
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(every)))
    first, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s[: _wanted(len(s))] for s in fresh)]), return_counts=True)
    return np.concatenate([first, every[start][n >= LOCAL]]).view(np.int64), np.concatenate([counts, n[n >= LOCAL]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows with n < 0 that hold n-grams to count; copies within a task count once."""
    seen: set[int] = set()
    fresh: list[np.ndarray] = []
    waiting = 0
    names = ["id", "n", "set", "keys", "counts"]

    def count_row() -> pa.RecordBatch:
        keys, counts = _counted(fresh)
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=names)

    for batch in batches:
        sizes, ids = [], []
        for s in shingles(batch.column(1)):
            sizes.append(len(s))
            ids.append(set_id(s))
            if len(s) and ids[-1] not in seen:
                seen.add(ids[-1])
                fresh.append(s)
                waiting += len(s)
        n, lists = len(sizes), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(n, lists), pa.nulls(n, lists)], names=names)
        if waiting >= COUNTED:
            yield count_row()
            fresh, waiting = [], 0
    if fresh:
        yield count_row()


def _prefixes(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """set, size, early and late n-grams of which linked sets share one; copies within a task are given once."""
    seen: set[int] = set()
    for batch in batches:
        ids, sizes, early, late = [], [], [], []
        for s in shingles(batch.column(0)):
            name = set_id(s)
            if name is None or name in seen:
                continue
            seen.add(name)
            n, is_hot = _wanted(len(s)), _member(s, hot)
            cold = s[~is_hot][:n]
            ids.append(name)
            sizes.append(len(s))
            early.append(cold.view(np.int64))
            late.append(s[is_hot][: n - len(cold)].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(early, pa.list_(pa.int64())), pa.array(late, pa.list_(pa.int64()))], names=["set", "n", "early", "late"])


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, set) for the sets that may link by an n-gram of this partition; hub: the least of those that share it."""
    got = [[c.to_numpy() for c in b.columns] for b in batches]
    if not got:
        return
    key, name, size, place = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((name, key))
    key, name, size, place = key[order], name[order], size[order], place[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(start, len(key)))
    most = size - place  # what a set has from this n-gram on, in the global order
    hubs, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, m in zip(start[n > 1].tolist(), n[n > 1].tolist(), strict=True):
        some = slice(a, a + m)
        kept = name[some]
        if m <= TRIED:
            both = size[some][:, None] + size[some][None, :]
            may = (9 * np.minimum(most[some][:, None], most[some][None, :]) >= 4 * both) & (kept[:, None] != kept[None, :])
            may &= 9 * np.minimum(size[some][:, None], size[some][None, :]) >= 4 * both
            kept = kept[may.any(1)]
        if len(kept) > 1 and kept[0] != kept[-1]:
            names.append(kept)
            hubs.append(np.full(len(kept), kept[0]))
    pairs = np.unique(np.stack([np.concatenate(hubs), np.concatenate(names)], 1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hub", "set"])


def trie_links(queries: list[np.ndarray], members: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(place in queries, place in members) of all pairs with 100 * intersection >= 80 * union.

    Sets are ascending ranks of the global order. The members, in lexicographic order, are the paths of a trie; all
    queries walk it together, the overlap with a shared path is counted once, and a subtree is left for the queries
    whose overlap so far plus what remains below cannot reach the bound for its shortest member.
    """
    order = sorted(range(len(members)), key=lambda i: members[i].astype(">u4").tobytes())
    path = [members[i] for i in order]
    sizes = np.array([len(p) for p in path])
    first = 0
    while first < len(queries):
        last, total = first, 0
        while last < len(queries) and (last == first or (total + len(queries[last])) * (last - first + 1) <= CELLS):
            total += len(queries[last])
            last += 1
        some = queries[first:last]
        universe = np.unique(np.concatenate(some))
        table = np.zeros((len(universe) + 1, len(some)), np.uint8)
        for q, s in enumerate(some):
            table[np.searchsorted(universe, s), q] = 1
        size = np.array([len(s) for s in some])
        work = [(0, len(path), 0, np.arange(len(some)), np.zeros(len(some), np.int64))]
        while work:
            lo, hi, depth, q, overlap = work.pop()
            short, deep = int(sizes[lo:hi].min()), int(sizes[lo:hi].max())
            one, other = path[lo], path[hi - 1]
            upto = min(len(one), len(other))
            differ = np.flatnonzero(one[depth:upto] != other[depth:upto])
            end = depth + int(differ[0]) if len(differ) else upto
            while len(q):
                alive = 9 * np.minimum(overlap + deep - depth, size[q]) >= 4 * (size[q] + short)
                q, overlap = q[alive], overlap[alive]
                if depth == end or not len(q):
                    break
                step = one[depth : min(end, depth + 128)]
                at = np.searchsorted(universe, step)
                at[(at == len(universe)) | (universe[np.minimum(at, len(universe) - 1)] != step)] = len(universe)
                overlap = overlap + table[at][:, q].sum(0, dtype=np.int64)
                depth += len(step)
            if not len(q):
                continue
            while lo < hi and sizes[lo] == end:  # paths that end here come first
                yield from ((first + int(x), order[lo]) for x in q[9 * overlap >= 4 * (size[q] + end)])
                lo += 1
            if lo < hi:
                branch = np.array([path[i][end] for i in range(lo, hi)])
                cuts = [lo, *(lo + 1 + np.flatnonzero(branch[1:] != branch[:-1])).tolist(), hi]
                work += [(a, b, end, q, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        first = last


def _group_links(names: list[int], sets: list[np.ndarray], side: list[bool], hot: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the sets of one group: within it, or between its two sides; without those that close a circle."""
    universe = np.unique(np.concatenate(sets))
    late = _member(universe, hot)
    rank = np.empty(len(universe), np.uint32)
    rank[np.argsort(late, kind="stable")] = np.arange(len(universe), dtype=np.uint32)
    ranked = [np.sort(rank[np.searchsorted(universe, s)]) for s in sets]
    left = [i for i, x in enumerate(side) if not x]
    right = [i for i, x in enumerate(side) if x] or left
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for q, m in trie_links([ranked[i] for i in left], [ranked[i] for i in right]):
        a, b = find(left[q]), find(right[m])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((names[left[q]], names[right[m]]))
    return out


def _links(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of consecutive groups (hub, i, j) of rows (hub, i, j, block, set, grams)."""
    group, names, sets, side, out = None, [], [], [], []

    def finish() -> None:
        if len(names) > 1:
            out.extend(_group_links(names, sets, side, hot))

    for batch in batches:
        for hub, i, j, block, name, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != (hub, i, j):
                finish()
                group, names, sets, side = (hub, i, j), [], [], []
            if name not in names:
                names.append(name)
                sets.append(np.frombuffer(grams, np.uint64))
                side.append(block != i)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
        out = []
    finish()
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], met: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The n-grams of the sets that are among `met`; copies within a task are given once."""
    seen: set[int] = set()
    for batch in batches:
        names, grams = [], []
        for s in shingles(batch.column(0)):
            name = set_id(s)
            if name is not None and name not in seen and _member(np.array([name], np.int64).view(np.uint64), met)[0]:
                seen.add(name)
                names.append(name)
                grams.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(grams, pa.binary())], names=["set", "grams"])


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row: links are exact, nothing is sampled.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set has its distinct shingles of WORDS
    words. Equal sets are one class. Classes whose sets share one of the first n-grams of the global order (common
    n-grams last, else by hash) meet under the least class that may link by it; such a group is split into blocks, and each
    pair of blocks is joined by a trie. Only spanning links leave a task. A null text, or one without words, has an
    empty set and is linked with nothing; a null id has a null component and is linked with nothing; an id that
    stands in several rows is one node for each different text and gets the least id of its text's component. Texts
    are read three times and never shuffled; only n-grams of candidates are. A very long text is a large set and is
    compared whole; equal texts are one class however many; an empty table gives an empty result. Shingles are compared
    by hashes of 64 bits: among the M distinct shingles of two sets some two agree with a chance of M^2 / 2^65. Other
    columns of docs are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    digest = written(docs.mapInArrow(_digests, "id long, n long, set long, keys array<long>, counts array<long>"))
    counted = digest.where("n < 0").select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy("x.keys").agg(F.sum("x.counts").alias("c"))
    hot = spark.sparkContext.broadcast(bitmap(counted.where(f"c >= {HOT}")))
    digest = digest.where("n >= 0").select("id", "n", "set")

    known = docs.where("id is not null").select("text")
    first = written(known.mapInArrow(lambda b: _prefixes(b, hot.value), "set long, n int, early array<long>, late array<long>"))
    cold = first.select("set", "n", F.posexplode("early").alias("place", "key")).select("key", "set", "n", "place").repartition("key").mapInArrow(_hubs, "hub long, set long")
    late = first.select(F.explode("late").alias("key"), "set").distinct()
    least = cut(late.groupBy("key").agg(F.min("set").alias("hub"), F.max("set").alias("most")).where("hub < most").select("key", "hub"))
    met = written(cold.union(late.join(least, "key").select("hub", "set")).distinct())

    blocks = cut(met.groupBy("hub").agg(F.expr(f"CAST(ceil(count(*) / {BLOCK}) AS INT)").alias("blocks")))
    dealt = met.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set")

    classes = cut(digest.where("set is not null").groupBy("set").agg(F.min("id").alias("id")))
    there = spark.sparkContext.broadcast(bitmap(met.select("set")))
    sets = known.mapInArrow(lambda b: _sets(b, there.value), "set long, grams binary")
    groups = dealt.hint("shuffle_hash").join(sets, "set").select("hub", "i", "j", "block", "set", "grams")
    links = groups.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(lambda b: _links(b, hot.value), "a long, b long")

    labels = components(links)
    named = cut(classes.join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", "id", F.coalesce("label", "set").alias("label")))
    lowest = cut(named.groupBy("label").agg(F.min("id").alias("component_id")))
    found = cut(named.join(lowest, "label").select("set", "component_id"))
    out = digest.join(found, "set", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out
