"""Embedding near-duplicates: a forest of random-projection trees with spill, exact cosines inside leaves, links united."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.components import components
from sparkwell.llm.stash import cut, written
from sparkwell.llm.text import mix

COSINE = 0.98
TREES = 6
#: Vectors of the bounded sample on which the split points are fitted; every vector is indexed.
SAMPLE = 40_000
#: Vectors of one label that a leaf should hold; trees are built at every size.
LEAF = 32
#: A leaf with more vectors than this is split further by a tree of its own, fitted on about FIT of them, unless its
#: parts would keep more than KEPT squared of its pairs, as in a group of vectors that are all close to each other. The
#: tree ends where spill makes more than GROWN rows of a vector.
LARGE, FIT, KEPT, GROWN = 1024, 4000, 0.8, 4
#: A vector within this distance of a split point (on unit vectors) goes to both sides.
SPILL = 0.012
#: Vectors of a block; the pairs of a larger leaf are split into pairs of blocks.
BLOCK = 512


def unit_rows(column: pa.Array) -> list[bytes | None]:
    """The bytes of every row's vector, in doubles and of unit length; None for null, empty and zero vectors and those with null or non-finite parts."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null part is NaN
    out: list[bytes | None] = [None] * len(sizes)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        every = flat[begins[at][:, None] + np.arange(size)]
        most = np.abs(every).max(1)
        ok = np.isfinite(most) & (most > 0)
        unit = every[ok] / most[ok][:, None]  # no overflow or underflow in the squares
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        for i, v in zip(at[ok].tolist(), unit, strict=True):
            out[i] = v.tobytes()
    return out


class Tree:
    """Random directions with the medians of some vectors as split points; nodes are numbered as in a heap."""

    def __init__(self, vectors: np.ndarray, depth: int, seed: int):
        self.depth, self.seed, self.dim = depth, seed, vectors.shape[1]
        axes, self.at = self.axes(), np.zeros((1 << depth) - 1)
        inside = {0: np.arange(len(vectors))}
        for node in range((1 << depth) - 1):
            rows = inside.pop(node)
            x = vectors[rows] @ axes[node]
            self.at[node] = np.median(x) if len(x) else 0.0
            inside[2 * node + 1], inside[2 * node + 2] = rows[x < self.at[node]], rows[x >= self.at[node]]

    def axes(self) -> np.ndarray:
        axes = np.random.default_rng(self.seed).standard_normal(((1 << self.depth) - 1, self.dim))
        return axes / np.linalg.norm(axes, axis=1, keepdims=True)

    def leaves(self, vectors: np.ndarray, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves they fall into, a row once for each of its leaves."""
        axes, rows, nodes = self.axes(), np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            rows, nodes = self.below(axes, vectors, rows, nodes, spill)
        return rows, nodes

    def below(self, axes: np.ndarray, vectors: np.ndarray, rows: np.ndarray, nodes: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        x = np.einsum("ij,ij->i", vectors[rows], axes[nodes]) - self.at[nodes]
        left, right = x < spill, x >= -spill
        return np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])

    def worth(self, vectors: np.ndarray) -> tuple[int, int]:
        """The depth at which leaves hold the fewest pairs while no more than GROWN rows are made of a vector, and twice those pairs."""
        axes, rows, nodes = self.axes(), np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        best = (0, len(vectors) ** 2)
        for depth in range(1, self.depth + 1):
            rows, nodes = self.below(axes, vectors, rows, nodes, SPILL)
            if len(rows) > GROWN * len(vectors):
                break
            pairs = int((np.bincount(nodes) ** 2).sum())
            if pairs < best[1]:
                best = (depth, pairs)
        return best


def _depth(n: int, most: int) -> int:
    """Levels until n vectors stand in leaves of LEAF, as far as `most` vectors can tell split points; one at least."""
    return max(1, min(int(np.ceil(np.log2(max(1, n / LEAF)))), int(np.log2(max(2, most / 8)))))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, id, label, vector (doubles of unit length) and class of equal vectors; null vector and class where not usable."""
    for batch in batches:
        row, name, label, column = batch.columns
        known = label.is_valid().to_pylist()
        raw = [v if ok else None for v, ok in zip(unit_rows(column), known, strict=True)]
        key = [v and hashlib.blake2b(v, digest_size=16).digest() for v in raw]
        yield pa.RecordBatch.from_arrays([row, name, label.cast(pa.string()), pa.array(raw, pa.binary()), pa.array(key, pa.binary())], names=["row", "id", "label", "vector", "class"])


def _homes(batches: Iterator[pa.RecordBatch], trees: list[Tree]) -> Iterator[pa.RecordBatch]:
    """(row, label, vector, copies, home, homes): a row for every leaf that a vector falls into, with all of its leaves."""
    dim = 8 * trees[0].dim
    for batch in batches:
        raw = batch.column(2).to_pylist()
        dims = np.array([len(v) for v in raw], np.int64)
        same, other = np.flatnonzero(dims == dim), np.flatnonzero(dims != dim)
        vectors = np.array([np.frombuffer(raw[i]) for i in same]).reshape(len(same), dim // 8)
        row, home = [other], [-dims[other]]  # vectors of another dimension meet among themselves
        for t, tree in enumerate(trees if len(same) else ()):
            rows, leaves = tree.leaves(vectors)
            row.append(same[rows])
            home.append((t << 32) + leaves)
        row, home = np.concatenate(row), np.concatenate(home)
        order = np.argsort(row, kind="stable")
        row, home = row[order], home[order]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(raw) + 1)).astype(np.int32)), pa.array(home))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(4)), pa.array(home), lists.take(at)], names=["row", "label", "vector", "copies", "home", "homes"])


def _inner_tree(t: pa.Table) -> pa.Table:
    """A tree for one large leaf from a sample of its vectors, as the bytes of its split points; no row where that saves too few pairs."""
    label, home, n = (t[c][0].as_py() for c in ("label", "home", "n"))
    vectors = np.array([np.frombuffer(v) for v in t["vector"].to_pylist()])
    tree = Tree(vectors, _depth(n, len(vectors)), home & 0x7FFFFFFF)
    depth, pairs = tree.worth(vectors)
    some = [0] if pairs <= KEPT**2 * len(vectors) ** 2 else []
    cuts = tree.at[: (1 << depth) - 1].tobytes()  # a tree of less depth begins with the same directions
    return pa.table({"label": pa.array([label for _ in some], pa.string()), "home": pa.array([home for _ in some], pa.int64()), "depth": pa.array([depth for _ in some], pa.int32()), "cuts": pa.array([cuts for _ in some], pa.binary())})


def _inner_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, label, vector, copies, home) of rows with the tree of their large leaf."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        parents = t["home"].to_numpy()
        for home in np.unique(parents).tolist():
            mine = t.filter(pa.array(parents == home))
            for label in mine["label"].unique().to_pylist():
                some = mine.filter(pc.equal(mine["label"], label))
                vectors = np.array([np.frombuffer(v) for v in some["vector"].to_pylist()])
                tree = Tree.__new__(Tree)
                tree.depth, tree.seed, tree.dim, tree.at = some["depth"][0].as_py(), home & 0x7FFFFFFF, vectors.shape[1], np.frombuffer(some["cuts"][0].as_py())
                rows, nodes = tree.leaves(vectors)
                at = pa.array(rows)
                # a new name for (home, node); below zero are the homes of other dimensions, so it stays above
                name = (mix(np.uint64(home * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + nodes.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                kept = [some[c].combine_chunks().take(at) for c in ("row", "label", "vector", "copies")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(name)], names=["row", "label", "vector", "copies", "home"])


def _split_large(first: DataFrame) -> DataFrame:
    """Leaves of first(row, label, vector, copies, home, homes) split on until they are small or only close vectors are left."""
    slim = ["row", "label", "vector", "copies", "home"]
    at, done, leaf = first.select(slim), None, ["label", "home"]
    while True:
        sizes = written(at.groupBy(*leaf).agg(F.count("*").alias("n")).where(F.col("n") > LARGE))
        if sizes.isEmpty():
            break
        # sampled by a hash of the row, so about FIT rows of each leaf meet in a task
        some = at.join(sizes, leaf).where(F.pmod(F.xxhash64("row", "home"), F.lit(1 << 20)) * F.col("n") < F.lit(FIT << 20))
        trees = written(some.groupBy(*leaf).applyInArrow(_inner_tree, "label string, home long, depth int, cuts binary"))
        split = written(trees.select(leaf))
        if split.isEmpty():
            break
        rest = at.join(split, leaf, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        # only what is split meets its tree; names of leaves alone are few and small
        at = written(at.join(split, leaf, "left_semi").join(trees, leaf).select(*slim, "depth", "cuts").mapInArrow(_inner_homes, "row long, label string, vector binary, copies long, home long"))
    if done is None:
        return first
    every = written(done.unionByName(at))
    return every.join(every.groupBy("row").agg(F.collect_list("home").alias("homes")), "row")  # a few leaves in each tree


def _earlier(homes: pa.ListArray, home: int) -> np.ndarray:
    """Rows by the different homes before this one: 1 where the row is there too."""
    row = np.repeat(np.arange(len(homes)), pc.list_value_length(homes).to_numpy())
    every = homes.flatten().to_numpy()
    some = every < home
    names, at = np.unique(every[some], return_inverse=True)
    out = np.zeros((len(homes), len(names)), np.float32)
    out[row[some], at] = 1
    return out


def _leaf_links(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(rows that link here first, with how many copies, and links that join them) of a leaf or a pair of its blocks."""
    row, copies = t["row"].to_numpy(), t["copies"].to_numpy().astype(np.float64)
    home, side = t["home"][0].as_py(), t["block"].to_numpy() != t["i"][0].as_py()
    unit = np.array([np.frombuffer(v) for v in t["vector"].combine_chunks().to_pylist()])
    within = t["i"][0].as_py() == t["j"][0].as_py()
    left, right = (np.arange(len(row)),) * 2 if within else (np.flatnonzero(~side), np.flatnonzero(side))
    close = unit[left] @ unit[right].T >= COSINE
    if within:
        close = np.triu(close, 1)
    x, y = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    if not len(x):
        return row[:0], row[:0], []
    left, right, close = left[x], right[y], close[np.ix_(x, y)]
    # a pair counts in the first leaf that both share
    earlier = _earlier(t["homes"].combine_chunks(), home)
    close &= earlier[left] @ earlier[right].T == 0
    degree, links = np.zeros(len(row)), close.astype(np.float64)
    degree[left] += links @ copies[right]
    degree[right] += copies[left] @ links
    i, j = np.nonzero(close)
    a, b, root = left[i], right[j], np.arange(len(row))
    while True:
        low, last = np.minimum(root[a], root[b]), root
        root = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == last).all():
            break
    linked, joined = np.flatnonzero(degree), np.flatnonzero(root != np.arange(len(row)))
    return row[linked], degree[linked].astype(np.int64), list(zip(row[joined].tolist(), row[root[joined]].tolist(), strict=True))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, other, n) of consecutive leaves, or pairs of blocks of them, in rows sorted by label, home, i, j."""
    rest: pa.Table | None = None
    key = ("label", "home", "i", "j")

    def out(tables: list[pa.Table]) -> pa.RecordBatch:
        row, other, n = [], [], []
        for t in tables:
            linked, degree, joins = _leaf_links(t)
            row += [*linked.tolist(), *(x for x, _ in joins)]
            other += [*[None] * len(linked), *(y for _, y in joins)]
            n += [*degree.tolist(), *[None] * len(joins)]
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64())], names=["row", "other", "n"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not len(t):
            continue
        codes = [t[c].combine_chunks().dictionary_encode().indices.to_numpy() if c == "label" else t[c].to_numpy() for c in key]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
        starts = [0, *new.tolist()]
        yield out([t.slice(x, y - x) for x, y in zip(starts[:-1], starts[1:], strict=True)])
        rest = t.slice(starts[-1]).combine_chunks()
    if rest is not None and len(rest):
        yield out([rest])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", trees: int = TREES) -> DataFrame:
    """(id, n_links, component_id, kept) per row: links are exact cosines >= COSINE between rows of equal label.

    Equal vectors of a label are one class, which stands in the forest once. The trees are fitted on a bounded sample
    and index every class; a leaf that is still large gets a tree of its own, round by round. Recall is measured in the
    tests. A leaf larger than BLOCK after that (a group of close vectors) is split into pairs of blocks. Each linked pair
    counts in the first leaf that both share, so counts leave a leaf, not pairs. Null labels, null, empty or zero vectors
    and those with null or non-finite parts link with nothing. Vectors of different lengths never link: the trees are of
    the length that most of the sample have, vectors of another one meet in a leaf for it, which is split as any large
    one is; a long vector is a longer row and nothing else. A component's id is its least non-null id; an
    id in several rows stands for each of them, and a row without an id has no component. An empty table gives an empty
    result. Other columns of rows are not read, so their names cannot clash.
    """
    spark = rows.sparkSession
    keyed = cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector")))
    all_rows = written(keyed.mapInArrow(_vectors, "row long, id long, label string, vector binary, class binary"))
    classes = cut(all_rows.where("class is not null").groupBy("label", "class").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    total, most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    unlinked = all_rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return unlinked
    firsts = all_rows.join(classes.select("row", "copies"), "row").select("row", "label", "vector", "copies")
    share = min(1.0, SAMPLE / total)
    sample = [v for (v,) in firsts.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30)).select("vector").collect()]
    dims = [len(v) for v in sample]
    dim = max(set(dims), key=dims.count) if dims else 8
    fitted = np.array([np.frombuffer(v) for v in sample if len(v) == dim]).reshape(-1, dim // 8)
    depth = _depth(most, len(fitted))
    forest = spark.sparkContext.broadcast([Tree(fitted, depth, 11 + t) for t in range(trees)])  # at most SAMPLE / 8 split points each

    at = _split_large(written(firsts.mapInArrow(lambda b: _homes(b, forest.value), "row long, label string, vector binary, copies long, home long, homes array<long>")))
    leaf = ["label", "home"]
    # few leaves are larger than a block, so the others are not shuffled to learn that they are not
    sizes = written(at.groupBy(*leaf).agg(F.expr(f"CAST(ceil(count(*) / {BLOCK}) AS INT)").alias("blocks")).where("blocks > 1"))
    dealt = at.join(sizes, leaf, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    group = [*leaf, "i", "j"]
    found = written(dealt.drop("other", "blocks").repartition(*group).sortWithinPartitions(*group).mapInArrow(_links, "row long, other long, n long"))

    label_of = components(found.where("other is not null").select(F.col("row").alias("a"), F.col("other").alias("b")))
    counts = found.where("n is not null").groupBy("row").agg(F.sum("n").alias("n"))
    of_class = cut(classes.join(counts, "row", "left").join(label_of.withColumnRenamed("node", "row").withColumnRenamed("label", "root"), "row", "left").select("label", "class", F.coalesce("root", "row").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    known = all_rows.select("id", "label", "class")
    lowest = cut(known.where("class is not null").join(of_class, ["label", "class"]).groupBy("root").agg(F.min("id").alias("component_id")))
    final = cut(of_class.join(lowest, "root").select("label", "class", "n_links", "component_id"))
    out = known.join(final, ["label", "class"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
