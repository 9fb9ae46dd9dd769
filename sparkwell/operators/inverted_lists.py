"""Approximate nearest vectors: every vector is filed under its nearest centroid, requests probe the lists of theirs, and what they find is ranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.operators import channels
from sparkwell.operators.cuts import written

#: Vectors of the bounded sample on which centroids and the number of probes are fitted; every vector is filed.
SAMPLE, ROUNDS = 20_000, 10
#: Neighbours in the sample that the probed lists must hold, and requests of the sample that this is measured with.
RECALL, MEASURED = 0.97, 400
#: Vectors and requests that meet in a task; a longer list is dealt into blocks.
BLOCK, ASKED = 20_000, 2_000


@dataclass
class Lists:
    """Unit centroids, one a list, and how many lists a request probes."""

    centroids: np.ndarray
    probes: int

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of every vector, nearest first; ties by number."""
        return np.argsort(-np.round(unit @ self.centroids.T, 12), axis=1, kind="stable")[:, :n]


def _centroids(unit: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; an empty list starts anew at the vector that is worst served."""
    at = unit[np.random.default_rng(seed).choice(len(unit), lists, replace=False)]
    for _ in range(rounds):
        cosine = unit @ at.T
        own = cosine.argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm == 0)
        if len(empty):
            sums[empty] = unit[np.argsort(cosine.max(1), kind="stable")[: len(empty)]]
            norm[empty] = 1.0
        at = sums / norm[:, None]
    return at


def _probes(unit: np.ndarray, centroids: np.ndarray, limit: int, recall: float, measured: int) -> int:
    """The least number of lists that hold `recall` of the `limit` nearest of some vectors of the sample."""
    asked = np.linspace(0, len(unit) - 1, min(measured, len(unit))).astype(int)
    cosine = unit[asked] @ unit.T
    cosine[np.arange(len(asked)), asked] = -np.inf  # not itself
    near = np.argsort(-cosine, axis=1)[:, : min(limit, len(unit) - 1)]
    if not near.size:
        return len(centroids)
    own = (unit @ centroids.T).argmax(1)
    place = np.argsort(np.argsort(-(unit[asked] @ centroids.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), recall, method="higher")) + 1


def fit(vectors: DataFrame, limit: int, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL, seed: int = 3) -> Lists:
    """Centroids and probes for vectors(id, vector) from about `sample` of them, by a hash of the id.

    lists: by default the square root of all vectors, as far as the sample can tell lists apart. Vectors that are all
    alike or have no structure get as many probes as they need, all lists in the end.
    """
    usable = vectors.where("vector IS NOT NULL")
    n = usable.count()
    share = min(1.0, sample / max(1, n))
    some = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("vector").toArrow()
    unit = channels._unit(some["vector"].combine_chunks())[1] if len(some) else np.zeros((0, 1))
    if not len(unit):
        return Lists(np.ones((1, 1)), 1)
    wanted = int(np.sqrt(n)) if lists is None else lists
    centroids = _centroids(unit, max(1, min(wanted, len(unit) // 8 or 1)), ROUNDS, seed)
    return Lists(centroids, _probes(unit, centroids, limit, recall, MEASURED))


def _lists_of(rows: DataFrame, name: str, index: Lists, n: int) -> DataFrame:
    """(list, name, vector) of rows(name, vector), a row for each of its n nearest lists; zero and null vectors have none."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # as large as the sample at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, unit = channels._unit(b.column(1))
            near = shared.value.nearest(unit, n)
            place = pa.array(np.repeat(at, near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(place), b.column(1).take(place)], names=["list", name, "vector"])

    typed = rows.select(F.col(name).cast("long").alias(name), F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    return typed.mapInArrow(run, f"list int, {name} long, vector array<double>")


def file(vectors: DataFrame, index: Lists) -> DataFrame:
    """(list, id, vector): every one of vectors(id, vector) in its nearest list, written so that it can be searched again and again."""
    return written(_lists_of(vectors, "id", index, 1))


def search(requests: DataFrame, filed: DataFrame, index: Lists, limit: int) -> DataFrame:
    """(request_id, id, score): candidates for the `limit` nearest of every request(request_id, vector) in the lists it probes.

    A list meets its requests by an equi key; one of more than BLOCK vectors, or ASKED requests, is dealt into blocks of
    both, so no task holds a whole list, whatever share of the vectors it has. Only each block's best leave a task.
    """
    asked = written(_lists_of(requests, "request_id", index, index.probes))
    blocks = filed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    both = written(blocks.join(parts, "list"))  # a row for each list, as many as centroids
    other = both.select("list", F.col("blocks").alias("n_blocks"), F.col("parts").alias("n_parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = asked.join(F.broadcast(both), "list").select("list", "request_id", "vector", deal("request_id", "parts").alias("part"), every("blocks").alias("block"))
    right = filed.join(F.broadcast(other), "list").select("list", "id", "vector", deal("id", "n_blocks").alias("block"), every("n_parts").alias("part"))
    key = ["list", "block", "part"]
    target = pa.schema([("request_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def pair(some: pa.Table, many: pa.Table) -> pa.Table:
        if not len(some) or not len(many):
            return target.empty_table()
        (a, q), (b, v) = channels._unit(some["vector"].combine_chunks()), channels._unit(many["vector"].combine_chunks())
        return pa.table(channels._nearest(some["request_id"].to_numpy()[a], q, many["id"].to_numpy()[b], v, None, limit), schema=target)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(pair, "request_id long, id long, score double")


def indexed_vector_channel(requests: DataFrame, filed: DataFrame, index: Lists, limit: int, channel: str = "vector") -> DataFrame:
    """As channels.vector_channel, from the lists that requests probe; a number of probes as large as that of lists is exact."""
    hits = search(requests, filed, index, limit).withColumnRenamed("id", "chunk_id")
    return channels.ranked(hits, channel, limit, [F.desc("score"), F.col("chunk_id")])
