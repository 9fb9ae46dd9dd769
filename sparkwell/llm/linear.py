"""Hashed features of whole texts, bounded training samples, and stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Features = tuple[np.ndarray, np.ndarray]  # buckets of all rows end to end; row bounds


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]] in doubles; empty rows give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    full = bounds[:-1] < bounds[1:]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
    return out


def byte_grams(stream: np.ndarray, bounds: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[Features]:
    """Buckets of the n-grams of a byte stream within rows, one batch for each n."""
    h = np.zeros(len(stream), np.uint32)
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    for n in range(1, max(sizes) + 1):
        h = h[: len(stream) - n + 1] * np.uint32(0x01000193) + stream[n - 1 :].astype(np.uint32) + np.uint32(1)
        if n in sizes:
            fits = np.arange(len(h)) + n <= row_end[: len(h)]
            total = np.concatenate([[0], np.cumsum(fits)])
            mixed = (h[fits] ^ (h[fits] >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(32 - bits)).astype(np.int64), total[np.minimum(bounds, len(h))]


def merged(batches: list[Features], rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares of all features, for every row."""
    out = []
    for r in range(rows):
        ids, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(b[at[r] : at[r + 1]] for b, at in batches)]), return_counts=True)
        out.append((ids, n / max(1, n.sum())))
    return out


def sample_by_class(rows: DataFrame, label: str, per_class: int, key: Column) -> DataFrame:
    """About per_class rows of each label (all, where there are fewer), chosen by a hash of key."""
    shares = rows.groupBy(label).count().select(F.col(label), F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("count")).alias("_share"))
    # one row per label
    return rows.join(F.broadcast(shares), label).where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.col("_share") * (1 << 30)).drop("_share")


def train_softmax(docs: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, buckets: int, dim: int = 16, epochs: int = 8, rate: float = 0.5, scale: int = 50, seed: int = 5) -> np.ndarray:
    """Averaged bucket vectors under a linear softmax, by stochastic gradient descent with a falling rate.

    scale: the vectors of a document of that many or more features move as fast as if it had only so many.
    Returns the product of both layers, (buckets, classes): a document's logits are the mean over its features.
    """
    rng = np.random.default_rng(seed)
    inner = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    outer = np.zeros((dim, classes))
    steps, step = max(1, epochs * len(docs)), 0
    weight = len(target) / (classes * np.maximum(1, np.bincount(target, minlength=classes)))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            lr = rate * (1 - step / steps) * weight[target[i]]
            step += 1
            if not len(ids):
                continue
            hidden = share @ inner[ids]
            z = hidden @ outer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = outer @ p
            outer -= lr * np.outer(hidden, p)
            inner[ids] -= lr * np.outer(share * min(len(ids), scale), back)
    return (inner @ outer).astype(np.float32)


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The factor on the logits that fits the probabilities of held-back documents best."""
    if not len(logits):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 50, 61):
        z = logits * t
        z = z - z.max(1, keepdims=True)
        loss = -(z[np.arange(len(z)), target] - np.log(np.exp(z).sum(1))).mean()
        best = min(best, (float(loss), float(t)))
    return best[1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
