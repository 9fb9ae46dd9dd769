"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, learnt from labels of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from sparkwell.llm.linear import row_sums
from sparkwell.llm.quality import labelled_sample
from sparkwell.llm.stash import small_batches
from sparkwell.llm.text import ALNUM, mix, slices, split_words

BITS = 18
#: Labelled documents per class that the model is fitted on.
SAMPLE_PER_CLASS = 3000
#: Documents of the sample that a feature must stand in to get a weight.
LEAST_DOCS = 4
EPOCHS = 10
#: Step size, and how far the gradients of a feature must add up before it gets a weight.
RATE, SPARSE = 0.5, 4.0
#: Toxic documents that are held back at least, where there are as many, to find the threshold.
CALIBRATION = 60
#: Bytes of the beginnings of words that are features, so that unseen endings of a known stem count.
HEADS = (4, 6)

SENTENCES = "array<struct<first:bigint,last:bigint,text:string>>"

_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def sentences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: (first, last + 1, buckets of all words' features, feature bounds of sentences, sentence bounds of rows, byte starts, byte ends).

    A sentence ends at . ! ? or a line end; one without words is none. Features: words, pairs of words in a sentence,
    and beginnings of words.
    """
    for lo, hi, data, offsets in slices(column):
        w = split_words(data, offsets, ALNUM)
        h, n = w.hashes, len(w.hashes)
        row = np.repeat(np.arange(hi - lo), w.counts)
        ends = np.cumsum(_END[data])[w.starts] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (row[1:] != row[:-1]) | (ends[1:] != ends[:-1])
        pair = h.copy()
        pair[1:] = np.where(new[1:], h[1:], mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))
        size, head, heads = w.ends - w.starts, np.zeros(n, np.uint64), []
        for k in range(max(HEADS)):
            here = w.data[np.minimum(w.starts + k, max(0, len(w.data) - 1))] if n else np.zeros(0, np.uint8)
            head = head * np.uint64(257) + np.where(k < size, here, 0).astype(np.uint64)
            if k + 1 in HEADS:
                heads.append(_bucket(mix(head + np.uint64(k))))
        again = np.zeros(n, bool)
        again[1:] = (h[1:] == h[:-1]) & ~new[1:]  # a word repeated at once counts once
        flat = np.stack([_bucket(h), _bucket(pair), *heads], 1)[~again].ravel()
        upto = (2 + len(HEADS)) * np.concatenate([[0], np.cumsum(~again)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n)[: len(first)] - 1
        yield lo, hi, flat, upto[np.append(first, n)], np.searchsorted(first, w.bounds), w.starts[first] - offsets[row[first]] if n else first, w.ends[last] - offsets[row[first]] if n else first


def _shifted(p: np.ndarray, even: float) -> np.ndarray:
    """p with its odds divided by the odds of `even`."""
    return p * (1 - even) / (p * (1 - even) + (1 - p) * even)


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float, even: float = 0.5):
        """even: the noisy-or that counts as a score of 0.5."""
        self.weights, self.bias, self.even = weights, bias, even

    def score(self, column: pa.Array, least: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
        """(scores of rows, their sentences with a score of at least `least`: first and last + 1 code point, text)"""
        out, found = np.zeros(len(column)), [[] for _ in range(len(column))]
        for lo, hi, flat, at, rows, starts, ends in sentences(column):
            z = self.bias + row_sums(self.weights[flat], at)
            out[lo:hi] = -np.expm1(-row_sums(np.logaddexp(0, z), rows))
            for s in np.flatnonzero(_shifted(1 / (1 + np.exp(-np.clip(z, -60, 60))), self.even) >= least):
                r = lo + int(np.searchsorted(rows, s, "right")) - 1
                raw = column[r].as_py().encode()
                first, text = len(raw[: starts[s]].decode()), raw[starts[s] : ends[s]].decode()
                found[r].append({"first": first, "last": first + len(text), "text": text})
        return _shifted(np.clip(out, 0, 1), self.even), found


def _trained(docs: list[tuple[np.ndarray, np.ndarray, int]], seed: int) -> ToxicityModel:
    """Weights of sentence features by stochastic gradient descent (sparse, follow-the-regularised-leader) on the noisy-or of a document's sentences."""
    count = np.zeros(1 << BITS, np.int64)
    for flat, _, _ in docs:
        count[np.unique(flat)] += 1
    usable = count >= LEAST_DOCS
    weights, past, pull, bias, past_bias = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS), -4.0, 1.0
    rng = np.random.default_rng(seed)
    share = np.bincount([y for _, _, y in docs], minlength=2)
    heavy = (len(docs) / (2 * np.maximum(1, share))).clip(0.2, 5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            flat, at, y = docs[i]
            if len(at) < 2:
                continue
            z = bias + row_sums(weights[flat], at)
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            total = -np.expm1(-np.logaddexp(0, z).sum())
            g = heavy[y] * (p if y == 0 else -p * (1 - total) / max(total, 1e-9))
            each = np.repeat(g, np.diff(at))
            some = usable[flat]
            ids, inv = np.unique(flat[some], return_inverse=True)
            grad = np.bincount(inv, each[some], len(ids))
            # step sizes fall with the past gradients of a feature; small sums of gradients leave its weight at 0
            now = past[ids] + grad**2
            pull[ids] += grad - (np.sqrt(now) - np.sqrt(past[ids])) / RATE * weights[ids]
            past[ids] = now
            over = np.maximum(0, np.abs(pull[ids]) - SPARSE)
            weights[ids] = -np.sign(pull[ids]) * over / ((0.1 + np.sqrt(now)) / RATE + 0.02)
            past_bias += g.sum() ** 2
            bias -= 0.2 * g.sum() / np.sqrt(past_bias)
    return ToxicityModel(weights.astype(np.float32), float(bias))


def fit(texts: list[str], labels: list[int], seed: int = 2) -> ToxicityModel:
    """A model from labelled texts; equal texts count once.

    A fifth is held back to find the noisy-or that parts the classes best (by F1); with few toxic texts further fifths
    are held back in turn, each from a model of the others, until CALIBRATION of them have been scored or all have.
    Where even all of them are fewer than 20, the threshold stays at 0.5.
    """
    pairs = sorted(set(zip(texts, labels, strict=True)))
    column, target = pa.array([t for t, _ in pairs], pa.string()), np.array([int(y) for _, y in pairs], np.int64)
    fold = np.random.default_rng(seed).permutation(len(pairs)) % 5
    docs = []
    for lo, hi, flat, at, rows, _, _ in sentences(column):
        docs += [(flat[at[rows[r]] : at[rows[r + 1]]], at[rows[r] : rows[r + 1] + 1] - at[rows[r]], int(target[lo + r])) for r in range(hi - lo)]
    score, label, model = np.zeros(0), np.zeros(0, np.int64), None
    for f in (4, 3, 2, 1, 0):
        fitted = _trained([d for d, k in zip(docs, fold.tolist(), strict=True) if k != f], seed)
        model = model or fitted
        score, label = np.append(score, fitted.score(column.filter(pa.array(fold == f, pa.bool_())), 2.0)[0]), np.append(label, target[fold == f])
        if label.sum() >= CALIBRATION or target.sum() < 20:
            break
    if label.sum() >= 20:
        order = np.argsort(-score, kind="stable")
        k = int((np.cumsum(label[order]) / (np.arange(1, len(score) + 1) + label.sum())).argmax())
        after = score[order][k + 1] if k + 1 < len(score) else 0.0
        model.even = float(np.clip((score[order][k] + after) / 2, 0.25, 0.95))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", label: str = "toxic", id_col: str = "doc_id", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """docs plus score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5) and toxic_sentences.

    learn: which rows of labels may be learnt from. The fit takes about per_class of each label on the driver; scores
    read nothing but the text, whole, in one pass without a shuffle. A text without words (null, empty) has no
    sentence and so score 0; without anything to learn from no weight is set and scores stay near 0. toxic_sentences
    has first and last + 1 code point and the text of each. Rows are scored one by one, so repeated rows and ids get
    equal scores; an id with both labels is learnt with both; an empty table gives an empty result. Columns called
    score, predicted or toxic_sentences are replaced, all others stay.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted", "toxic_sentences")
    got = labelled_sample(docs, labels, learn, label, per_class, text, id_col)
    model = docs.sparkSession.sparkContext.broadcast(fit([r[0] for r in got], [r[1] for r in got]))
    names = docs.schema.names
    schema = docs.selectExpr("*", "0D score", "0 predicted", f"CAST(array() AS {SENTENCES}) toxic_sentences").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, found = model.value.score(b.column(text))
            new = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("text", pa.string())])))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + new, names=schema.names)

    return docs.mapInArrow(run, schema)
