"""Fill-in-the-middle: texts cut at line ends, which a learned rank index finds, and put together in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.stash import free, small_batches
from sparkwell.llm.text import slices

#: Code points by which the line of a segment may miss an offset; what it misses by is stored in one byte.
ERROR = 100
#: Bytes of text indexed at once; a longer document makes an index of its own.
SLICE = 1 << 20
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass
class RankIndex:
    """Rank to offset: segments (first rank, offset there, offsets a rank) and what each rank's offset differs by from its line."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets: the line's, corrected by the stored residual."""
        return self.predict(ranks) + self.residual[ranks]


def fit_ranks(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Segments, each as long as some line through its first offset stays within `error` (1 to 126) of all of its offsets.

    The slopes that still fit narrow with every rank; a segment ends where none is left.
    """
    n, first, slope, s = len(offsets), [], [], 0
    while s < n:
        low, high, end, step = -np.inf, np.inf, s + 1, 16
        while end < n:
            rank = np.arange(end - s, min(n, end + step) - s)
            rise = offsets[end : end + len(rank)] - offsets[s]
            most = np.minimum(high, np.minimum.accumulate((rise + error) / rank))
            least = np.maximum(low, np.maximum.accumulate((rise - error) / rank))
            bad = np.flatnonzero(least > most)
            fit = int(bad[0]) if len(bad) else len(rank)
            if fit:
                low, high = least[fit - 1], most[fit - 1]
            end += fit
            if len(bad):
                break
            step *= 2
        first.append(s)
        slope.append((low + high) / 2 if end > s + 1 else 0.0)
        s = end
    index = RankIndex(np.array(first, np.int64), offsets[first], np.array(slope), np.zeros(0, np.int8))
    index.residual = (offsets - index.predict(np.arange(n))).astype(np.int8)
    return index


def line_ranks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points before every line boundary of the rows, end to end; the rank of each row's first one; lines of each row).

    A row of n lines has n + 1 boundaries: its begin, and the end of every line.
    """
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begins, ends = offsets[:-1], offsets[1:]
    after = np.flatnonzero(data == 10) + 1
    row = np.searchsorted(offsets, after - 1, "right") - 1
    open_ = np.flatnonzero(ends > begins)
    open_ = open_[data[ends[open_] - 1] != 10]  # a last line without an end
    at = np.concatenate([begins, after, ends[open_]])
    of = np.concatenate([np.arange(len(begins)), row, open_])
    order = np.lexsort((at, of))
    n = np.bincount(of, minlength=len(begins)) - 1
    return points[at[order]], np.cumsum(n + 1) - (n + 1), n


def id_hashes(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex sha256 of seed:id; a null id is written as nothing."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))  # type: ignore[return-value]


def fill_in_middle(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """docs without the text, plus n (lines), form, prefix_chars, middle_chars and output.

    rate of 100 documents are turned (plain otherwise), of these spm_rate of 100 begin with the suffix. Where a text is
    cut, and how it is turned, depends on its id alone, so rows that repeat an id are treated alike. A null text is
    empty; an empty one, and one that holds a sentinel, stays plain, without prefix_chars and middle_chars. A null id
    is hashed as an empty one. The index is fitted to all line boundaries of a slice of documents, whatever their
    length; an empty table gives an empty result. Columns of docs called as the new ones are replaced, all others stay.
    One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    keep = [c for c in docs.schema.names if c != text and c.lower() not in new]
    schema = docs.selectExpr(*[f"`{c}`" for c in keep], "0L n", "'' form", "CAST(NULL AS LONG) prefix_chars", "CAST(NULL AS LONG) middle_chars", "'' output").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column(len(keep)), batch.column(len(keep) + 1).to_pylist()
            for lo, hi, data, offsets in slices(column, SLICE):
                points, firsts, n = line_ranks(data, offsets)
                index = fit_ranks(points)
                hashes = np.array([id_hashes(seed, i) for i in ids[lo:hi]], np.int64)
                cuts = np.sort(hashes[:, :2] % (n + 1)[:, None], axis=1)
                at = index.offsets(firsts[:, None] + cuts) - index.offsets(firsts)[:, None]
                form, prefix, middle, out = [], [], [], []
                for t, (a, b), h3, h4 in zip(column[lo:hi].to_pylist(), at.tolist(), (hashes[:, 2] % 100).tolist(), (hashes[:, 3] % 100).tolist(), strict=True):
                    t = t or ""
                    if not t or any(s in t for s in SENTINELS) or h3 >= rate:
                        form.append(PLAIN)
                        prefix.append(None)
                        middle.append(None)
                        out.append(t)
                        continue
                    p, s, m = SENTINELS
                    form.append(SPM if h4 < spm_rate else PSM)
                    prefix.append(a)
                    middle.append(b - a)
                    out.append(f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}" if form[-1] == SPM else f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}")
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in range(len(keep))] + made, names=schema.names)

    own = [F.col(f"`{c}`").alias(n) for c, n in zip((text, id_col), free(docs, "text", "id"), strict=True)]
    return docs.select(*[F.col(f"`{c}`") for c in keep], *own).mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No part holds a sentinel, so the first of each kind tells where the parts meet."""
    p, s, m = (F.lit(x) for x in SENTINELS)
    at_p, at_s, at_m = F.locate(SENTINELS[0], output), F.locate(SENTINELS[1], output), F.locate(SENTINELS[2], output)

    def part(mark: Column, begin: Column, end: Column) -> Column:
        return F.substr(output, begin + F.length(mark), end - begin - F.length(mark))

    after = F.length(output) + 1
    psm = F.concat(part(p, at_p, at_s), part(m, at_m, after), part(s, at_s, at_m))
    spm = F.concat(part(p, at_p, at_m), part(m, at_m, after), part(s, at_s, at_p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
