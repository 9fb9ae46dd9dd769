"""Unigram token counts: distinct pre-tokens in a trie, forward scores computed once per shared prefix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkwell.llm.stash import small_batches
from sparkwell.llm.text import BYTE_VALUES, NON_SPACE, mix, power_tables, slices, split_words

#: Pre-tokens whose counts one Python worker remembers; beyond them those used least go. It bounds memory and changes no count.
MOST_KNOWN = 2_000_000
#: Bytes of a pre-token that goes into the trie; a longer one (hardly two share much of it) is scored alone, to the same count.
LONG = 256
#: Bytes of text split at once.
SLICE = 1 << 20
#: The mark that stands for the white space before a pre-token.
MARK = "▁"


def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """Log probabilities of the pieces of a public vocabulary by their rank (Zipf's law), and that of one raw byte.

    The file's pieces stand in order of frequency; its byte pieces spell what no piece covers, at less than any piece.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    scores = {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}
    return scores, -math.log(len(pieces)) - norm - 10.0


class Vocabulary:
    """Pieces by the hash of their bytes, and the endings of pieces, both by length: what a walk back from a character meets."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.byte_score = byte_score
        raw = {w.encode("utf-8", "surrogatepass"): s for w, s in scores.items() if w}
        self.longest = max(map(len, raw), default=0)
        self.every = {w[-n:]: raw.get(w[-n:], -math.inf) for w in raw for n in range(1, len(w) + 1)}
        self.endings: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0))]
        for n in range(1, self.longest + 1):
            some = sorted(w for w in self.every if len(w) == n)
            data = np.frombuffer(b"".join(some), np.uint8)
            h = span_hashes(byte_sums(data), np.arange(len(some)) * n, np.arange(1, len(some) + 1) * n)
            order = np.argsort(h)
            self.endings.append((h[order], np.array([self.every[w] for w in some])[order]))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which span_hashes tells the hash of any span of the bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power_tables(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * power_tables(len(total))[1][starts] + (ends - starts).astype(np.uint64))


def alone_count(word: bytes, vocabulary: Vocabulary) -> int:
    """Tokens of one word, by the same scores without a trie."""
    best, few, every = [0.0], [0], vocabulary.every
    for end in range(1, len(word) + 1):
        score, tokens, k = best[-1] + vocabulary.byte_score, few[-1] + 1, end - 1
        while k >= 0 and (value := every.get(word[k:end])) is not None:
            s, t = best[k] + value, few[k] + 1
            if s > score or s == score and t < tokens:
                score, tokens = s, t
            k -= 1
        best.append(score)
        few.append(tokens)
    return few[-1]


def trie_counts(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of the best segmentation of each of some distinct words: most probable, then fewest tokens.

    The words in order are the paths of a trie of bytes; a node is a distinct prefix, found by the bytes that a word
    shares with the one before it. Levels are taken one after another: a node's score and tokens are those of its
    parent and one raw byte, or of an ancestor and a piece that ends here, whichever is best, and are computed once for
    all words below it. From every node the pieces are met by a walk back that ends at the first ending no piece has.
    """
    out = np.zeros(len(words), np.int64)
    order = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=words.__getitem__)
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = alone_count(w, vocabulary)
    if not order:
        return out
    data = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
    size = np.array([len(words[i]) for i in order], np.int64)
    start = np.cumsum(size) - size
    # bytes that a word shares with the one before it: compared level by level
    shared, open_ = np.zeros(len(order), np.int64), np.arange(1, len(order))
    while len(open_):
        at = shared[open_]
        open_ = open_[(at < size[open_]) & (at < size[open_ - 1])]
        at = shared[open_]
        open_ = open_[data[start[open_] + at] == data[start[open_ - 1] + at]]
        shared[open_] += 1
    total = byte_sums(data)
    longest, deep = vocabulary.longest, int(size.max())
    # best[k], few[k]: of the node at depth d - k on every word's path; all words carry them, only first words compute
    best, few = np.zeros((longest + 1, len(order))), np.zeros((longest + 1, len(order)), np.int64)
    counts = np.zeros(len(order), np.int64)
    inside = np.arange(len(order))
    for d in range(1, deep + 1):
        inside = inside[size[inside] >= d]
        fresh = inside[shared[inside] < d]  # the first word with this prefix makes the node
        slot = d % (longest + 1)
        before = (d - 1) % (longest + 1)
        score, tokens = best[before, fresh] + vocabulary.byte_score, few[before, fresh] + 1
        end, walk = start[fresh] + d, np.arange(len(fresh))
        for n in range(1, min(longest, d) + 1):
            table, values = vocabulary.endings[n]
            h = span_hashes(total, end[walk] - n, end[walk])
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            met = table[at] == h
            walk, value = walk[met], values[at[met]]
            if not len(walk):
                break
            back = (d - n) % (longest + 1)
            s, t = best[back, fresh[walk]] + value, few[back, fresh[walk]] + 1
            better = (s > score[walk]) | (s == score[walk]) & (t < tokens[walk])
            score[walk[better]], tokens[walk[better]] = s[better], t[better]
        # words that share the prefix come right after the one that made the node
        owner = np.cumsum(shared[inside] < d) - 1
        best[slot, inside], few[slot, inside] = score[owner], tokens[owner]
        done = inside[size[inside] == d]
        counts[done] = few[slot, done]
    out[order] = counts
    return out


class CountTable:
    """Counts of pre-tokens by hash in sorted arrays; when it is full the half that was used least goes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.hashes, self.counts, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of every row."""
        tokens, words = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for lo, hi, data, offsets in slices(column, SLICE):
            if len(self.hashes) > MOST_KNOWN:
                keep = np.sort(np.argpartition(-self.uses, len(self.uses) // 2)[: len(self.uses) // 2])
                self.hashes, self.counts, self.uses = self.hashes[keep], self.counts[keep], self.uses[keep] // 2
            w = split_words(data, offsets, _CASED)
            distinct, one, back, often = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
            at = np.searchsorted(self.hashes, distinct)
            new = np.ones(len(distinct), bool) if not len(self.hashes) else self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
            if new.any():
                raw = data.tobytes()
                found = trie_counts([_MARK + raw[a:b] for a, b in zip(w.starts[one[new]].tolist(), w.ends[one[new]].tolist(), strict=True)], self.vocabulary)
                self.counts, self.uses = np.insert(self.counts, at[new], found), np.insert(self.uses, at[new], 0)
                self.hashes = np.insert(self.hashes, at[new], distinct[new])
                at = np.searchsorted(self.hashes, distinct)
            self.uses[at] += often
            upto = np.concatenate([[0], np.cumsum(self.counts[at][back])])
            tokens[lo:hi], words[lo:hi] = np.diff(upto[w.bounds]), w.counts
        return tokens, words


_tables: dict[str, CountTable] = {}


def count_table(path: str) -> CountTable:
    """One table per Python worker: later tasks find what earlier ones scored."""
    if path not in _tables:
        _tables[path] = CountTable(Vocabulary(*unigram_scores(path)))
    return _tables[path]


_MARK = MARK.encode()
_CASED = np.where(NON_SPACE > 0, np.arange(256), 0).astype(np.uint8)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs plus n_tokens and n_pretokens.

    Pre-tokens are runs without ASCII white space, each with a mark for the space before it. Distinct ones that a worker
    has not met are inserted into a trie, whose shared prefixes are scored once, and their counts are read at their ends;
    a repeated pre-token costs a look-up. A null text, or one without words, has 0 of both; texts are read whole,
    whatever their length; repeated rows and ids are counted row by row; an empty table gives an empty result. Columns
    of docs called n_tokens or n_pretokens are replaced, all others stay. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_tokens", "n_pretokens")
    names = docs.schema.names
    schema = docs.selectExpr("*", "0L n_tokens", "0L n_pretokens").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = count_table(vocabulary)
        for b in batches:
            tokens, words = table.rows(b.column(text))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(tokens), pa.array(words)], names=schema.names)

    return docs.mapInArrow(run, schema)
