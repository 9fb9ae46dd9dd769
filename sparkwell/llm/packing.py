"""Packing documents into sequences: best fit as they come, then swaps and moves between underfull bins until bins empty."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.stash import cut, free, small_batches
from sparkwell.llm.text import NON_SPACE, slices, split_words

CAPACITY = 4096
#: Pieces packed together in a round; what a group leaves underfull goes on with what others left.
GROUP_PIECES = 4000
#: Units whose ids one Python worker remembers, and bytes of text split at once.
CACHE_WORDS, SLICE = 1_000_000, 1 << 20

_SPACE, _LETTER, _DIGIT, _STOP, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = _STOP
_CLASS[[32, *range(9, 14)]] = _SPACE
#: Units that are one pre-token for certain: Latin letters, or ASCII stops.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-/:-@\[-`{-~]+")


def unit_cuts(data: np.ndarray) -> np.ndarray:
    """Bytes at which a pre-token begins whatever stands around: between ASCII letters, digits and stops, and at every digit.

    A letter after an apostrophe may belong to it ("'s"), and bytes beyond ASCII may be anything, so nothing is cut there.
    """
    kind = _CLASS[data]
    cuts = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    known = (before != _OTHER) & (here != _OTHER)
    cuts[1:] = known & ((before != here) | (here == _DIGIT)) & ~((here == _LETTER) & (data[:-1] == 39))
    return cuts


class WordEncoder:
    """Ids of whole texts from ids of units (parts of words), each encoded once and remembered.

    Right for tokenizers that ignore case, drop white space, keep runs of letters, single digits and runs of stops apart
    and mark the ends of pre-tokens with "</w>", as the default file's; its special tokens begin with "<|". The table of
    units is sorted arrays, not a dictionary; when it is full the half that was used least goes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.hashes, self.first, self.size, self.uses, self.ids = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint32))

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Adds units that are not in the table; hashes are sorted."""
        plain = np.fromiter((_PLAIN.fullmatch(u) is not None for u in units), bool, len(units))
        ids = np.array(self.tokenizer.encode(" ".join([u for u, p in zip(units, plain.tolist(), strict=True) if p]), add_special_tokens=False).ids, np.uint32)
        upto = np.flatnonzero(self.ends[ids]) + 1  # each end closes its unit
        if len(upto) != plain.sum():
            plain[:], ids, upto = False, ids[:0], upto[:0]
        rest = np.flatnonzero(~plain)
        more = [e.ids for e in self.tokenizer.encode_batch_fast([units[i] for i in rest.tolist()], add_special_tokens=False)]
        sizes, first = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        sizes[plain], sizes[rest] = np.diff(upto, prepend=0), [len(x) for x in more]
        first[plain], first[rest] = upto - sizes[plain], len(ids) + np.cumsum(sizes[rest]) - sizes[rest]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.size, self.uses = np.insert(self.hashes, at, hashes), np.insert(self.size, at, sizes), np.insert(self.uses, at, 0)
        self.first = np.insert(self.first, at, len(self.ids) + first)
        self.ids = np.concatenate([self.ids, ids, np.array([i for x in more for i in x], np.uint32)])

    def _forget(self) -> None:
        """Drops the less used half of the table; past uses count half."""
        keep = np.sort(np.argpartition(-self.uses, len(self.uses) // 2)[: len(self.uses) // 2])
        self.hashes, first, self.size, self.uses = self.hashes[keep], self.first[keep], self.size[keep], self.uses[keep] // 2
        upto = np.cumsum(self.size)
        self.ids = self.ids[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - (upto - self.size), self.size)]
        self.first = upto - self.size

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of every row; a null is empty."""
        for _, _, data, offsets in slices(column, SLICE):
            # NUL would pass for white space, and special tokens are no text: such rows go to the tokenizer as they are
            odd = np.flatnonzero((data == 0) | np.append((data[:-1] == 60) & (data[1:] == 124), False)[: len(data)])
            alone = set((np.searchsorted(offsets, odd, "right") - 1).tolist())
            if len(self.hashes) > CACHE_WORDS:
                self._forget()
            w = split_words(data, offsets, NON_SPACE, unit_cuts(data))
            distinct, one, back, often = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
            at = np.searchsorted(self.hashes, distinct)
            new = np.ones(len(distinct), bool) if not len(self.hashes) else self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
            if new.any():
                raw = w.data.tobytes()
                self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(w.starts[one[new]].tolist(), w.ends[one[new]].tolist(), strict=True)])
                at = np.searchsorted(self.hashes, distinct)
            self.uses[at] += often
            which = at[back]
            n = self.size[which]
            upto = np.cumsum(n)
            ids = self.ids[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.first[which] - (upto - n), n)]
            ends = np.concatenate([[0], upto])[w.bounds]
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if i in alone:
                    yield np.array(self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[a:b]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """One row per piece: the columns of docs but the text, then piece, start, length and ids_crc32.

    A document is its ids and end_id; only one longer than capacity is cut. A null or empty text has end_id alone; a
    very long one has many pieces; repeated rows and ids have theirs each; an empty table gives an empty result. Columns
    called piece, start, length or ids_crc32 are replaced, all others but the text stay.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.schema.names if c not in (text, "piece", "start", "length", "ids_crc32")]
    schema = docs.selectExpr(*[f"`{c}`" for c in keep], "0 piece", "0L start", "0L length", "0L ids_crc32").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            for i, ids in enumerate(tool.encode(batch.column(text))):
                raw, n = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()), len(ids) + 1
                for p, a in enumerate(range(0, n, capacity)):
                    row.append(i)
                    piece.append(p)
                    length.append(min(capacity, n - a))
                    crc.append(zlib.crc32(raw[4 * a : 4 * (a + capacity)]))
            kept = batch.select(keep).take(pa.array(row, pa.int64())) if keep else None
            new = [pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays((kept.columns if kept else []) + new, names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in sizes: each piece, as it comes, into the fullest bin that still takes it.

    Pieces are not sorted: exchanges between the bins of mixed pieces empty more of them than those between sorted ones.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i, n in enumerate(sizes):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def _offers(sizes: np.ndarray) -> dict[int, tuple[int, ...]]:
    """Amounts that one or two pieces of a bin add up to, with their places."""
    one: dict[int, list[int]] = {}
    for i, n in enumerate(sizes.tolist()):
        one.setdefault(n, []).append(i)
    out: dict[int, tuple[int, ...]] = {}
    keys = sorted(one)
    for k, a in enumerate(keys):
        if len(one[a]) > 1:
            out.setdefault(2 * a, tuple(one[a][:2]))
        for b in keys[k + 1 :]:
            out.setdefault(a + b, (one[a][0], one[b][0]))
    return out | {a: (x[0],) for a, x in one.items()}


def _transfer(a: np.ndarray, b: np.ndarray, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The exchange (a move, one for one, two for one or one for two) that carries most from a to b within room."""
    give, take = _offers(a), _offers(b) | {0: ()}
    g, t = np.array(sorted(give)), np.array(sorted(take))
    net = g[:, None] - t[None, :]
    two = np.array([len(give[x]) == 2 for x in g.tolist()])[:, None] & np.array([len(take[x]) == 2 for x in t.tolist()])[None, :]
    net[(net > room) | two] = 0
    at = int(net.argmax())
    if net.flat[at] <= 0:
        return None
    return give[int(g[at // len(t)])], take[int(t[at % len(t)])]


def _amounts(sizes: list[int]) -> tuple[list[int], list[int]]:
    """Amounts that one piece of a bin has, and the other ones that two pieces add up to."""
    one = set(sizes)
    return sorted(one), sorted({a + b for k, a in enumerate(sizes) for b in sizes[k + 1 :]} - one)


class _Takers:
    """For every bin, which amounts it gains by when it is given them as one piece, or as two, against what it holds."""

    def __init__(self, n: int, capacity: int):
        self.one, self.two = np.zeros((n, capacity + 1), bool), np.zeros((n, capacity + 1), bool)
        self.capacity = capacity

    def set(self, b: int, sizes: list[int], room: int) -> None:
        one, two = _amounts(sizes)
        single = [0, *one]
        for table, back in ((self.two, single), (self.one, single + two)):
            row = table[b]
            row[:] = False
            for t in back:  # an amount over t, and by no more than the room
                row[t + 1 : t + room + 1] = True

    def of(self, sizes: list[int]) -> np.ndarray:
        one, two = _amounts(sizes)
        two = [x for x in two if x <= self.capacity]
        return self.one[:, one].any(axis=1) | self.two[:, two].any(axis=1)


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins, always from the emptier to the fuller one, until none helps.

    Each raises the sum of squared fills, so the search ends; a bin that becomes empty goes. It also ends when no fewer
    bins can hold the pieces. Only pairs of bins that gain are looked at.
    """
    fills = [sum(sizes[i] for i in b) for b in bins]
    least, count = -(-sum(fills) // capacity), sum(map(bool, bins))
    if count <= least:
        return [b for b in bins if b]
    done = [b for b, f in zip(bins, fills, strict=True) if f >= capacity]
    under = [list(b) for b, f in zip(bins, fills, strict=True) if b and f < capacity]
    fill = np.array([f for b, f in zip(bins, fills, strict=True) if b and f < capacity], np.int64)
    takers = _Takers(len(under), capacity)

    def note(b: int) -> None:
        takers.set(b, [sizes[i] for i in under[b]], capacity - int(fill[b]))

    for b in range(len(under)):
        note(b)
    moved = True
    while moved and count > least:
        moved = False
        for a in np.argsort(fill, kind="stable").tolist():
            while under[a] and count > least:
                own = [sizes[i] for i in under[a]]
                fits = takers.of(own) & (fill >= fill[a]) & (fill < capacity)
                fits[a] = False
                b = int(np.where(fits, fill, -1).argmax())
                if not fits[b]:
                    break
                give, take = _transfer(np.array(own), np.array([sizes[i] for i in under[b]]), capacity - int(fill[b]))
                given, taken = {under[a][i] for i in give}, {under[b][i] for i in take}
                net = sum(sizes[i] for i in given) - sum(sizes[i] for i in taken)
                under[a] = [i for i in under[a] if i not in given] + sorted(taken)
                under[b] = [i for i in under[b] if i not in taken] + sorted(given)
                fill[a], fill[b], moved = fill[a] - net, fill[b] + net, True
                count -= not under[a]
                note(a)
                note(b)
    return done + [b for b in under if b]


def _pack_group(sizes: list[int], bins: list[list[int]] | None, capacity: int) -> list[list[int]]:
    """Bins of places in sizes after the search: from the given ones, or from best fit if that ends in fewer."""
    out = None if bins is None else local_search(bins, sizes, capacity)
    if out is None or len(out) * capacity - sum(sizes) >= capacity:
        fresh = local_search(best_fit(sizes, capacity), sizes, capacity)
        out = fresh if out is None or len(fresh) < len(out) else out
    return out


def _packer(round_: int, capacity: int):
    """Packs one group of rows (uid, size, bin or null, group) in a round."""

    def one_group(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")  # whatever order the shuffle brought
        sizes, start = t["size"].to_pylist(), None
        if t["bin"].null_count == 0:
            of: dict[int, list[int]] = {}
            for i, b in enumerate(t["bin"].to_pylist()):
                of.setdefault(b, []).append(i)
            start = [of[b] for b in sorted(of)]
        sequence, offset, room = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        first = round_ << 56 | t["group"][0].as_py() << 24
        for k, b in enumerate(_pack_group(sizes, start, capacity)):
            upto = 0
            for i in b:
                sequence[i], offset[i] = first + k, upto
                upto += sizes[i]
            for i in b:
                room[i] = capacity - upto
        return pa.table([t["uid"], t["size"], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(room, pa.int64())], names=["uid", "size", "sequence_id", "offset", "room"])

    return one_group


def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """rows plus sequence_id and offset: every row placed in one sequence of at most `capacity`.

    length: 1 to capacity in every row. Rows of full length fill a sequence each. The others are dealt by a hash of
    their place into groups of about group_pieces, so that no task grows with the input and equal rows spread evenly.
    Bins that a group fills are done; the underfull bins of all groups are dealt into fewer groups, where the search
    goes on from them (or starts anew), round by round, until one group holds them all or a round empties none. Each round deals what
    the one before left underfull, so rounds get smaller. Within a group pieces come in reading order and the search
    makes no random choice. An empty table gives an empty result. Columns called sequence_id or offset are replaced,
    all others stay.
    """
    rows = rows.drop("sequence_id", "offset")
    (uid,) = free(rows, "uid")
    rows = cut(rows.withColumn(uid, F.monotonically_increasing_id()))
    none = F.lit(None).cast("long")
    left = rows.where(F.col(length) < capacity).select(F.col(uid).alias("uid"), F.col(length).cast("long").alias("size"), none.alias("bin"))
    placed = rows.where(F.col(length) >= capacity).select(F.col(uid).alias("uid"), (-1 - F.col(uid)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n, bins, round_ = left.count(), None, 0
    while n:
        groups = -(-n // group_pieces)
        dealt = left.withColumn("group", F.pmod(F.xxhash64(F.coalesce("bin", "uid"), F.lit(round_)), F.lit(groups)))
        out = cut(dealt.groupBy("group").applyInArrow(_packer(round_, capacity), "uid long, size long, sequence_id long, offset long, room long"))
        now, n, under = out.agg(F.count_if(F.col("offset") == 0), F.count_if(F.col("room") > 0), F.count_if((F.col("offset") == 0) & (F.col("room") > 0))).first()
        if groups == 1 or (bins is not None and now == bins):
            placed = placed.unionByName(out.select("uid", "sequence_id", "offset"))
            break
        placed = placed.unionByName(out.where("room = 0").select("uid", "sequence_id", "offset"))
        left, bins, round_ = out.where("room > 0").select("uid", "size", F.col("sequence_id").alias("bin")), under, round_ + 1
    keyed = placed.withColumnRenamed("uid", uid)
    return rows.join(keyed, uid).drop(uid).select(*[F.col(f"`{c}`") for c in rows.schema.names if c != uid], "sequence_id", "offset")
