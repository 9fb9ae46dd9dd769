"""Byte-level BPE: distinct pre-tokens of the whole corpus are encoded once, and their ids come back to their positions."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sparkwell.llm.stash import free, new_folder, small_batches

#: Code points of text whose positions stand together; a longer document makes a block of its own.
BLOCK = 16 << 20
#: Bytes of text for each list that distinct pre-tokens are dealt into, so that lists grow in number, not in length.
LIST_BYTES = 1 << 20
#: Bytes of text for each bucket of the table of blocks, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 20_000
#: Code points of a text split in one call; a longer one is read match by match.
AT_ONCE = 1 << 20
_CODEC = "zstd"


def ranks(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file: lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoding(path: str, pattern: str):
    """One for each Python worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(1)
def stand_ins() -> dict[int, str]:
    """Characters that the library that encodes and the one that splits here put in different classes, with a plain one of the right class.

    The two know different versions of Unicode. The first tells its classes by what it finds in all characters.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    bytes_only = {bytes([b]): b for b in range(256)}

    def known(kind: str) -> set[str]:
        e = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=bytes_only, special_tokens={})
        return set(bytes(e.encode_ordinary(every)).decode())

    out, seen = {}, {k: (known(k), set(regex.findall(k, every))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    differs = set().union(*(a ^ b for a, b in seen.values()))
    for c in differs:
        out[ord(c)] = next((plain for k, plain in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", " ")) if c in seen[k][0]), "!")
    return out


class Splitter:
    """Pre-tokens of whole texts as indices into a table of distinct ones.

    Between a single space and the words on both of its sides a pre-token always begins, so words are split once each
    and then looked up; texts with other white space around spaces are split match by match.
    """

    def __init__(self, pattern: str):
        self.pattern, self.plain = regex.compile(pattern), stand_ins()
        self.differs = {chr(c) for c in self.plain}
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.spaced: dict[str, tuple[int, ...]] = {}

    def _matches(self, text: str) -> Iterator[str] | list[str]:
        if not (text.isascii() or self.differs.isdisjoint(text)):
            return (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.plain)))
        return self.pattern.findall(text) if len(text) <= AT_ONCE else (m[0] for m in self.pattern.finditer(text))

    def _by_match(self, text: str) -> np.ndarray:
        words = self.words
        return np.fromiter((words.setdefault(w, len(words)) for w in self._matches(text)), np.uint32)

    def split(self, text: str) -> np.ndarray:
        words, known, out = self.words, self.spaced, []
        first, *more = text.split(" ")
        if not more or not first or first[-1].isspace():
            return self._by_match(text)
        out += [words.setdefault(x, len(words)) for x in self._matches(first)]
        for w in more:
            got = known.get(w)
            if got is None:
                if not w or w[0].isspace() or w[-1].isspace():  # white space beside the space
                    return self._by_match(text)
                got = known[w] = tuple([words.setdefault(x, len(words)) for x in self._matches(" " + w)])
            out += got
        return np.array(out, np.uint32)


def exploded(docs: DataFrame, text: str, pattern: str, lists: int, keep: list[str], names: list[str]) -> DataFrame:
    """Texts in blocks: for each document a row with the places of its pre-tokens, in order, and the block's distinct ones.

    names: the columns block, list, places, words and positions. The distinct pre-tokens of a block are dealt by a hash
    into lists, a row each with their places in the block, so a pre-token leaves a block once, not once a position.
    """
    new = [StructField(n, t) for n, t in zip(names, (LongType(), LongType(), BinaryType(), BinaryType(), BinaryType()), strict=True)]
    schema = StructType([StructField(c, docs.schema[c].dataType) for c in keep] + new)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        block, size = TaskContext.get().partitionId() << 32, 0
        kinds: list[pa.DataType] = []

        def rows(kept: list[pa.Array], *made: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*kept, pa.array([block] * len(made[0]), pa.int64()), *made], names=schema.names)

        def close() -> Iterator[pa.RecordBatch]:
            words = [w.encode() for w in split.words]
            dealt = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % lists
            split.clear()
            order = np.argsort(dealt, kind="stable")
            begins = np.flatnonzero(np.diff(dealt[order], prepend=-1))
            for lo in range(0, len(begins), 1000):
                some = begins[lo : lo + 1000]
                parts = [order[a:b] for a, b in zip(some.tolist(), [*some[1:].tolist(), begins[lo + 1000] if lo + 1000 < len(begins) else len(order)], strict=True)]
                places, lists_ = [_packed(np.diff(p, prepend=0)) for p in parts], [_packed_words([words[i] for i in p.tolist()]) for p in parts]
                n = len(parts)
                yield rows([pa.nulls(n, t) for t in kinds], pa.array(dealt[order][some]), pa.array(places, pa.binary()), pa.array(lists_, pa.binary()), pa.nulls(n, pa.binary()))

        for batch in batches:
            kinds = [batch.column(c).type for c in range(k)]
            first, positions = 0, []
            for i, t in enumerate(batch.column(k).to_pylist(), 1):
                positions.append(_packed(split.split(t or "")))
                size += len(t or "")
                if size >= BLOCK or i == batch.num_rows:
                    n = i - first
                    yield rows([batch.column(c).slice(first, n) for c in range(k)], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(positions, pa.binary()))
                    first, positions = i, []
                if size >= BLOCK:
                    yield from close()
                    block, size = block + 1, 0
        if split.words:
            yield from close()

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(run, schema)


def _packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in few bytes."""
    most = int(values.max()) if len(values) else 0
    values = values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
    return bytes([values.itemsize]) + len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec=_CODEC, asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    kind, n = np.dtype(f"u{raw[0]}"), int.from_bytes(raw[1:9], "little")
    return np.frombuffer(pa.decompress(raw[9:], n * kind.itemsize, codec=_CODEC, asbytes=True), kind)


def _packed_words(words: list[bytes]) -> bytes:
    sizes, data = _packed(np.array([len(w) for w in words], np.int64)), b"".join(words)
    return len(sizes).to_bytes(8, "little") + sizes + len(data).to_bytes(8, "little") + pa.compress(data, codec=_CODEC, asbytes=True)


def _unpacked_words(raw: bytes) -> list[str]:
    at = 8 + int.from_bytes(raw[:8], "little")
    ends = np.cumsum(_unpacked(raw[8:at]).astype(np.int64)).tolist()
    data = pa.decompress(raw[at + 8 :], int.from_bytes(raw[at : at + 8], "little"), codec=_CODEC, asbytes=True)
    return [data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def encode_lists(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(block, places, sizes, ids) of rows(block, list, places, words): all rows of a list meet, so each distinct word is encoded once.

    sizes and ids: how many ids each word of the row has, and all of them, packed.
    """

    def one_list(t: pa.Table) -> pa.Table:
        words = [_unpacked_words(raw) for raw in t["words"].to_pylist()]
        known: dict[str, int] = {}
        which = [np.fromiter((known.setdefault(w, len(known)) for w in row), np.int64, len(row)) for row in words]
        coded = encoding(vocabulary, r"(?s:.+)").encode_ordinary_batch(list(known), num_threads=1)  # a word is not split again
        size = np.array([len(x) for x in coded], np.int64)
        flat, start = np.fromiter((i for x in coded for i in x), np.int64), np.cumsum(size) - size
        sizes, ids = [_packed(size[at]) for at in which], [_packed(flat[ragged(start, size, at)]) for at in which]
        return pa.table({"block": t["block"], "places": t["places"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return rows.groupBy("list").applyInArrow(one_list, "block long, places binary, sizes binary, ids binary")


def in_buckets(rows: DataFrame, column: str, buckets: int) -> DataFrame:
    """rows written as a table in the shared folder that is bucketed by a column, so that what groups by it shuffles nothing."""
    spark, name = rows.sparkSession, f"sparkwell_{uuid.uuid4().hex}"
    rows.write.option("path", new_folder(spark, "buckets")).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and out knows them
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the values of the lists `which`, one list after another."""
    n = sizes[which]
    upto = np.cumsum(n)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts[which] - (upto - n), n)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without the text, plus ids: what a byte-level BPE without special tokens makes of every whole text.

    Pre-tokens are exploded with their positions in blocks of documents; a shuffle brings the equal ones of all blocks
    together, where each distinct one is encoded once; the ids go back to every block that holds it, and each block puts
    its documents together by position. Blocks wait in a bucketed table, so positions are never shuffled. A frequent pre-token is in one row for a block, so no key gathers positions. A
    null or empty text has no ids; a very long one makes a block of its own; repeated rows have their ids each; an empty
    table gives an empty result. A column called ids is replaced, all others stay, whatever their names.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.schema.names if c != text and c.lower() != "ids"]
    names = free(docs, "block", "list", "places", "words", "positions")
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    stash = in_buckets(exploded(docs, text, pattern, 1 + total // LIST_BYTES, keep, names), names[0], min(MOST_BUCKETS, 8 + total // BUCKET_BYTES))
    words = stash.where(F.col(names[3]).isNotNull()).select(*[F.col(n).alias(c) for n, c in zip(names[:4], ("block", "list", "places", "words"), strict=True)])
    encoded = encode_lists(words, vocabulary)
    sought = stash.where(F.col(names[4]).isNotNull()).select(names[0], names[4], *[F.col(f"`{c}`") for c in keep])
    schema = StructType([docs.schema[c] for c in keep] + [StructField("ids", ArrayType(IntegerType()))])

    def together(sought: pa.Table, encoded: pa.Table) -> pa.Table:
        place = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_unpacked(x), dtype=np.int64) for x in encoded["places"].to_pylist())])
        n = np.concatenate([np.zeros(0, np.int64), *map(_unpacked, encoded["sizes"].to_pylist())]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *(_unpacked(x).astype(np.int32) for x in encoded["ids"].to_pylist())])
        size, start = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        size[place], start[place] = n, np.cumsum(n) - n
        out = [flat[ragged(start, size, _unpacked(raw))] for raw in sought[names[4]].to_pylist()]
        ends = np.cumsum([0, *map(len, out)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))
        return pa.table([*(sought[c] for c in keep), ids], names=schema.names)

    return sought.groupBy(names[0]).cogroup(encoded.groupBy("block")).applyInArrow(together, schema)


def token_bytes(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of tokens by id: all bytes end to end, where each token's begin, and how many it has (none: -1)."""
    known = ranks(vocabulary)
    size = np.full(max(known.values(), default=-1) + 1, -1, np.int64)
    size[list(known.values())] = [len(b) for b in known]
    data = b"".join(sorted(known, key=known.__getitem__))
    return np.frombuffer(data, np.uint8), np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), size


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """rows without the ids, plus decoded: the bytes that the ids of every row stand for, one after another.

    Ids meet the table of tokens and their bytes, which is broadcast, as the vocabulary bounds it. A null or empty list
    gives no bytes; an id that the vocabulary lacks is an error; repeated rows are decoded each; an empty table gives an
    empty result. A column called decoded is replaced, all others stay. One pass, no shuffle.
    """
    keep = [c for c in rows.schema.names if c != ids and c.lower() != "decoded"]
    schema = rows.select(*[F.col(f"`{c}`") for c in keep], F.lit(b"").alias("decoded")).schema
    table = rows.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, size = table.value
        for batch in batches:
            lists = batch.column(len(keep))
            out = []
            for row in lists:
                tokens = row.values.to_numpy() if row.is_valid else np.zeros(0, np.int64)
                if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(size) or size[tokens].min() < 0):
                    raise ValueError("an id is not in the vocabulary")
                out.append(data[ragged(starts, size, tokens)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(keep))] + [pa.array(out, pa.binary())], names=schema.names)

    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`")).mapInArrow(run, schema)
