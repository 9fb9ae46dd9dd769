"""Candidate channels for a batch of requests. Each gives (request_id, channel, chunk_id, rank, score), ranks from 1.

A limit is a number, or a column of the requests given as (request_id, limit).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions import text as T
from sparkwell.functions.stem import stem_table
from sparkwell.operators.cuts import cut, written
from sparkwell.operators.similarity import trigram_join

#: Query vectors that are broadcast; more of them meet the corpus by a shuffle.
QUERY_BLOCK = 1024
#: That shuffle deals blocks of so many queries and slices of so many vectors, to so many tasks at most; a task holds so many scores at once.
ASKED, SLICE, TASKS, CELLS = 8192, 10_000, 400, 1 << 22
#: Weights of words of the title, the body and the names of concepts in a cover.
TITLE_WEIGHT, BODY_WEIGHT, NAME_WEIGHT = 1.0, 0.4, 0.2
DIGITS = 9


def ranked(hits: DataFrame, channel: str, limit: int | DataFrame, order: list[Column]) -> DataFrame:
    """The first `limit` hits of each request in `order`."""
    w = Window.partitionBy("request_id").orderBy(*order)
    placed = hits.withColumn("rank", F.row_number().over(w))
    if isinstance(limit, DataFrame):
        placed = placed.join(limit, "request_id").where(F.col("rank") <= F.col("limit"))
    else:
        placed = placed.where(F.col("rank") <= limit)
    return placed.select("request_id", F.lit(channel).alias("channel"), "chunk_id", "rank", "score")


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of vectors with a direction, those as unit vectors)"""
    v = np.array(column.to_pylist(), np.float64)
    v = v.reshape(len(v), -1)
    norm = np.linalg.norm(v, axis=1)
    at = np.flatnonzero(norm > 0)
    return at, v[at] / norm[at, None]


def _nearest(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, groups: list | None, limit: int, kind: pa.DataType | None = None) -> dict[str, pa.Array]:
    """Columns of the `limit` nearest of the vectors (of each group) for every query."""
    request, found, score = [], [], []
    scores = np.round(queries @ vectors.T, DIGITS)
    some = {None: np.arange(len(ids))} if groups is None else {g: np.flatnonzero(np.array([x == g for x in groups])) for g in set(groups)}
    for at in some.values():
        for i, s in enumerate(scores[:, at]):
            top = np.lexsort((ids[at], -s))[:limit] if len(s) <= 4 * limit else None
            if top is None:  # sort no more than what can be among the first
                near = np.flatnonzero(s >= np.partition(s, -limit)[-limit])
                top = near[np.lexsort((ids[at][near], -s[near]))[:limit]]
            request.append(np.full(len(top), names[i]))
            found.append(at[top])
            score.append(s[top])
    place = np.concatenate([np.zeros(0, np.int64), *found])
    out = {"request_id": pa.array(np.concatenate([np.zeros(0, np.int64), *request])), "id": pa.array(ids[place]), "score": pa.array(np.concatenate([np.zeros(0), *score]))}
    return out if groups is None else out | {"by": pa.array([groups[i] for i in place.tolist()], kind)}


def vector_scores(requests: DataFrame, vectors: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """(request_id, id, score and `by`): candidates for the `limit` nearest of vectors(id, vector) by cosine, per value of `by`.

    Up to QUERY_BLOCK requests(request_id, vector) are broadcast, and only each batch's best leave a task: no shuffle.
    More of them are dealt into blocks that meet slices of the corpus by an equi key, so that neither passes through
    the driver. Zero and null vectors have no cosine and no row.
    """
    asked = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col("vector")).where("vector IS NOT NULL")
    extra = [] if by is None else [F.col(by).alias("by")]
    corpus = vectors.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vector", *extra)
    schema = "request_id long, id long, score double" + ("" if by is None else f", by {corpus.schema['by'].dataType.simpleString()}")
    first = asked.limit(QUERY_BLOCK + 1).toArrow()  # of bounded size
    if len(first) <= QUERY_BLOCK:
        at, queries = _unit(first["vector"].combine_chunks()) if len(first) else (np.zeros(0, int), np.zeros((0, 1)))
        shared = vectors.sparkSession.sparkContext.broadcast((first["request_id"].to_numpy()[at], queries))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, unit = shared.value
            for b in batches:
                if b.num_rows and len(names):
                    ok, v = _unit(b.column(1))
                    groups = None if by is None else [b.column(2)[i].as_py() for i in ok.tolist()]
                    yield pa.RecordBatch.from_pydict(_nearest(names, unit, b.column(0).to_numpy()[ok], v, groups, limit, None if by is None else b.column(2).type))

        out = corpus.mapInArrow(best, schema)
    else:
        blocks, slices = 1 + asked.count() // ASKED, 1 + corpus.count() // SLICE
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
        # the vectors of both sides get names of their own: where they are the same column, a cogroup loses one
        left = asked.withColumnRenamed("vector", "asked").withColumn("block", F.pmod(F.xxhash64("request_id"), F.lit(blocks))).withColumn("slice", every(slices))
        right = corpus.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn("block", every(blocks))

        def pair(some: pa.Table, many: pa.Table) -> pa.Table:
            if not len(some) or not len(many):
                return pa.table({f: [] for f in ("request_id", "id", "score", "by")[: 3 + (by is not None)]}, schema=target)
            (a, q), (b, v) = _unit(some["asked"].combine_chunks()), _unit(many["vector"].combine_chunks())
            names = many["by"].to_pylist() if by is not None else None
            groups = None if names is None else [names[i] for i in b.tolist()]
            who, ids, kind = some["request_id"].to_numpy()[a], many["id"].to_numpy()[b], None if by is None else target.field("by").type
            step = max(1, CELLS // max(1, len(ids)))
            parts = [pa.table(_nearest(who[i : i + step], q[i : i + step], ids, v, groups, limit, kind), schema=target) for i in range(0, len(who) if len(ids) else 0, step)]
            return pa.concat_tables(parts) if parts else target.empty_table()

        fields = [("request_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]
        target = pa.schema(fields if by is None else [*fields, ("by", corpus.select("by").limit(0).toArrow().schema.field("by").type)])
        # what is shuffled is small beside the scores made of it, so its size must not decide how few tasks score
        left = left.repartition(min(4 * blocks * slices, TASKS), "block", "slice")
        out = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(pair, schema)
    return out if by is None else out.withColumnRenamed("by", by)


def vector_channel(requests: DataFrame, vectors: DataFrame, limit: int | DataFrame, channel: str = "vector", most: int | None = None) -> DataFrame:
    """Nearest chunks by cosine; ties by id. most: the largest limit, when limits are a column."""
    hits = vector_scores(requests, vectors, limit if most is None else most).withColumnRenamed("id", "chunk_id")
    return ranked(hits, channel, limit, [F.desc("score"), F.col("chunk_id")])


def postings(chunks: DataFrame, names: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """(chunk_id, lexeme, pos, weight) of title, content and the names of concepts, in that order; names(chunk_id, names).

    keep: the lexemes of title and content are written, for who reads them twice; then a chunk's names need only its counts.
    """
    if names is None:
        names = chunks.select("chunk_id").limit(0).withColumn("names", F.lit(""))
    a, b, c = (T.lexemes(T.fold_accents(x)) for x in (F.col("title"), F.col("content"), F.coalesce("names", F.lit(""))))
    weight = F.when(F.col("pos") < F.col("n"), TITLE_WEIGHT).when(F.col("pos") < F.col("m"), BODY_WEIGHT).otherwise(NAME_WEIGHT)
    if keep:
        own = written(chunks.select("chunk_id", a.alias("a"), b.alias("b")).select("chunk_id", F.size("a").alias("n"), (F.size("a") + F.size("b")).alias("m"), F.concat("a", "b").alias("words")).where("words IS NOT NULL"))
        named = own.select("chunk_id", "n", "m").join(names.select("chunk_id", c.alias("c")).hint("merge"), "chunk_id")
        both = own.select("chunk_id", "n", "m", F.posexplode("words").alias("pos", "lexeme"))
        both = both.unionByName(named.select("chunk_id", "n", "m", F.posexplode("c").alias("pos", "lexeme")).withColumn("pos", F.col("m") + F.col("pos")))
    else:
        parts = chunks.join(names.hint("merge"), "chunk_id", "left").select("chunk_id", a.alias("a"), b.alias("b"), c.alias("c"))
        both = parts.select("chunk_id", F.size("a").alias("n"), (F.size("a") + F.size("b")).alias("m"), F.posexplode(F.concat("a", "b", "c")).alias("pos", "lexeme"))
    return both.select("chunk_id", "lexeme", "pos", weight.alias("weight"))


def _stemmed(pairs: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs(request_id, lexeme) and postings with stems for lexemes; of the postings only those of a stem that is asked for.

    Distinct lexemes are stemmed, and the map of those that share an asked stem, small beside the postings, is joined back.
    """
    asked = cut(stem_table(pairs))
    known = stem_table(words).join(asked.select("stem").distinct(), "stem", "left_semi")
    back = lambda df, table: df.join(table, "lexeme").drop("lexeme").withColumnRenamed("stem", "lexeme")
    return back(pairs, asked).distinct(), back(words, written(known)).select(*words.columns)


def fulltext_channel(requests: DataFrame, words: DataFrame, limit: int | DataFrame, stemmed: bool = False) -> DataFrame:
    """Chunks that hold every lexeme of requests(request_id, query), by cover density; stemmed: every stem of its lexemes.

    A request meets the chunks of its rarest lexeme (any would do) and gets the positions of all its lexemes there, so the
    postings are shuffled once. A cover is a shortest stretch with all lexemes, so a chunk that lacks one has none; it
    scores the harmonic mean of its words' weights over one plus the other words in it.
    """
    asked = requests.select("request_id", F.array_sort(F.array_distinct(T.lexemes(T.fold_accents(F.col("query"))))).alias("q")).where(F.size("q") > 0)
    if stemmed:
        pairs, words = _stemmed(asked.select("request_id", F.explode("q").alias("lexeme")), words)
        asked = pairs.groupBy("request_id").agg(F.array_sort(F.collect_set("lexeme")).alias("q"))  # the lexemes of one request
    asked = written(asked.select("request_id", F.size("q").alias("n"), F.posexplode("q").alias("k", "lexeme")))
    most = asked.agg(F.max("n")).first()[0] or 0
    held = words.join(asked.select("lexeme").distinct(), "lexeme", "left_semi")
    held = written(held)  # of all words only those that some request asks for
    often = held.groupBy("lexeme").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "lexeme", "left").groupBy("request_id").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "lexeme")).alias("x")).select("request_id", "x.lexeme")
    # postings compress so well that Spark would broadcast them, hence the hint; a row per request is written and known to be smaller
    near = written(rarest).join(held.select("lexeme", "chunk_id"), "lexeme").select("request_id", "chunk_id").distinct()
    found = near.join(asked, "request_id").join(held.hint("merge"), ["lexeme", "chunk_id"])
    upto = Window.partitionBy("request_id", "chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("k") == k, F.struct("pos", "weight"))).over(upto) for k in range(most)]
    ends = found.select("request_id", "chunk_id", "pos", "n", F.array_compact(F.array(*last) if last else F.array().cast("array<struct<pos:int,weight:double>>")).alias("latest")).where(F.size("latest") == F.col("n"))
    ends = ends.select("request_id", "chunk_id", F.col("pos").alias("e"), F.array_min(F.transform("latest", lambda x: x["pos"])).alias("s"), F.aggregate("latest", F.lit(0.0), lambda a, x: a + 1 / x["weight"]).alias("inv"), "n")
    covers = ends.groupBy("request_id", "chunk_id", "s").agg(F.min(F.struct("e", "inv", "n")).alias("c"))
    score = F.sum((F.col("c.n") / F.col("c.inv")) / (1 + F.col("c.e") - F.col("s") + 1 - F.col("c.n")))
    hits = covers.groupBy("request_id", "chunk_id").agg(F.round(score, DIGITS).alias("score"))
    return ranked(hits, "fullText", limit, [F.desc("score"), F.col("chunk_id")])


def trigram_channel(requests: DataFrame, names: DataFrame, limit: int | DataFrame) -> DataFrame:
    """Chunks whose title or heading is similar to requests(request_id, query); names(chunk_id, name) has one row per name."""
    pairs = trigram_join(requests.select("request_id", "query"), "request_id", "query", names.where("name IS NOT NULL"), "chunk_id", "name")
    hits = pairs.groupBy("request_id", "chunk_id").agg(F.round(F.max("score"), DIGITS).alias("score"))
    return ranked(hits, "trigram", limit, [F.desc("score"), F.col("chunk_id")])


def concept_channel(seeds: DataFrame, links: DataFrame, limit: int | DataFrame) -> DataFrame:
    """Chunks tagged with any seed concept of seeds(request_id, concept_id), by chunk id."""
    hits = seeds.select("request_id", "concept_id").join(links, "concept_id").select("request_id", "chunk_id").distinct().withColumn("score", F.lit(None).cast("double"))
    return ranked(hits, "conceptLinked", limit, [F.col("chunk_id")])


def graph_channel(neighbours: DataFrame, links: DataFrame, keys: DataFrame, relation_order: list[str], limit: int | DataFrame) -> DataFrame:
    """Chunks of expanded concepts: by seed rank, hops, first relation's place, concept key, chunk id; each chunk once."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in relation_order]).cast("array<string>"), F.col("first_relation")), F.lit(0))
    typed = neighbours.withColumn("relation_rank", F.when(place == 0, 1 << 30).otherwise(place - 1))
    # neither links nor keys are broadcast, however small their shuffle files are
    hits = typed.join(links.select(F.col("concept_id").alias("node"), "chunk_id").hint("merge"), "node").join(keys.select(F.col("concept_id").alias("node"), "key").hint("merge"), "node")
    order = [F.col("seed_rank"), F.col("hops"), F.col("relation_rank"), F.col("key"), F.col("chunk_id")]
    once = hits.withColumn("first", F.row_number().over(Window.partitionBy("request_id", "chunk_id").orderBy(*order))).where("first = 1").withColumn("score", F.lit(None).cast("double"))
    return ranked(once, "graphLinked", limit, order)
