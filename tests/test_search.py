"""Stemmed full text and inverted lists of vectors against published pairs and brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell import catalog
from sparkwell.functions.stem import measure, stem, stem_table
from sparkwell.functions.text import STOP_WORDS
from sparkwell.operators import channels, inverted_lists, similarity

#: Words of the examples in Porter's paper, with their stems.
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl
triplicate triplic formative form formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angularity angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control rolling roll generalizations gener oscillators oscil
connect connect connected connect connecting connect connection connect connections connect""".split()


def test_stems_equal_published_pairs():
    assert {w: stem(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten", "orrery")] == [0] * 5 + [1] * 4 + [2] * 4
    assert [stem(w) for w in ("", "as", "is", "Über", "cafés", "x12s", "日本語")] == ["", "as", "is", "Über", "cafés", "x12s", "日本語"]


def test_stem_table_takes_distinct_lexemes(spark):
    rows = spark.createDataFrame([("hopping",), ("hopping",), (None,), ("cats",)], "lexeme string")
    assert sorted(tuple(r) for r in stem_table(rows).collect()) == [("cats", "cat"), ("hopping", "hop")]


def words(text, stemmed):
    found = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w and w not in STOP_WORDS]
    return [stem(w) for w in found] if stemmed else found


def density(query, title, content, stemmed):
    """Cover density by looking at every stretch of a chunk."""
    wanted = set(words(query, stemmed))
    a, b = words(title, stemmed), words(content, stemmed)
    text, weight = a + b, [1.0] * len(a) + [0.4] * len(b)
    if not wanted or not wanted <= set(text):
        return None
    best = {}
    for e in range(len(text)):
        last = {}
        for p in range(e + 1):
            if text[p] in wanted:
                last[text[p]] = p
        if set(last) == wanted and text[e] in wanted:
            s = min(last.values())
            if s not in best or e < best[s][0]:
                best[s] = (e, sum(1 / weight[p] for p in last.values()))
    n = len(wanted)
    return sum((n / inv) / (1 + e - s + 1 - n) for s, (e, inv) in best.items())


@pytest.mark.parametrize("stemmed", [False, True])
def test_full_text_equals_looking_at_every_stretch(spark, stemmed):
    rng = random.Random(5)
    forms = "connect connected connection connections hop hopping hopped the general generalizations cat cats operator operate".split()
    text = lambda n: " ".join(rng.choice(forms) for _ in range(n))
    chunks = [(k, text(rng.randint(0, 3)), text(rng.randint(0, 12))) for k in range(40)]
    asked = [(k, text(rng.randint(1, 3))) for k in range(15)] + [(90, "the"), (91, ""), (92, "absent cats")]
    posted = channels.postings(spark.createDataFrame(chunks, "chunk_id long, title string, content string"))
    got = channels.fulltext_channel(spark.createDataFrame(asked, "request_id long, query string"), posted, 100, stemmed=stemmed).collect()
    want = {(q, c): s for q, query in asked for c, title, content in chunks if (s := density(query, title, content, stemmed)) is not None}
    assert {(r.request_id, r.chunk_id) for r in got} == set(want) and all(abs(r.score - want[r.request_id, r.chunk_id]) < 1e-8 for r in got)
    for q in {q for q, _ in want}:
        mine = sorted((r for r in got if r.request_id == q), key=lambda r: r["rank"])
        assert [r.chunk_id for r in mine] == sorted((c for x, c in want if x == q), key=lambda c: (-round(want[q, c], 9), c))


def exact(q, v, limit):
    q, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (q, v))
    s = np.round(q @ v.T, 9)
    return [np.lexsort((np.arange(len(v)), -row))[:limit].tolist() for row in s]


@pytest.mark.parametrize("hot", [False, True])
def test_inverted_lists_find_near_vectors(spark, hot, monkeypatch):
    monkeypatch.setattr(inverted_lists, "BLOCK", 100)
    monkeypatch.setattr(inverted_lists, "ASKED", 7)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    v = centres[rng.integers(30, size=1500)] + 0.35 * rng.standard_normal((1500, 16))
    if hot:  # a third of all vectors is in one place
        v[::3] = centres[0] + 0.05 * rng.standard_normal((500, 16))
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 16)], "id long, vector array<double>")
    asked = vectors.where("id % 20 = 0 OR id >= 9000").withColumnRenamed("id", "request_id")
    index = inverted_lists.fit(vectors, 5)
    assert len(index.centroids) == 38 and (hot or index.probes < 12)
    filed = inverted_lists.file(vectors, index)
    assert filed.count() == 1500 and filed.select("id").distinct().count() == 1500  # every vector that has a direction, once
    got = {}
    for r in inverted_lists.indexed_vector_channel(asked, filed, index, 5).collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.chunk_id))
    want = dict(zip(range(0, 1500, 20), exact(v[::20], v, 5), strict=True))
    assert set(got) == set(want)
    assert sum(len(set(want[q]) & {c for _, c in got[q]}) for q in want) >= 0.9 * 5 * len(want)
    every = inverted_lists.Lists(index.centroids, len(index.centroids))  # all lists: exact
    full = inverted_lists.indexed_vector_channel(asked, filed, every, 5).collect()
    assert {(r.request_id, r["rank"]): r.chunk_id for r in full} == {(q, k + 1): c for q, cs in want.items() for k, c in enumerate(cs)}


def test_many_requests_out_of_the_vectors_themselves(spark, monkeypatch):
    """Requests and corpus are the same column, as in jn_vector, and meet by a shuffle."""
    for name, n in (("QUERY_BLOCK", 5), ("ASKED", 7), ("SLICE", 30), ("CELLS", 100)):
        monkeypatch.setattr(channels, name, n)
    v = np.random.default_rng(8).standard_normal((100, 6))
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, [0.0] * 6), (901, None)], "vec_id long, embedding array<double>")
    rows = frame.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 5 = 0").select(F.col("id").alias("request_id"), "vector")
    got = {(r.request_id, r["rank"]): r.chunk_id for r in channels.vector_channel(asked, rows, 3).collect()}
    assert got == {(q, k + 1): c for q, cs in zip(range(0, 100, 5), exact(v[::5], v, 3), strict=True) for k, c in enumerate(cs)}


def test_inverted_lists_of_no_vectors(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    index = inverted_lists.fit(none, 5)
    assert inverted_lists.indexed_vector_channel(none.withColumnRenamed("id", "request_id"), inverted_lists.file(none, index), index, 5).collect() == []


def test_recall_of_the_registered_index(spark):
    """Ids divisible by 20 against all; the given vectors have no structure, so nearly all lists are probed."""
    q = catalog.queries()
    want = {(r.request_id, r.id) for r in q["jn_vector"](spark, "/root/testdata/sf0.01").collect()}
    got = {(r.request_id, r.id) for r in q["jn_vector_index"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_registered_stemmed_query_finds_no_less(spark):
    q = catalog.queries()
    pairs = lambda name: {(r.request_id, r.chunk_id) for r in q[name](spark, "/root/testdata/sf0.001").where(F.col("rank") <= 40).collect()}
    plain, stemmed = pairs("tk_fulltext"), pairs("tk_fulltext_stemmed")
    assert plain <= stemmed


def test_postings_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(channels, "cut", lambda df: plans.append(df) or df)
    asked = spark.createDataFrame([(1, "red bolt"), (2, "bolt")], "request_id long, query string")
    words = spark.createDataFrame([(10, "red", 0, 1.0), (10, "bolt", 1, 1.0), (20, "bolt", 0, 0.4)], "chunk_id long, lexeme string, pos int, weight double")
    out = channels.fulltext_channel(asked, words, 10)
    assert sorted((r.request_id, r.chunk_id) for r in out.collect()) == [(1, 10), (2, 10), (2, 20)]
    for df in (*plans, out):  # postings meet candidates by lexeme and chunk; no such side goes through the driver
        assert not re.search(r"BroadcastExchange HashedRelationBroadcastMode\(List\(input\[\d+, \w+, \w+\], input\[", df._jdf.queryExecution().executedPlan().toString())


def test_kept_postings_equal_the_others_and_read_texts_once(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "Red Bolt", "a Bolt, réd"), (2, None, "of bolts"), (3, "x", None), (4, "", "")], "chunk_id long, title string, content string")
    names = spark.createDataFrame([(1, "steel bolt"), (2, "nut"), (9, "gone")], "chunk_id long, names string")
    kept = channels.postings(chunks, names, keep=True)
    assert sorted(kept.collect()) == sorted(channels.postings(chunks, names).collect())
    assert "content" not in kept._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(channels, "cut", None)  # nothing is looked up before the positions, so these are shuffled once
    asked = spark.createDataFrame([(1, "red bolt"), (2, "nut"), (3, "bolt nut")], "request_id long, query string")
    out = channels.fulltext_channel(asked, kept, 10)
    assert [(r.request_id, r.chunk_id) for r in out.orderBy("request_id").collect()] == [(1, 1)]


def test_rows_of_one_frequent_text_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TEXT_BLOCK", 0)
    names = ["red steel bolt", "red steel nut", "blue paper"]
    right = spark.createDataFrame([(k, names[k % 3]) for k in range(600)] + [(900, None)], "id long, name string")
    left = spark.createDataFrame([(q, names[q % 2]) for q in range(6)] + [(9, None)], "query_id long, query string")
    out = similarity.trigram_join(left, "query_id", "query", right, "id", "name", digits=3)
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    grams = [{x for w in n.split() for x in (f"  {w} "[i : i + 3] for i in range(len(w) + 1))} for n in names]
    score = lambda a, b: len(a & b) / len(a | b)
    want = {(q, k): round(score(grams[q % 2], grams[k % 3]), 3) for q in range(6) for k in range(600) if score(grams[q % 2], grams[k % 3]) > 0.3}
    assert {(r.query_id, r.id): r.score for r in rows} == want and len(rows) == len(want)
    assert len({r.task for r in rows if r.id % 3 == 0}) > 8
