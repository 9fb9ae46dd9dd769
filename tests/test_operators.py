"""Chunking, graphs, packing, assembly and evaluation on hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.operators import channels, checks, chunking, concepts, embedding, fusion, graph, paging, similarity
from sparkwell.plans import assemble, build, evaluate
from sparkwell.sources import corpus

MARKDOWN = "lead\n\n## One {#first}\nalpha\n### Deep\nbeta\n```\n## not a heading\n```\n## Two words\ngamma"


def test_sections(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "id long, body string")
    got = {r.section_key: (r.heading, r.content) for r in chunking.sections(docs, "id", "body").collect()}
    assert set(got) == {"intro", "first", "one--deep", "two-words"}
    assert got["intro"] == (None, "lead")
    assert "## not a heading" in got["one--deep"][1]


def test_chunks_cut_long_paragraphs(spark):
    docs = spark.createDataFrame([(1, "## A\n" + "x" * 25)], "id long, body string")
    got = chunking.chunk_documents(docs, "id", "body", 10).orderBy("ordinal").collect()
    assert [r.chunk_key for r in got] == ["a--part-01", "a--part-02", "a--part-03"]
    assert "".join(r.content for r in got) == "## A\n" + "x" * 25


def test_pack_passes_over_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 10, 1, 60, 1), (1, 11, 1, 60, 2), (1, 12, 2, 30, 3), (1, 13, 2, 5, 4), (1, 14, 2, 5, 5)], "request_id long, chunk_id long, item_id long, token_count int, final_rank int")
    got = {r.chunk_id: r.outcome for r in fusion.pack(rows, F.lit(3), F.lit(100), F.lit(2)).collect()}
    assert got == {10: "PACKED", 11: "TOKEN_BUDGET", 12: "PACKED", 13: "PACKED", 14: "TOKEN_BUDGET"}


def test_closure_survives_a_cycle(spark):
    got = graph.closure(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "child string, parent string"))
    assert {(r.ancestor, r.descendant) for r in got.collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("b", "a"), ("a", "b"), ("b", "c"), ("a", "c")}


def test_dependency_closure(spark):
    nodes = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True), (6, True)], "node long, usable boolean")
    edges = spark.createDataFrame([(1, 2, "required"), (2, 3, "optional"), (2, 4, "optional"), (5, 6, "required"), (6, 4, "required")], "source long, target long, requirement string")
    seeds = spark.createDataFrame([(9, 1, True), (9, 5, False)], "request_id long, node long, required boolean")
    verdicts, resolved = graph.dependency_closure(seeds, nodes, edges)
    assert {r.node for r in verdicts.where("included").collect()} == {1, 2, 3}
    assert {r.node for r in verdicts.where("required").collect()} == {1, 2}
    assert {(r.source, r.target): r.status for r in resolved.collect()} == {(1, 2): "INCLUDED", (2, 3): "INCLUDED", (2, 4): "OPTIONAL_OMITTED", (5, 6): "UNAVAILABLE", (6, 4): "UNAVAILABLE"}


def test_tool_budget(spark):
    tools = spark.createDataFrame([(1, 1, True, 1.0, 1, True, 2), (1, 2, False, 0.5, 1, True, 2), (1, 3, False, 0.9, 1, True, 2), (1, 4, False, 0.9, 1, False, 2)], "request_id long, node long, required boolean, score double, priority int, seed boolean, budget int")
    edges = spark.createDataFrame([(2, 4)], "source long, target long")
    got = {r.node: r.status for r in assemble.trim_tools(tools, edges).collect()}
    assert got == {1: "INCLUDED", 2: "BUDGET_OMITTED", 3: "INCLUDED", 4: "BUDGET_OMITTED"}


def test_incremental_equals_clean(spark):
    def rows(*x):
        return build.hashes(spark.createDataFrame(list(x), "id long, title string, body string, lang string, source string, priority int"))

    old, new = rows((1, "a", "x", "en", "s", 1), (2, "b", "y", "en", "s", 1)), rows((1, "a", "x", "en", "s", 2), (3, "c", "z", "en", "s", 1))
    actions = build.plan(old, new)
    assert {(r.id, r.action) for r in actions.collect()} == {(1, "upsert"), (2, "delete"), (3, "upsert")}
    after = build.apply(old, new, actions)
    assert build.differences(after, new).isEmpty()
    assert tuple(build.verify(after, actions).first()) == (0, 0)
    assert old.where("id = 1").first().semantic_hash == new.where("id = 1").first().semantic_hash


def test_entities_with_comments(spark, tmp_path):
    (tmp_path / "concepts").mkdir()
    (tmp_path / "concepts" / "a.jsonc").write_text('// some\n[{"key": "x"}, /* two */ {"key": "y"},]\n')
    files = corpus.read_corpus(spark, str(tmp_path), {"/concepts/": "concept"})
    assert {(r.kind, r.pointer, r.key) for r in corpus.read_entities(files, "struct<key:string>").collect()} == {("concept", "/0", "x"), ("concept", "/1", "y")}


def test_missing_rank_fails(spark):
    want = spark.createDataFrame([(1, "topk", 5, -1, 3), (1, "exclude", 5, -1, 0), (1, "outranks", 6, 7, 0)], "case_id long, kind string, ref_a long, ref_b long, within int")
    have = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "case_id long, ref long, rank int")
    assert {r.kind: r.passed for r in evaluate.assertions(want, have).collect()} == {"topk": False, "exclude": True, "outranks": True}


def brute_trim(rows, needs, budget):
    """Statuses by taking the closure anew after every tool that goes."""
    must, gone = {n for n, r in rows.items() if r["required"]}, set()

    def reached():
        seen = {n for n, r in rows.items() if r["seed"] and n not in gone}
        work = list(seen)
        while work:
            for x in needs.get(work.pop(), ()):
                if x in rows and x not in gone and x not in seen:
                    seen.add(x)
                    work.append(x)
        return seen

    if len(must) > budget:
        return dict.fromkeys(rows, "OVER_BUDGET")
    while len(live := reached()) > budget:
        gone.add(min(live - must, key=lambda n: (rows[n]["score"], rows[n]["priority"], -n)))
    return {n: "INCLUDED" if n in live else "BUDGET_OMITTED" for n in rows}


def test_tool_budget_equals_taking_the_closure_anew(spark):
    rng = random.Random(6)
    data, edges, want = [], [], {}
    for request in range(12):
        n = rng.randint(5, 30)
        mine = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.12}
        needs = {}
        for a, b in mine:
            needs.setdefault(request * 100 + a, []).append(request * 100 + b)
        rows = {request * 100 + k: {"required": False, "score": rng.choice([0.1, 0.5, 0.9]), "priority": rng.randint(1, 2), "seed": rng.random() < 0.4} for k in range(n)}
        if rng.random() < 0.7:
            k = request * 100 + n - 1
            rows[k] |= {"required": True, "seed": True}
        budget = rng.randint(1, n)
        want |= {(request, k): v for k, v in brute_trim(rows, needs, budget).items()}
        data += [(request, k, r["required"], r["score"], r["priority"], r["seed"], budget) for k, r in rows.items()]
        edges += [(a, b) for a, bs in needs.items() for b in bs]
    tools = spark.createDataFrame(data, "request_id long, node long, required boolean, score double, priority int, seed boolean, budget int")
    got = assemble.trim_tools(tools, spark.createDataFrame(edges, "source long, target long")).collect()
    assert {(r.request_id, r.node): r.status for r in got} == want


def test_components_meet_edges_by_tables_of_known_size(spark, monkeypatch):
    def fail(_):
        raise AssertionError("a checkpoint has no size, so its edges are shuffled every round")

    monkeypatch.setattr(graph, "cut", fail)
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 5)], "source long, target long")
    assert sorted(map(tuple, graph.strong_components(edges).collect())) == [(1, 2), (2, 2)]


def test_components_and_cycle_paths(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)})
    reach = {a: {b for x, b in edges if x == a} for a in range(40)}
    for _ in range(40):
        reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
    frame = spark.createDataFrame(edges, "source long, target long")
    assert {r.node for r in graph.cycles(frame).collect()} == {a for a in reach if a in reach[a]}
    got = {r.node: r.component for r in graph.strong_components(frame).collect()}
    want = {a: max(b for b in reach[a] if a in reach[b]) for a in reach if any(b != a and a in reach[b] for b in reach[a])}
    assert got == want
    paths = {r.component: r.path for r in graph.cycle_paths(frame).collect()}
    assert set(paths) == set(want.values())
    for component, path in paths.items():
        assert path[0] == path[-1] == component and len(path) > 2 and all(step in set(edges) for step in zip(path, path[1:]))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggestions_equal_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
    keys, words = sorted({word() for _ in range(60)}), [word() for _ in range(60)] + [None, "zzzzzzzzzzzzzzzzzz"]
    got = similarity.suggest(spark.createDataFrame(list(enumerate(words)), "id int, word string"), "word", spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    for r in got:
        best = min(((distance(r.word, k), k) for k in keys), default=None) if r.word is not None else None
        near = best is not None and best[0] <= max(2, len(r.word) / 3)
        assert (r.suggestion, r.distance) == ((best[1], best[0]) if near else (None, None)), r


def test_packing_of_many_rows_equals_the_fold(spark):
    rng = random.Random(3)
    rows = [(q, k, rng.randint(0, 3), rng.randint(1, 60), k) for q in range(8) for k in range(rng.randint(1, 60))]
    frame = spark.createDataFrame(rows, "request_id long, chunk_id long, item_id long, token_count int, final_rank int")
    a = {(r.request_id, r.chunk_id): r.outcome for r in fusion.pack(frame, F.lit(6), F.lit(100), F.lit(2)).collect()}
    b = {(r.request_id, r.chunk_id): r.outcome for r in fusion.pack_long(frame, 6, 100, 2).collect()}
    assert a == b and set(a.values()) == {"PACKED", "ITEM_CAP", "TOKEN_BUDGET"}


@pytest.mark.parametrize("block", [1024, 7])
def test_nearest_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(channels, "QUERY_BLOCK", block)
    monkeypatch.setattr(channels, "SLICE", 30)
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((90, 5)), rng.standard_normal((12, 5))
    v[7], q[3] = 0, 0
    corpus = spark.createDataFrame([(k, x.tolist(), k % 3) for k, x in enumerate(v)] + [(1000, None, 1)], "id long, vector array<double>, kind int")
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)] + [(99, None)], "request_id long, vector array<double>")
    got = {(r.request_id, r["rank"]): r.chunk_id for r in channels.vector_channel(asked, corpus, 4).collect()}
    with np.errstate(invalid="ignore"):
        s = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T, 9)
    want = {(i, r + 1): int(k) for i in range(12) if i != 3 for r, k in enumerate([k for k in np.lexsort((np.arange(90), -s[i])) if k != 7][:4])}
    assert got == want
    by_kind = channels.vector_scores(asked, corpus, 2, by="kind")
    assert dict(by_kind.dtypes)["kind"] == "int"
    best = {(r.request_id, r.kind): r.m for r in by_kind.groupBy("request_id", "kind").agg(F.max("score").alias("m")).collect()}
    assert all(abs(best[i, k] - max(s[i][j] for j in range(90) if j % 3 == k and j != 7)) < 1e-9 for i in range(12) if i != 3 for k in range(3))


def test_fulltext_needs_every_lexeme_and_folds_accents(spark):
    chunks = spark.createDataFrame([(1, "Café", "pipeline of conversion"), (2, "", "cafe here and conversion there"), (3, "conversion", "nothing else")], "chunk_id long, title string, content string")
    names = spark.createDataFrame([(3, "cafe")], "chunk_id long, names string")
    asked = spark.createDataFrame([(1, "the CAFE conversion"), (2, "  "), (3, "absent cafe")], "request_id long, query string")
    got = channels.fulltext_channel(asked, channels.postings(chunks, names), 10).orderBy("rank").collect()
    assert [(r.request_id, r.chunk_id) for r in got] == [(1, 1), (1, 2), (1, 3)] or {(r.request_id, r.chunk_id) for r in got} == {(1, 1), (1, 2), (1, 3)}
    assert channels.fulltext_channel(asked.where("request_id = 2"), channels.postings(chunks), 10).isEmpty()


def test_a_name_that_is_its_own_alias_hits_twice(spark):
    c = spark.createDataFrame([(1, "red-bolt-1", "red bolt", "red bolt", "published"), (2, "thing-2", "the thing", None, "published")], "concept_id long, key string, name string, alias string, status string")
    asked = spark.createDataFrame([(1, "bolt"), (2, "th"), (3, "xyz")], "request_id long, text string")
    hits = [(r.request_id, r["class"]) for r in concepts.match_hits(asked, c).collect()]
    assert hits.count((1, "LEXICAL")) == 3 and hits.count((2, "LEXICAL")) == 2 and not any(r == 3 for r, _ in hits)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_suggestions_for_words_and_keys_of_all_lengths(spark):
    """Random edits at the bounds of what is near, empty ones, and a word of 2000 letters among short ones."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    keys = ["", "a", some(2000), some(700)] + [some(rng.randint(1, 40)) for _ in range(60)]
    words = ["", "ab", "abc", keys[2][300:] + some(200)]
    for _ in range(120):
        letters = list(rng.choice(keys[4:]))
        for _ in range(rng.randint(0, 2 + len(letters) // 3)):
            at = rng.randint(0, len(letters))
            letters[at : at + rng.randint(0, 1)] = some(rng.randint(0, 1))
        words.append("".join(letters))
    got = similarity.suggest(spark.createDataFrame(list(enumerate(words)), "id int, word string"), "word", spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    assert len(got) == len(words)
    for r in got:
        if len(r.word) > 1000:
            assert r.suggestion == keys[2] and r.distance <= 500
            continue
        most = max(2, len(r.word) // 3)
        near = sorted((e, k) for k in keys if abs(len(k) - len(r.word)) <= most and (e := _edits(r.word, k)) <= most)
        assert (r.suggestion, r.distance) == ((near[0][1], near[0][0]) if near else (None, None)), r


def test_references_of_the_wrong_kind_and_suggestions(spark):
    rows = spark.createDataFrame([(1, "alpha", "tool"), (2, "alpah", "tool"), (3, "beta", "tool"), (4, None, "tool"), (5, "entirely different", "skill")], "subject long, ref string, kind string")
    targets = spark.createDataFrame([("alpha", "tool"), ("beta", "skill")], "key string, kind string")
    got = {(r.subject, r.code, r.suggestion) for r in checks.reference_faults(rows, targets).collect()}
    assert got == {(2, "REFERENCE_NOT_FOUND", "alpha"), (3, "REFERENCE_TYPE_MISMATCH", None), (5, "REFERENCE_NOT_FOUND", None)}


def test_look_up_by_id_or_key(spark):
    e = spark.createDataFrame([("item", 1, "a", None), ("chunk", 10, "x", 1), ("chunk", 20, "x", 2)], "kind string, id long, key string, parent long")
    asked = spark.createDataFrame([(1, "item", 1, None, None), (2, "item", None, "a", None), (3, "chunk", None, "x", 2), (4, "item", 1, "a", None), (5, "item", None, None, None), (6, "chunk", None, "x", None)], "request_id long, kind string, id long, key string, parent long")
    got = {r.request_id: (r.found, r.code) for r in paging.lookup(asked, e).collect()}
    assert got == {1: (1, None), 2: (1, None), 3: (20, None), 4: (None, "INVALID_INPUT"), 5: (None, "INVALID_INPUT"), 6: (None, "ENTITY_NOT_FOUND")}


def test_a_provider_of_vectors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "a")], "id long, text string")
    got = {r.id: r.vector for r in embedding.embed(rows, "text", lambda texts: [[float(len(t)), 1.0] for t in texts], 2, batch=1).collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: None, 4: [1.0, 1.0]}
    with pytest.raises(Exception, match="EMBEDDING_DIMENSION_MISMATCH"):
        embedding.embed(rows, "text", lambda texts: [[1.0] for _ in texts], 2).collect()


def test_texts_meet_the_same_broadcast_or_shuffled(spark, monkeypatch):
    words = ["blue ring", "blue-ring-17", "Blue  Ring", "ring", "", "  ", "---", None, "é ring", "red bolt", "bolt", "ri", "old plate of blue steel"]
    left = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "a long, t string")
    right = spark.createDataFrame([(i, w) for i, w in enumerate(words + words[:4])], "b long, u string")
    pairs = lambda: sorted((r.a, r.b, r.score) for r in similarity.trigram_join(left, "a", "t", right, "b", "u").collect())
    known = spark.createDataFrame([(i, f"{w}-{i}", w, words[-i - 1], "published") for i, w in enumerate(words) if w is not None], "concept_id long, key string, name string, alias string, status string")
    asked = left.select(F.col("a").alias("request_id"), F.col("t").alias("text")).where("t IS NOT NULL")
    hits = lambda: sorted(str(tuple(r)) for r in concepts.match_hits(asked, known).collect())
    plan = concepts.match_hits(asked, known)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan  # the names stay where they are
    few, named = pairs(), hits()
    assert few and any("LEXICAL" in x for x in named) and any("TRIGRAM" in x for x in named)
    monkeypatch.setattr(similarity, "TEXT_BLOCK", 0)
    assert pairs() == few and hits() == named


def test_names_and_links_are_not_broadcast(spark):
    near = spark.createDataFrame([(1, 5, 1, 1, "R")], "request_id long, node long, seed_rank int, hops int, first_relation string")
    links = spark.createDataFrame([(9, 5)], "chunk_id long, concept_id long")
    keys = spark.createDataFrame([(5, "k")], "concept_id long, key string")
    out = channels.graph_channel(near, links, keys, ["R"], 3)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.request_id, r.chunk_id, r["rank"]) for r in out.collect()] == [(1, 9, 1)]


def test_many_keys_share_the_rows_of_a_walk(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(500)]
    seeds = [(f"k{i}", rng.randrange(320)) for i in range(1500)] + [("k0", 7), ("k0", 7)]
    below = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)
    want = set()
    for k, node in set(seeds):
        todo, seen = [node], {node}
        while todo:
            for x in below.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        want |= {(k, x) for x in seen}
    df = spark.createDataFrame(seeds, "k string, node long")
    got = graph.reachable(df, spark.createDataFrame(pairs, "source long, target long"), ["k"])
    rows = [(r.k, r.node) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    places = graph._numbered(df, ["k"])
    assert places.select("block", "lane", "bit").distinct().count() == 1500 and places.select("block").distinct().count() < 20


def test_group_winners_equal_the_windows_and_sort_no_group(spark):
    rng = random.Random(5)
    kinds = {0: "all", 1: "most_specific", 2: "highest_priority", 3: None}
    data = [(i % 3, i, (g := rng.choice([None, *range(8)])), kinds.get(g % 4) if g is not None else rng.choice(list(kinds.values())), rng.choice([None, 1, 2]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in range(400)]
    rows = spark.createDataFrame(data, "r long, id long, grp int, mode string, priority int, spec_a int, spec_b int")
    want = rows.withColumn("wins", fusion.group_winner("grp", F.col("mode"), "id", ("r",))).where("wins").select("r", "id")
    got = fusion.group_winners(rows, "grp", F.col("mode"), "id", ("r",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
