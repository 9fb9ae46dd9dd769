"""Authored files, stored vectors, fragments and neighbourhoods against plain versions."""

import json
import random

import pytest

from sparkwell.catalog import builds, shapes
from sparkwell.operators import graph
from sparkwell.plans import assemble, build
from sparkwell.sources import corpus


def test_commas_in_strings_stay(spark):
    texts = [
        '[{"a": "x,]y"}]', '[{"a": "x,}y",},]', '[{"a": "say \\"hi,]\\" \\\\",}, ]', '// it\'s "odd, ]\n[{"a": "1"}, /* ,] */ {"a": "// no, ]"}, // last ]\n]', '[{"a": "/* ,] */"} , /* a */ // b\n ]', "[]", "no json",
        "[" + ",".join(json.dumps({"a": 'x\\n"' * 2000}) for _ in range(3)) + ",]",
    ]
    want = [["x,]y"], ["x,}y"], ['say "hi,]" \\'], ["1", "// no, ]"], ["/* ,] */"], [], [], ['x\\n"' * 2000] * 3]
    files = spark.createDataFrame([(str(k), "k", t) for k, t in enumerate(texts)], "path string, kind string, text string")
    got = [[] for _ in texts]
    for r in corpus.read_entities(files, "struct<a:string>").orderBy("path", "pointer").collect():
        got[int(r.path)].append(r.a)
    assert got == want


def test_front_matter_and_body(spark):
    texts = {
        "good": '---\n{"id": 1, /* two */ "x": "a,}"}\n---\n# Body\n---\nmore', "spaces": ' --- \r\n{"id": 2,}\r\n---\t\r\nbody', "empty body": '---\n{"id": 3}\n---', "empty front": "---\n---\nbody", "nothing": "---\n{}\n---\nb",
        "no opening": '{"id": 4}\n---\nbody', "no closing": '---\n{"id": 5}\nbody', "no json": "---\nid: 6\n---\nbody", "": "",
    }
    files = spark.createDataFrame([(k, "doc", t) for k, t in texts.items()], "path string, kind string, text string")
    got = {r.path: (r.id, r.x, r.body, r.body_line, r.code) for r in corpus.read_documents(files, "struct<id:bigint,x:string>").collect()}
    assert got == {
        "good": (1, "a,}", "# Body\n---\nmore", 4, None), "spaces": (2, None, "body", 4, None), "empty body": (3, None, "", 4, None), "nothing": (None, None, "b", 4, None),
        "empty front": (None, None, "body", 3, "INVALID_JSON"), "no json": (None, None, "body", 4, "INVALID_JSON"),
        "no opening": (None, None, None, None, "MISSING_OPENING_FENCE"), "": (None, None, None, None, "MISSING_OPENING_FENCE"), "no closing": (None, None, None, None, "MISSING_CLOSING_FENCE"),
    }


def test_vectors_are_embedded_once_and_taken_from_the_store(spark, tmp_path):
    log = str(tmp_path / "asked")

    def provider(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    rows = lambda *texts: spark.createDataFrame([(k, t, None if t is None else f"hash of {t}") for k, t in enumerate(texts)], "id long, semantic_text string, semantic_hash string")
    store = spark.createDataFrame([("other", "hash of a", [9.0, 9.0, 9.0])], "config_hash string, semantic_hash string, vector array<double>")
    got, gained = build.semantic_vectors(rows("a", "bb", "a", None), store, "mine", provider, 2)
    assert {r.id: (r.vector, r.reused) for r in got.collect()} == {0: ([1.0, 1.0], False), 1: ([2.0, 1.0], False), 2: ([1.0, 1.0], False), 3: (None, None)}
    store = store.unionByName(gained)
    got, more = build.semantic_vectors(rows("bb", "ccc", "a", "ccc"), store, "mine", provider, 2)
    assert {r.id: (r.vector, r.reused) for r in got.collect()} == {0: ([2.0, 1.0], True), 1: ([3.0, 1.0], False), 2: ([1.0, 1.0], True), 3: ([3.0, 1.0], False)}
    assert [tuple(r) for r in more.collect()] == [("mine", "hash of ccc", [3.0, 1.0])]
    with open(log) as f:
        assert sorted(f.read().split()) == ["a", "bb", "ccc"]
    with pytest.raises(Exception, match="EMBEDDING_DIMENSION_MISMATCH"):
        build.semantic_vectors(rows("a"), store, "other", provider, 2)[0].collect()
    with pytest.raises(Exception, match="EMBEDDING_DIMENSION_MISMATCH"):
        build.semantic_vectors(rows("dddd"), store, "mine", provider, 3)


def winners(members, mode):
    spec = lambda m: (-m["spec_a"], -m["spec_b"])
    if mode == "all":
        return {m["fragment"] for m in members}
    key = (lambda m: (*spec(m), -m["priority"], m["fragment"])) if mode == "most_specific" else (lambda m: (-m["priority"], *spec(m), m["fragment"]))
    return {min(members, key=key)["fragment"]} if members else set()


def test_groups_that_skills_add_to_are_resolved_again(spark):
    rng = random.Random(8)
    modes = {g: rng.choice(["highest_priority", "most_specific", "all", None]) for g in range(6)}
    about = [
        {"fragment": k, "inclusion": rng.choice(["always", "applicable", "task_relevant"]), "gate": rng.choice([None, None, None, "AUTHORIZATION_NO_MATCH"]), "grp": g, "mode": None if g is None else modes[g], "priority": rng.randint(0, 2), "spec_a": rng.randint(0, 1), "spec_b": rng.randint(0, 1)}
        for k in range(40) for g in [rng.choice([None, *modes])]
    ]
    sources = {q: [sorted(rng.sample(range(40), n)) for n in (12, 10)] + [sorted({(rng.randrange(40), rng.randrange(3)) for _ in range(15)})] for q in range(6)}
    tasks = {q: q % 3 != 0 for q in sources}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    fragments = frame([tuple(a.values()) for a in about], "fragment long, inclusion string, gate string, grp long, mode string, priority int, spec_a int, spec_b int")
    merged = assemble.merge_fragments(
        frame([(q, f) for q, s in sources.items() for f in s[0]], "request_id long, fragment long"), frame([(q, f) for q, s in sources.items() for f in s[1]], "request_id long, fragment long"),
        frame([(q, f, k) for q, s in sources.items() for f, k in s[2]], "request_id long, fragment long, skill long"), fragments,
    )
    got = {(r.request_id, r.fragment): (list(r.sources), list(r.reasons), r.code, r["round"]) for r in assemble.resolve_fragments(merged, fragments, frame(list(tasks.items()), "request_id long, has_task boolean")).collect()}
    want = {}
    for q, (template, task, skills) in sources.items():
        held = {}
        for f in template:
            held[f] = ({"template"}, {assemble.INCLUSION[about[f]["inclusion"]]})
        for f in set(task) - set(template):
            held[f] = ({"task"}, {"TASK_RELEVANT_FRAGMENT"})
        early = set(held)
        for f, k in skills:
            s, r = held.setdefault(f, (set(), set()))
            s.add(f"skill:{k}")
            r.add("SELECTED_SKILL")
        code = {f: about[f]["gate"] or ("TASK_REQUIRED_FOR_FRAGMENT" if about[f]["inclusion"] == "task_relevant" and not tasks[q] else None) for f in held}
        round_ = {f: 0 if code[f] else None for f in held}
        for step in (1, 2):
            for g, mode in modes.items():
                own = [f for f in held if about[f]["grp"] == g and code[f] is None and (step == 2 or f in early)]
                if mode is None or (step == 2 and early.issuperset(own)):
                    continue
                for f in set(own) - winners([about[f] for f in own], mode):
                    code[f], round_[f] = "SELECTION_GROUP_NOT_SELECTED", step
        want |= {(q, f): (sorted(s), sorted(r), code[f], round_[f]) for f, (s, r) in held.items()}
    assert got == want and {r for _, _, _, r in want.values()} == {None, 0, 1, 2}


def test_neighbourhoods_equal_a_plain_walk(spark):
    rng = random.Random(4)
    edges = sorted({(rng.randrange(40), rng.choice("ABC"), rng.randrange(40)) for _ in range(90)})
    domain = {k: rng.choice("xy") for k in range(40)}
    links = sorted({(rng.randrange(40), 100 + rng.randrange(30)) for _ in range(50)})
    centres = [(q, rng.randrange(40), rng.choice([1, 2, 2, 3, 0, None]), rng.choice(["outgoing", "incoming", "both"]), rng.choice([None, "x", "y"])) for q in range(30)]
    only = {q: set(rng.sample("ABCZ", rng.randint(0, 2))) for q in range(30)}
    found = graph.neighbourhood(
        spark.createDataFrame(centres, "request_id long, node long, depth int, direction string, domain string"), spark.createDataFrame([(q, r) for q, s in only.items() for r in s], "request_id long, relation string"),
        spark.createDataFrame(edges, "source long, relation string, target long"), spark.createDataFrame(list(domain.items()), "node long, domain string"), spark.createDataFrame(links, "node long, chunk_id long"),
    )
    want = {"errors": set(), "concepts": set(), "edges": set(), "chunks": set()}
    for q, centre, depth, way, wanted in centres:
        if depth not in (1, 2):
            want["errors"].add((q, "INVALID_INPUT"))
            continue
        seen, front, met = {centre: 0}, {centre}, set()
        for hop in range(1, depth + 1):
            after = set()
            for e in edges:
                if only[q] and e[1] not in only[q]:
                    continue
                for here, there, not_way in ((e[0], e[2], "incoming"), (e[2], e[0], "outgoing")):
                    if here in front and way != not_way:
                        met.add(e)
                        after.add(there)
            front = after - set(seen)
            seen |= {k: hop for k in front}
        concepts = {k: h for k, h in seen.items() if h and (wanted is None or domain[k] == wanted)}
        visible = {centre, *concepts}
        want["concepts"] |= {(q, k, h) for k, h in concepts.items()}
        want["edges"] |= {(q, *e) for e in met if {e[0], e[2]} <= visible}
        want["chunks"] |= {(q, c) for k, c in links if k in visible}
    assert {name: {tuple(r) for r in df.collect()} for name, df in found.items()} == want and all(want.values())


def test_authored_files_are_written_by_many_tasks_and_opened_for_their_text_alone(spark):
    files = builds._authored(spark, "/root/testdata/sf0.001")
    tasks = {r.path.split("/part-")[1][:5] for r in files.select("path").collect()}
    assert len(tasks) > 4  # however little is shuffled
    assert files.where("text LIKE '// entities%'").count() == files.count()
    assert "content" not in files.select("kind")._jdf.queryExecution().executedPlan().toString()


def test_relations_are_no_partitions(spark):
    """Three names of relations would send all edges to three tasks."""
    plan = shapes.jn_edge_endpoints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(relation" not in plan


def test_children_put_edges_together_once(spark):
    plan = shapes.br_children(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "relation_out" in plan and "l_linenumber" not in plan  # read from a table, not joined anew for either end
