"""Dependencies with causes against a plain walk of random graphs, and skills against taking the closure again and again."""

import os
import random

from sparkwell.operators import graph
from sparkwell.plans import assemble


def random_graph(rng, n):
    edges = {(a, b): rng.choice(["required", "optional"]) for a in range(n) for b in range(a) if rng.random() < 2.2 / n}
    nodes = {k: rng.choice([None, None, None, "LIFECYCLE_NOT_PUBLISHED", "AUTHORIZATION_NO_MATCH"]) for k in range(n) if rng.random() < 0.95}
    return edges, nodes


def plain_broken(edges, nodes, ends):
    """{node: (code, root, hops)}: looked for in growing distance."""
    gated = {k for k in ends if k not in nodes or nodes[k]}
    out = {}
    for k in ends:
        at, seen, hops = {k}, set(), 0
        while at:
            if at & gated:
                root = min(at & gated)
                out[k] = ((nodes.get(k) or "NOT_FOUND") if k in gated else "REQUIRED_DEPENDENCY_UNAVAILABLE", root, hops)
                break
            seen |= at
            at = {b for (a, b), r in edges.items() if a in at and r == "required"} - seen
            hops += 1
    return out


def plain_closure(edges, bad, seeds):
    def walk(start, ok):
        seen, work = set(start), list(start)
        while work:
            x = work.pop()
            for (a, b), r in edges.items():
                if a == x and b not in seen and ok(b, r):
                    seen.add(b)
                    work.append(b)
        return seen

    considered = walk(seeds, lambda b, r: True)
    included = walk({s for s in seeds if s not in bad}, lambda b, r: b not in bad)
    required = walk({s for s in seeds if seeds[s] and s in included}, lambda b, r: r == "required" and b in included)
    status = {}
    for (a, b), r in edges.items():
        if a in considered:
            good = "INCLUDED" if a in included else "BLOCKED_BY_DEPENDENCY"
            status[a, b] = (good, None) if b not in bad else ("UNAVAILABLE" if r == "required" else "OPTIONAL_OMITTED", bad[b][1])
    return considered, included, required, status


def frames(spark, edges, nodes):
    return (
        spark.createDataFrame([(k, v is None, v) for k, v in nodes.items()], "node long, usable boolean, code string"),
        spark.createDataFrame([(a, b, r) for (a, b), r in edges.items()], "source long, target long, requirement string"),
    )


def test_closure_with_causes_equals_a_plain_walk(spark):
    rng = random.Random(11)
    for n in (12, 60):
        edges, nodes = random_graph(rng, n)
        wanted = {q: {rng.randrange(n): rng.random() < 0.5 for _ in range(3)} for q in range(6)} | {77: {n + 5: True}}
        node_rows, edge_rows = frames(spark, edges, nodes)
        seeds = spark.createDataFrame([(q, k, r) for q, s in wanted.items() for k, r in s.items()], "request_id long, node long, required boolean")
        bad = plain_broken(edges, nodes, {x for e in edges for x in e} | {k for s in wanted.values() for k in s})
        assert {r.node: (r.code, r.root, r.hops) for r in graph.broken(node_rows, edge_rows, seeds).collect()} == bad
        verdicts, resolved = graph.dependency_closure(seeds, node_rows, edge_rows)
        got = {(r.request_id, r.node): (r.usable, r.included, r.required, r.code, r.root) for r in verdicts.collect()}
        want, status = {}, {}
        for q, s in wanted.items():
            considered, included, required, own = plain_closure(edges, bad, s)
            want |= {(q, k): (k not in bad, k in included, k in required, *bad.get(k, (None, None))[:2]) for k in considered}
            status |= {(q, *e): v for e, v in own.items()}
        assert got == want
        assert {(r.request_id, r.source, r.target): (r.status, r.cause) for r in resolved.collect()} == status


def test_skills_equal_taking_the_closure_again_and_again(spark):
    rng = random.Random(5)
    edges, nodes = random_graph(rng, 40)
    tools = {k: rng.sample(range(44), rng.randint(1, 3)) for k in range(15)}
    asked = {q: rng.sample(range(15), 6) for q in range(8)}
    node_rows, edge_rows = frames(spark, edges, nodes)
    bad = plain_broken(edges, nodes, set(range(44)))
    kept, causes = {}, set()
    for q, skills in asked.items():
        left = list(skills)
        while True:
            included = plain_closure(edges, bad, {t: True for k in left for t in tools[k]})[1]
            stay = [k for k in left if set(tools[k]) <= included]
            if stay == left:
                break
            left = stay
        kept[q] = set(left)
        causes |= {(q, k, t, *bad[t][:2]) for k in skills for t in tools[k] if t in bad}
    got = assemble.select_skills(
        spark.createDataFrame([(q, k) for q, s in asked.items() for k in s], "request_id long, skill long"),
        spark.createDataFrame([(k, t) for k, ts in tools.items() for t in ts], "skill long, tool long"), node_rows, edge_rows,
    )
    have = {q: set() for q in asked}
    for r in got[0].collect():
        have[r.request_id].add(r.skill)
    assert have == kept and any(kept[q] != set(asked[q]) for q in asked)
    assert {tuple(r) for r in got[2].collect()} == causes
    budgets = spark.createDataFrame([(q, 3, 2) for q in asked], "request_id long, skills int, tools int")
    rows = assemble.usage(spark.createDataFrame([(q, k) for q, s in asked.items() for k in s], "request_id long, skill long"), *got, budgets).collect()
    assert {(r.request_id, r.used, r.over) for r in rows if r.budget == "skills"} == {(q, len(k), len(k) > 3) for q, k in kept.items()}
    for r in rows:
        codes = {}
        for q, k, _, code, _ in causes:
            if q == r.request_id:
                codes.setdefault(code, set()).add(k)
        assert r.removed == ",".join(f"{c}:{len(k)}" for c, k in sorted(codes.items()))


def test_what_keys_reach_is_not_shuffled_as_rows(spark, monkeypatch):
    """Many keys, so that their names cannot be broadcast: rows of bits are shuffled, and of all rounds only the last stays on disk."""
    monkeypatch.setattr(graph, "written", lambda df, f=graph.written: tables.append(f(df)) or tables[-1])
    tables = []
    rng = random.Random(3)
    edges = {(rng.randrange(150), rng.randrange(150)) for _ in range(170)}
    seeds = {(f"k{q % 700}", q % 3, rng.randrange(150)) for q in range(1000)}
    start = spark.createDataFrame(list(seeds), "name string, part int, node long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = graph.reachable(start, spark.createDataFrame(list(edges), "source long, target long"), ["name", "part"])
        got = [tuple(r) for r in out.collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = set()
    for name, part, node in seeds:
        work = [node]
        while work:
            x = work.pop()
            if (name, part, x) not in want:
                want.add((name, part, x))
                work += [b for a, b in edges if a == x]
    assert sorted(got) == sorted(want)
    final = plan.partition("== Initial Plan ==")[0]
    assert "Generate explode" in final and final.index("Generate explode") < final.index("Exchange")  # above all shuffles
    there = [t for t in tables if os.path.exists(t.inputFiles()[0].removeprefix("file://"))]
    assert len(tables) > 4 and len(there) == 2  # the places of keys and the last state
