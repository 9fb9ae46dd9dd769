"""Filters of requests and the static check of rules on hand-made rows."""

import random
import re

from sparkwell.operators import checks
from sparkwell.plans import retrieve


def test_filters_equal_sets(spark):
    rng = random.Random(9)
    members = sorted({(c, kind, str(rng.randrange(6))) for c in range(30) for kind in ("item", "concept", "domain") for _ in range(rng.randint(0, 3))})
    filters = sorted({(q, kind, str(rng.randrange(6))) for q in range(12) for kind in rng.sample(["item", "concept", "domain"], q % 4) for _ in range(3)})
    found = [(q, c, c % 5) for q in range(14) for c in range(30) if rng.random() < 0.7]
    got = retrieve.restrict(
        spark.createDataFrame(found, "request_id long, chunk_id long, score int"), spark.createDataFrame(filters + filters[:5], "request_id long, kind string, value string"),
        spark.createDataFrame(members, "chunk_id long, kind string, value string"),
    )
    asked = {}
    for q, kind, v in filters:
        asked.setdefault(q, {}).setdefault(kind, set()).add((kind, v))
    have = {c: {(kind, v) for x, kind, v in members if x == c} for c in range(30)}
    want = [(q, c, s) for q, c, s in found if all(have[c] & vs for vs in asked.get(q, {}).values())]
    assert sorted((r.request_id, r.chunk_id, r.score) for r in got.collect()) == sorted(want)
    assert any(q in (12, 13) for q, _, _ in want) and len(want) < len(found)


def test_no_filters_leave_everything(spark):
    found = spark.createDataFrame([(1, 2), (1, 3)], "request_id long, chunk_id long")
    none = spark.createDataFrame([], "request_id long, kind string, value string")
    assert retrieve.restrict(found, none, spark.createDataFrame([], "chunk_id long, kind string, value string")).count() == 2


def test_long_lists_of_filters_are_not_sorted(spark):
    found = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "request_id long, chunk_id long")
    filters = spark.range(20000).selectExpr("1L AS request_id", "'item' AS kind", "cast(id + 3 AS string) AS value")
    members = spark.range(5).selectExpr("id AS chunk_id", "'item' AS kind", "cast(id AS string) AS value")
    got = retrieve.restrict(found, filters, members)
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[([^\]]*)\]", plan)
    assert any("value#" in keys for _, keys in joins) and not any("value#" in keys for kind, keys in joins if kind == "SortMergeJoin")


def test_chunk_and_item_must_both_be_allowed(spark):
    merged = spark.createDataFrame([(1, k) for k in range(6)] + [(2, k) for k in range(6)], "request_id long, chunk_id long")
    status = [("published", "published"), ("draft", "published"), ("published", "draft"), ("draft", "draft"), ("published", "deprecated"), ("deprecated", "published")]
    chunks = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(status)], "chunk_id long, status string, item_status string")
    chunks = chunks.selectExpr("*", "CAST(NULL AS TIMESTAMP) effective_from", "CAST(NULL AS TIMESTAMP) effective_to", "CAST(NULL AS STRING) authorization", "CAST(NULL AS STRING) applicability")
    requests = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01', false), (2L, timestamp'2024-01-01', true) t(request_id, as_of, include_draft)")
    verdicts = spark.createDataFrame([], "request_id long, rule_id string, state int, spec_a int, spec_b int, allowed boolean")
    open_ = {(r.request_id, r.chunk_id) for r in retrieve.gate(merged, chunks, requests, verdicts).where("code IS NULL").collect()}
    assert open_ == {(1, 0), (2, 0), (2, 1), (2, 2), (2, 3)}


DIMENSIONS = [
    ("plan", "string", "single", "no_match", ["equals", "in"], "applicability"), ("size", "number", "single", "no_match", ["equals", "gt", "between"], "applicability"),
    ("region", "enum", "multi", "no_match", ["includes", "includes_any"], "descriptive"), ("started", "date", "single", "unknown", ["gte", "between"], "ranking"),
    ("beta", "boolean", "single", "ignore", ["equals"], "authorization"),
]


def leaf(rule, dim, op, *operands, node=1, parent=0, none=False):
    return (rule, node, parent, 1, "leaf", dim, op, None if none else list(operands))


def test_every_static_fault_of_a_rule(spark):
    cases = {
        "good": ([leaf("good", "size", "between", "1", "2"), leaf("good", "region", "includes_any", "eu", "us", node=2), leaf("good", "plan", "exists", node=3, none=True)], set()),
        "unknown": ([leaf("unknown", "colour", "gt")], {("UNKNOWN_DIMENSION", "/allOf/0", "UNKNOWN_DIMENSION")}),
        "operator": ([leaf("operator", "plan", "gt", "a")], {("INVALID_OPERATOR_FOR_DIMENSION", "/allOf/0", "NOT_ALLOWED"), ("INVALID_OPERATOR_FOR_DIMENSION", "/allOf/0", "NEEDS_ORDER")}),
        "single": ([leaf("single", "region", "equals", "eu")], {("INVALID_OPERATOR_FOR_DIMENSION", "/allOf/0", "NOT_ALLOWED"), ("INVALID_OPERATOR_FOR_DIMENSION", "/allOf/0", "NEEDS_SINGLE")}),
        "multi": ([leaf("multi", "plan", "includes", "a")], {("INVALID_OPERATOR_FOR_DIMENSION", "/allOf/0", "NOT_ALLOWED"), ("INVALID_OPERATOR_FOR_DIMENSION", "/allOf/0", "NEEDS_MULTI")}),
        "presence": ([leaf("presence", "plan", "not_exists", "a")], {("INVALID_EXPRESSION", "/allOf/0", "VALUE_FORBIDDEN")}),
        "missing": ([leaf("missing", "plan", "equals", none=True)], {("INVALID_EXPRESSION", "/allOf/0", "VALUE_MISSING")}),
        "shape": ([leaf("shape", "plan", "equals", "a", "b"), leaf("shape", "plan", "in", node=2), leaf("shape", "size", "between", "1", node=3)], {("INVALID_EXPRESSION", f"/allOf/{k}", "WRONG_SHAPE") for k in range(3)}),
        "bounds": ([leaf("bounds", "size", "between", "10", "9"), leaf("bounds", "started", "between", "2025-01-01", "2024-01-01", node=2)], {("INVALID_EXPRESSION", f"/allOf/{k}", "REVERSED_BOUNDS") for k in range(2)}),
        "types": ([leaf("types", "size", "gt", "many"), leaf("types", "started", "gte", "2025-02-30", node=2), leaf("types", "beta", "equals", "yes", node=3)], {("INVALID_FIELD_TYPE", f"/allOf/{k}/value/0", "WRONG_VALUE") for k in range(3)}),
        "values": ([leaf("values", "region", "includes_any", "eu", "moon")], {("DIMENSION_VALUE_NOT_FOUND", "/allOf/0/value/1", "WRONG_VALUE")}),
        "guard": ([leaf("guard", "beta", "equals", "true"), leaf("guard", "region", "includes", "eu", node=2), leaf("guard", "started", "gte", "2025-01-01", node=3)],
                  {("UNSAFE_AUTHORIZATION_MISSING_BEHAVIOR", "/allOf/0", "SKIPPED_WHEN_MISSING"), ("SUSPICIOUS_DIMENSION_CATEGORY_USAGE", "/allOf/1", "CATEGORY"), ("SUSPICIOUS_DIMENSION_CATEGORY_USAGE", "/allOf/2", "CATEGORY")}),
        "empty": ([("empty", 1, 0, 1, "anyOf", None, None, None), ("empty", 2, 0, 1, "someOf", None, None, None)], {("INVALID_EXPRESSION", "/allOf/0", "EMPTY_GROUP"), ("INVALID_EXPRESSION", "/allOf/1", "UNKNOWN_KIND")}),
        "deep": ([("deep", 1, 0, 1, "anyOf", None, None, None), ("deep", 2, 1, 2, "noneOf", None, None, None), leaf("deep", "colour", "equals", "x", node=3, parent=2)], {("UNKNOWN_DIMENSION", "/allOf/0/anyOf/0/noneOf/0", "UNKNOWN_DIMENSION")}),
    }
    nodes = [(rule, 0, None, 0, "allOf", None, None, None) for rule in cases] + [n for rows, _ in cases.values() for n in rows]
    frame = spark.createDataFrame(nodes, "rule_id string, node_id int, parent_id int, level int, kind string, dim_key string, op string, operands array<string>")
    dims = spark.createDataFrame(DIMENSIONS, "dim_key string, value_type string, cardinality string, missing string, allowed array<string>, category string")
    values = spark.createDataFrame([("region", "eu"), ("region", "us")], "dim_key string, value string")
    found = checks.rule_faults(frame, dims, values, spark.createDataFrame([("guard",)], "rule_id string")).collect()
    got = {rule: set() for rule in cases}
    for r in found:
        rule, path = r.subject.split("#")
        got[rule].add((r.code, path, r.reason))
        assert r.severity == ("warning" if r.reason == "CATEGORY" else "error")
    assert got == {rule: want for rule, (_, want) in cases.items()} and len(found) == sum(len(w) for _, w in cases.values())


def test_children_backlinks_and_resolved_concepts(spark):
    from sparkwell.operators import paging
    from sparkwell.plans import evaluate

    links = spark.createDataFrame([("item", "1", "chunk", "b", 0), ("item", "1", "chunk", "a", 5), ("item", "1", "chunk", "c", 5), ("item", "2", "chunk", "x", 1), ("item", "1", "alias", "q", 0)], "parent_kind string, parent string, child_kind string, child string, place long")
    assert {tuple(r) for r in paging.children(links).collect()} == {("item", "1", "chunk", 3, "b", "c"), ("item", "2", "chunk", 1, "x", "x"), ("item", "1", "alias", 1, "q", "q")}
    uses = spark.createDataFrame([("tool", "1", "skill", "9"), ("tool", "1", "skill", "9"), ("tool", "1", "skill", "5"), ("tool", "1", "tool", "5")], "kind string, id string, used_by_kind string, used_by string")
    assert {tuple(r) for r in paging.backlinks(uses).collect()} == {("tool", "1", "skill", 2, "5"), ("tool", "1", "tool", 1, "5")}
    want = spark.createDataFrame([(1, "resolved", 7, -1, 0), (1, "resolved", 8, -1, 0), (1, "include", 7, -1, 0)], "case_id long, kind string, ref_a long, ref_b long, within int")
    delivered = spark.createDataFrame([(1, 8, 1)], "case_id long, ref long, rank int")
    resolved = spark.createDataFrame([(1, 7), (1, 7)], "case_id long, ref long")
    assert {(r.kind, r.ref_a, r.passed) for r in evaluate.assertions(want, delivered, resolved).collect()} == {("resolved", 7, True), ("resolved", 8, False), ("include", 7, False)}
    assert not any(r.passed for r in evaluate.assertions(want, delivered).collect())


def test_provenance_names_sources_and_reasons(spark):
    from sparkwell.operators import graph
    from sparkwell.plans import assemble

    nodes = spark.createDataFrame([(k, k != 5) for k in range(1, 7)], "node long, usable boolean")
    edges = spark.createDataFrame([(1, 2, "required"), (3, 2, "optional"), (1, 3, "optional"), (1, 5, "optional"), (6, 2, "required")], "source long, target long, requirement string")
    seeds = spark.createDataFrame([(9, 1, True), (9, 2, False)], "request_id long, node long, required boolean")
    got = {r.node: (list(r.sources), list(r.required_by), list(r.reasons)) for r in assemble.provenance(*graph.dependency_closure(seeds, nodes, edges), seeds).collect()}
    assert got == {
        1: (["request"], [], ["REQUESTED_TOOL"]), 3: (["tool:1"], [], ["OPTIONAL_TOOL_DEPENDENCY"]),
        2: (["request", "tool:1", "tool:3"], ["1"], ["OPTIONAL_TOOL_DEPENDENCY", "REQUESTED_TOOL", "REQUIRED_TOOL_DEPENDENCY"]),
    }
