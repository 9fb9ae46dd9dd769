"""Contexts against rule trees: distinct leaves by equi joins on the dimension, then trees folded level by level for blocks of rules.

Tables:
  dimensions(dim_key, value_type, cardinality, missing, allowed array<string>, required, trust)
  values(dim_key, value, depth), closure(dim_key, ancestor, descendant): registered enum values
  contexts(request_id, dim_key, value, num): one row per element; a row with null value and num marks an empty array
  nodes(rule_id, node_id, parent_id, level, kind, dim_key, op, operands array<string>): kind allOf, anyOf, noneOf, leaf
  requests(request_id), rules(rule_id): all of them; a request may have no context, and a rule no node (it is true)

States are 0 false, 1 unknown, 2 true, 3 skip; so allOf is min, anyOf max and noneOf 2 - max over what is not skip, and a
group whose children all skip is true. A group without children is an error, as is a leaf that cannot be evaluated: false
with an error. Booleans are the strings "true" and "false".
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.functions import text as T
from sparkwell.operators.cuts import written

#: Fixed operator names: presence, those of multi dimensions, of ordered types, and those that count as positive matches.
PRESENCE = ("exists", "not_exists")
MULTI = ("includes", "includes_any", "includes_all")
ORDERED = ("gt", "gte", "lt", "lte", "between")
NEGATIVE = ("not_equals", "not_in")
SINGLE = ("equals", "in", *NEGATIVE, *ORDERED)
POSITIVE = ("equals", "in", *MULTI, *ORDERED)
STATES = ("false", "unknown", "true")
SKIP = 3
KINDS = ("leaf", "allOf", "anyOf", "noneOf")
#: Nodes of a block of rules, and requests of a slice, that one task folds at once.
NODES, SLICE = 4000, 2000
#: Most tasks that blocks and slices are dealt to; beyond that a task folds several, one after the other.
TASKS = 2000


def grouped_contexts(contexts: DataFrame, closure: DataFrame, values: DataFrame) -> DataFrame:
    """(request_id, dim_key, vals, nums, above): values of a present dimension, and their ancestors with depths."""
    above = closure.select("dim_key", "ancestor", "descendant").join(values.select("dim_key", F.col("value").alias("ancestor"), "depth"), ["dim_key", "ancestor"]).select("dim_key", F.col("descendant").alias("value"), F.struct("ancestor", "depth").alias("up"))
    ups = above.groupBy("dim_key", "value").agg(F.collect_set("up").alias("ups"))
    return (
        contexts.join(ups, ["dim_key", "value"], "left")
        .groupBy("request_id", "dim_key")
        .agg(F.collect_list("value").alias("vals"), F.collect_list("num").alias("nums"), F.flatten(F.collect_list("ups")).alias("above"))
    )


def _match() -> tuple[Column, Column]:
    """(whether a present value matches, depth of the match) before negation, for one operator row."""
    op, ops = F.col("op"), F.col("operands")
    enum = F.col("value_type") == "enum"
    reach = F.when(enum, F.transform("above", lambda u: u["ancestor"])).otherwise(F.col("vals"))
    number = F.col("value_type") == "number"
    text_nums = F.transform(ops, lambda x: x.try_cast("double"))
    any_of = F.when(number, F.size(F.array_intersect(text_nums, F.col("nums"))) > 0).otherwise(F.size(F.array_intersect(ops, reach)) > 0)
    all_of = F.when(number, F.size(F.array_except(text_nums, F.col("nums"))) == 0).otherwise(F.size(F.array_except(ops, reach)) == 0)
    v, d, lo, hi = F.get("nums", F.lit(0)), F.get("vals", F.lit(0)), F.get(ops, F.lit(0)), F.get(ops, F.lit(1))

    def compare(f) -> Column:
        return F.when(number, f(v, lo.try_cast("double"))).otherwise(f(d, lo))

    between = F.when(number, (v >= lo.try_cast("double")) & (v <= hi.try_cast("double"))).otherwise((d >= lo) & (d <= hi))
    matched = (
        F.when(op.isin("equals", "not_equals", "includes", "in", "not_in", "includes_any"), any_of)
        .when(op == "includes_all", all_of)
        .when(op == "gt", compare(lambda a, b: a > b))
        .when(op == "gte", compare(lambda a, b: a >= b))
        .when(op == "lt", compare(lambda a, b: a < b))
        .when(op == "lte", compare(lambda a, b: a <= b))
        .when(op == "between", between)
    )
    depths = F.transform(F.filter("above", lambda u: F.array_contains(ops, u["ancestor"])), lambda u: u["depth"])
    return F.coalesce(matched, F.lit(False)), F.when(enum, F.coalesce(F.array_max(depths), F.lit(0))).otherwise(F.lit(0))


def leaf_states(contexts: DataFrame, leaves: DataFrame, dimensions: DataFrame, values: DataFrame, closure: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, leaf, packed) of every distinct leaf(leaf, dim_key, op, operands) for every request.

    A request meets a leaf through its dimension: with the values it has there, or as absent. Checks run in a fixed
    order; a failed one gives false with an error. packed holds the state (2 bits), whether a positive leaf matched, the
    error (a bit each), and the depth of the match.
    """
    have = grouped_contexts(contexts, closure, values)
    # every request has one row per dimension that some leaf names: its values, or nothing; a registry has few dimensions
    asked = requests.withColumn("dim_key", F.explode(F.array(*[F.lit(r[0]) for r in leaves.select("dim_key").distinct().collect()]).cast("array<string>")))
    registered = values.groupBy("dim_key").agg(F.collect_set("value").alias("registered"))
    kinds = written(leaves.join(dimensions, "dim_key", "left").join(registered, "dim_key", "left"))
    rows = asked.join(have, ["request_id", "dim_key"], "left").join(kinds, "dim_key")
    op, ops, present = F.col("op"), F.col("operands"), F.col("vals").isNotNull()
    n = F.coalesce(F.size("operands"), F.lit(-1))
    no_operand = ops.isNull() | (n == 0)
    kind = F.col("value_type")
    number_operands = F.exists(ops, lambda x: x.try_cast("double").isNull())
    unregistered = F.size(F.array_except(ops, F.coalesce(F.col("registered"), F.array().cast("array<string>")))) > 0
    wrong_shape = (
        ((op == "between") & (n != 2))
        | (op.isin("equals", "not_equals", "includes", "gt", "gte", "lt", "lte") & (n != 1))
        | ((kind == "number") & number_operands)
        | ((kind == "enum") & unregistered)
    )
    lo, hi = F.get(ops, F.lit(0)), F.get(ops, F.lit(1))
    reversed_bounds = (op == "between") & F.when(kind == "number", lo.try_cast("double") > hi.try_cast("double")).otherwise(lo > hi)
    wrong_kind = (op.isin(*MULTI) & (F.col("cardinality") != "multi")) | (op.isin(*SINGLE) & (F.col("cardinality") == "multi")) | (op.isin(*ORDERED) & ~kind.isin("number", "date"))
    matched, depth = _match()
    hit = F.when(op.isin(*NEGATIVE), ~matched).otherwise(matched)
    false, unknown, true, skip, error = (F.lit(x) for x in (0, 1, 2, SKIP, 8))
    missing = F.when(F.col("missing") == "ignore", skip).when(F.col("missing") == "unknown", unknown).otherwise(false)
    packed = (
        F.when(kind.isNull() | op.isNull() | ~op.isin(*PRESENCE, *SINGLE, *MULTI), error)
        .when(op.isin(*PRESENCE) & (n > 0), error)
        .when(op.isin(*PRESENCE), F.when(present == (op == "exists"), true).otherwise(false))
        .when(no_operand | ~F.array_contains("allowed", op), error)
        .when(~present, missing)
        .when(wrong_kind | wrong_shape | reversed_bounds, error)
        .otherwise(F.when(hit, true + F.when(op.isin(*POSITIVE), 4 + 16 * depth).otherwise(0)).otherwise(false))
    )
    return rows.select("request_id", "leaf", packed.cast("int").alias("packed"))


def _fold(states: pa.Table, tree: pa.Table) -> pa.Table:
    """Every rule of a block for every request of a slice: all trees at once, from the deepest level up."""
    names = tree["rule_id"].combine_chunks().dictionary_encode()
    rule, rules = names.indices.to_numpy(), names.dictionary
    node = ~np.asarray(tree["node_id"].is_null())
    column = lambda c, none: tree[c].combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)[node]
    place = rule[node].astype(np.int64) << 32
    key, above, level, leaf, kind = place + column("node_id", 0), column("parent_id", -1), column("level", 0), column("leaf", -1), column("kind", "")
    order = np.argsort(key)
    parent = order[np.minimum(np.searchsorted(key, place + above, sorter=order), len(key) - 1)] if len(key) else key
    parent = np.where((above >= 0) & (key[parent] == place + above), parent, -1) if len(key) else key

    requests, at = np.unique(states["request_id"].to_numpy(), return_inverse=True)
    known = np.flatnonzero(~np.asarray(states["leaf"].is_null()))
    ids, which = np.unique(states["leaf"].combine_chunks().fill_null(-1).to_numpy()[known], return_inverse=True)
    packed = np.full((len(ids) + 1, len(requests)), 8, np.int32)  # a leaf that nothing could evaluate is an error
    packed[which, at[known]] = states["packed"].combine_chunks().fill_null(0).to_numpy()[known]
    state, err = np.zeros((len(key), len(requests)), np.int8), np.ones((len(key), len(requests)), np.int32)
    spec = np.zeros((2, len(key), len(requests)), np.int32)
    leaves = np.flatnonzero(kind == "leaf")
    mine = packed[np.searchsorted(ids, leaf[leaves])]
    state[leaves], err[leaves] = mine & 3, mine >> 3 & 1
    spec[0, leaves], spec[1, leaves] = mine >> 2 & 1, mine >> 4
    for depth in range(int(level.max()) if len(key) else 0, 0, -1):
        below = np.flatnonzero((level == depth) & (parent >= 0))
        below = below[np.argsort(parent[below], kind="stable")]
        if not len(below):
            continue
        group, first = np.unique(parent[below], return_index=True)
        s, true = state[below], state[below] == 2
        a, b = np.where(true, spec[0, below], 0), np.where(true, spec[1, below], 0)
        low = np.minimum.reduceat(np.where(s == SKIP, 9, s), first)
        high = np.maximum.reduceat(np.where(s == SKIP, -1, s), first)
        best = np.maximum.reduceat(a.astype(np.int64) << 32 | b, first)
        all_of, any_of = (kind[group] == "allOf")[:, None], (kind[group] == "anyOf")[:, None]
        state[group] = np.where(low == 9, 2, np.where(all_of, low, np.where(any_of, high, 2 - high)))
        spec[0, group] = np.where(all_of, np.add.reduceat(a, first), np.where(any_of, best >> 32, 0))
        spec[1, group] = np.where(all_of, np.add.reduceat(b, first), np.where(any_of, best & 0xFFFFFFFF, 0))
        err[group] = np.add.reduceat(err[below], first)
    # a rule without nodes is true; so is one that skips
    top = [np.full((len(rules), len(requests)), x, np.int32) for x in (2, 0, 0, 0)]
    roots = np.flatnonzero(above < 0)
    for out, found in zip(top, (np.where(state == SKIP, 2, state), spec[0], spec[1], err), strict=True):
        out[rule[node][roots]] = found[roots]
    for out in top[1:3]:
        out[top[0] != 2] = 0
    return pa.table({
        "request_id": pa.array(np.tile(requests, len(rules)), pa.int64()),
        "rule_id": rules.take(pa.array(np.repeat(np.arange(len(rules)), len(requests)))),
        **{name: pa.array(out.ravel(), pa.int32()) for name, out in zip(("state", "spec_a", "spec_b", "err"), top, strict=True)},
    })


def evaluate(contexts: DataFrame, nodes: DataFrame, dimensions: DataFrame, values: DataFrame, closure: DataFrame, requests: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(request_id, rule_id, state, spec_a, spec_b, err) of every rule for every request; a skipped rule is true.

    requests and rules default to those that stand in contexts and nodes. Equal leaves are evaluated once for all rules.
    Rules are dealt into blocks of about NODES nodes and requests into slices of about SLICE by hash, so a task sees a
    bounded part of both whatever their numbers; without requests or rules there are no verdicts.
    """
    requests = (contexts if requests is None else requests).select("request_id").distinct()
    rules = (nodes if rules is None else rules).select("rule_id").distinct()
    kinds = nodes.where("kind = 'leaf'").select("dim_key", "op", "operands").distinct().withColumn("leaf", F.monotonically_increasing_id())
    kinds, trees = written(kinds), written(nodes.select("rule_id", "node_id", "parent_id", "level", "kind", "dim_key", "op", "operands"))
    blocks = 1 + trees.count() // NODES
    slices = 1 + requests.count() // SLICE
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("dim_key", "op", "operands")]
    numbered = trees.alias("n").join(kinds.alias("k"), [*same, F.col("n.kind") == "leaf"], "left").select("n.rule_id", F.col("n.node_id").cast("long").alias("node_id"), F.col("n.parent_id").cast("long").alias("parent_id"), F.col("n.level").cast("long").alias("level"), "n.kind", "k.leaf")
    none = F.lit(None).cast("long")
    every = rules.select("rule_id", *[none.alias(c) for c in ("node_id", "parent_id", "level")], F.lit(None).cast("string").alias("kind"), none.alias("leaf")).unionByName(numbered)
    every = every.withColumn("block", F.pmod(F.xxhash64("rule_id"), F.lit(blocks)))
    states = leaf_states(contexts, kinds, dimensions, values, closure, requests)
    if blocks > 1:  # a block is sent the leaves that it names
        states = states.join(every.where("leaf IS NOT NULL").select("leaf", F.col("block").alias("of")).distinct(), "leaf").withColumn("block", F.col("of")).drop("of")
    else:
        states = states.withColumn("block", F.lit(0).cast("long"))
    marks = requests.select("request_id", none.alias("leaf"), F.lit(0).alias("packed"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"))
    left = states.select("request_id", "leaf", "packed", "block").unionByName(marks).withColumn("slice", F.pmod(F.xxhash64("request_id"), F.lit(slices)))
    right = every.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))

    def fold(states: pa.Table, tree: pa.Table) -> pa.Table:
        return _fold(states, tree)

    # verdicts are many times what is shuffled for them, so its size must not decide how few tasks fold
    left = left.repartition(min(blocks * slices, TASKS), "block", "slice")
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(fold, "request_id long, rule_id string, state int, spec_a int, spec_b int, err int")


def unsafe_rules(nodes: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Rules that may not authorize: they name a dimension whose absence is ignored."""
    return nodes.where("kind = 'leaf'").join(dimensions.where("missing = 'ignore'"), "dim_key", "left_semi").select("rule_id").distinct()


def authorize(evaluated: DataFrame, nodes: DataFrame, dimensions: DataFrame) -> DataFrame:
    """evaluated plus allowed (true without any error under a rule that is not unsafe) and denial, the code of why not."""
    bad = unsafe_rules(nodes, dimensions).withColumn("unsafe", F.lit(True))
    denial = F.when(F.col("unsafe"), "UNSAFE_AUTHORIZATION_MISSING_BEHAVIOR").when(F.col("err") > 0, "AUTHORIZATION_EVALUATION_FAILED").when(F.col("state") != 2, "AUTHORIZATION_NO_MATCH")
    return evaluated.join(bad, "rule_id", "left").withColumn("denial", denial).withColumn("allowed", F.col("denial").isNull()).drop("unsafe")


def rule_dimensions(nodes: DataFrame) -> DataFrame:
    """(rule_id, dim_key): the dimensions that a rule names."""
    return nodes.where("kind = 'leaf'").select("rule_id", "dim_key").distinct()


def validate_contexts(contexts: DataFrame, dimensions: DataFrame, values: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(request_id, dim_key, code) of every fault; contexts also has trusted (boolean).

    A trusted row overrides what the caller says of a dimension and may set any; the caller may not set those whose
    trust is server. Of one dimension, several values where one is allowed are told first, then a repeated element,
    then wrong types (numbers, days of the calendar, booleans) and values that are not registered. A request with any
    row here is void; requests: all of them, so that one without any context is told what it lacks.
    """
    requests = (contexts if requests is None else requests).select("request_id").distinct()
    known = contexts.join(dimensions, "dim_key", "left")
    coded = lambda df, code: df.select("request_id", "dim_key", F.lit(code).alias("code")).distinct()
    unknown = coded(known.where("value_type IS NULL"), "UNKNOWN_CONTEXT_DIMENSION")
    forbidden = coded(known.where("trust = 'server' AND NOT trusted"), "CONTEXT_DIMENSION_NOT_CLIENT_SETTABLE")
    used = known.where("value_type IS NOT NULL AND (trusted OR trust <> 'server')")
    by = ["request_id", "dim_key"]
    kind = F.col("value_type")
    right_type = (
        F.when(kind == "number", F.col("num").isNotNull() & ~F.isnan("num") & (F.abs("num") != float("inf")))
        .when(kind == "date", F.col("num").isNull() & T.valid_date(F.col("value")))
        .when(kind == "boolean", F.col("num").isNull() & F.col("value").isin("true", "false"))
        .otherwise(F.col("num").isNull())
    )
    empty = F.col("value").isNull() & F.col("num").isNull()
    element = F.when(~empty, F.struct("value", "num"))
    registered = values.select("dim_key", "value", F.lit(True).alias("registered"))
    rows = used.join(registered, ["dim_key", "value"], "left").withColumn("wrong", ~empty & ~F.coalesce(right_type, F.lit(False))).withColumn("strange", ~empty & (kind == "enum") & F.col("num").isNull() & F.col("registered").isNull())
    # what the caller says counts only where no trusted row stands
    sides = rows.groupBy(*by, "trusted").agg(F.first("cardinality").alias("cardinality"), F.count(element).alias("n"), F.size(F.collect_set(element)).alias("d"), F.max("wrong").alias("wrong"), F.max("strange").alias("strange"))
    told = sides.groupBy(*by).agg(F.max_by(F.struct("cardinality", "n", "d", "wrong", "strange"), "trusted").alias("x")).select(*by, "x.*")
    first = F.when((F.col("cardinality") == "single") & (F.col("n") > 1), "CONTEXT_TYPE_MISMATCH").when((F.col("cardinality") == "multi") & (F.col("n") > F.col("d")), "INVALID_CONTEXT")
    codes = F.when(first.isNotNull(), F.array(first)).otherwise(F.array_compact(F.array(F.when(F.col("wrong"), "CONTEXT_TYPE_MISMATCH"), F.when(F.col("strange"), "CONTEXT_ENUM_VALUE_UNKNOWN"))))
    faults = told.select(*by, F.explode(codes).alias("code"))
    required = [r[0] for r in dimensions.where("required").select("dim_key").collect()]  # a registry of a few dozen rows
    needs = requests.withColumn("dim_key", F.explode(F.array(*[F.lit(k) for k in required]).cast("array<string>")))
    absent = coded(needs.join(used.select(*by).distinct(), by, "left_anti"), "REQUIRED_CONTEXT_DIMENSION_MISSING")
    return unknown.unionByName(forbidden).unionByName(faults).unionByName(absent)
