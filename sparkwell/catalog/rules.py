"""Filters, contexts and rules: customers as contexts, rules from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.catalog import model as M
from sparkwell.operators import graph, rules
from sparkwell.operators.cuts import written

#: Fixed registry of the dimensions used below.
DIMENSIONS = [
    ("segment", "string", "single", "no_match", ["equals", "in", "not_equals", "not_in"], True, "caller"),
    ("acctbal", "number", "single", "no_match", ["equals", "gt", "gte", "lt", "lte", "between"], False, "caller"),
    ("nation", "enum", "single", "no_match", ["equals", "in", "not_equals", "not_in"], False, "caller"),
    ("priorities", "string", "multi", "ignore", ["includes", "includes_any", "includes_all"], False, "caller"),
    ("first_order", "date", "single", "unknown", ["equals", "gt", "gte", "lt", "lte", "between"], False, "caller"),
    ("clearance", "string", "single", "no_match", ["equals"], False, "server"),
]


def dimensions(s):
    return s.createDataFrame(DIMENSIONS, "dim_key string, value_type string, cardinality string, missing string, allowed array<string>, required boolean, trust string")


def enum_values(s, d):
    """Regions above nations: (dim_key, value, parent)."""
    r, n = M.table(s, d, "region"), M.table(s, d, "nation")
    top = r.select(F.lit("nation").alias("dim_key"), F.col("r_name").alias("value"), F.lit(None).cast("string").alias("parent"))
    return top.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("nation").alias("dim_key"), F.col("n_name").alias("value"), F.col("r_name").alias("parent")))


def registry(s, d):
    """(values with depth, closure) of the nation dimension."""
    v = enum_values(s, d)
    c = written(graph.closure(v, "value", "parent").withColumn("dim_key", F.lit("nation")))
    depth = c.groupBy("dim_key", F.col("descendant").alias("value")).agg(F.max("depth").alias("depth"))
    return depth, c


def customers(s, d):
    return M.table(s, d, "customer").select(F.col("c_custkey").alias("request_id"))


def contexts(s, d):
    """Customers in long form: segment, balance, nation, the set of order priorities, the first order's day."""
    c = M.table(s, d, "customer").join(M.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = M.table(s, d, "orders")
    num = F.lit(None).cast("double")
    k = F.col("c_custkey").alias("request_id")
    rows = c.select(k, F.lit("segment").alias("dim_key"), F.col("c_mktsegment").alias("value"), num.alias("num"))
    rows = rows.unionByName(c.select(k, F.lit("acctbal").alias("dim_key"), F.lit(None).cast("string").alias("value"), F.col("c_acctbal").alias("num")))
    rows = rows.unionByName(c.select(k, F.lit("nation").alias("dim_key"), F.col("n_name").alias("value"), num.alias("num")))
    own = o.select(F.col("o_custkey").alias("request_id"), F.col("o_orderpriority").alias("value")).distinct()
    rows = rows.unionByName(own.select("request_id", F.lit("priorities").alias("dim_key"), "value", num.alias("num")))
    first = o.groupBy(F.col("o_custkey").alias("request_id")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("value"))
    return rows.unionByName(first.select("request_id", F.lit("first_order").alias("dim_key"), "value", num.alias("num")))


def nodes(s, d):
    """A rule for every brand and type: allOf[nation, anyOf[balance, segment], noneOf[priorities (every other rule), allOf[first order]]]."""
    p = M.table(s, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("n"), F.min("p_retailprice").alias("price"))
    n = F.col("n")
    regions, segments = F.array(*[F.lit(x) for x in REGIONS]), F.array(*[F.lit(x) for x in SEGMENTS])
    nation = F.when(n % 3 == 0, F.concat(F.lit("NATION_"), (n % 25).cast("string"))).otherwise(F.get(regions, (n % 5).cast("int")))
    price = (F.round("price") * 5 - 2000).cast("int").cast("string")

    def node(i, parent, level, kind, dim=None, op=None, operands=None):
        return F.struct(F.lit(i).alias("node_id"), F.lit(parent).cast("int").alias("parent_id"), F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.lit(dim).cast("string").alias("dim_key"), F.lit(op).cast("string").alias("op"), (operands if operands is not None else F.lit(None)).cast("array<string>").alias("operands"))

    tree = [
        node(0, None, 0, "allOf"), node(1, 0, 1, "leaf", "nation", "equals", F.array(nation)), node(2, 0, 1, "anyOf"),
        node(3, 2, 2, "leaf", "acctbal", "gte", F.array(price)), node(4, 2, 2, "leaf", "segment", "equals", F.array(F.get(segments, (n % 5).cast("int")))),
        node(5, 0, 1, "noneOf"), node(6, 5, 2, "leaf", "priorities", "includes_any", F.array(F.lit("1-URGENT"), F.lit("5-LOW"))),
        node(7, 5, 2, "allOf"), node(8, 7, 3, "leaf", "first_order", "lt", F.array(F.concat(F.lit("1997-"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit("-01")))),
    ]
    rows = p.select(F.concat_ws("/", "p_brand", "p_type").alias("rule_id"), "n", F.explode(F.array(*tree)).alias("x")).select("rule_id", "n", "x.*")
    return rows.where("n % 2 = 0 OR node_id <> 6").drop("n")


#: Fixed names of the given tables.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _evaluated(s, d):
    values, closure = registry(s, d)
    return rules.evaluate(contexts(s, d), nodes(s, d), dimensions(s), values, closure, requests=customers(s, d))


def _named(state="state"):
    return F.get(F.array(*[F.lit(x) for x in rules.STATES]), F.col(state))


def pr_rules(s, d):
    return _evaluated(s, d).select("request_id", "rule_id", _named().alias("state"), "spec_a", "spec_b", "err")


def pr_authorize(s, d):
    return rules.authorize(_evaluated(s, d), nodes(s, d), dimensions(s)).where("allowed").select("request_id", "rule_id")


def pr_simulate(s, d):
    both = rules.authorize(_evaluated(s, d), nodes(s, d), dimensions(s))
    return both.select("request_id", "rule_id", _named().alias("state"), "allowed", F.coalesce("denial", F.lit("")).alias("denial"), (F.col("state") == 2).alias("eligible"), "spec_a", "spec_b", "err")


def pr_rule_dimensions(s, d):
    used = rules.rule_dimensions(nodes(s, d))
    return used.groupBy("dim_key").agg(F.count("*").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("used_by"))


def src_dim_registry(s, d):
    values, closure = registry(s, d)
    above = closure.groupBy(F.col("descendant").alias("value")).agg(F.array_join(F.array_sort(F.collect_set("ancestor")), ",").alias("ancestors"))
    return values.join(above, "value").select("dim_key", "value", "depth", "ancestors")


def pr_context_validate(s, d):
    """The contexts of customers with faults for some of them, and a few requests that say nothing."""
    base = contexts(s, d).withColumn("trusted", F.lit(False))
    ids = customers(s, d)

    def extra(r, dim, value, num=None, trusted=False):
        return ids.where(f"request_id % 50 = {r}").select("request_id", F.lit(dim).alias("dim_key"), F.lit(value).cast("string").alias("value"), F.lit(num).cast("double").alias("num"), F.lit(trusted).alias("trusted"))

    k = F.col("request_id") % 50
    faulty = base.where("NOT (request_id % 50 = 11 AND dim_key = 'segment') AND NOT (request_id % 50 IN (19, 37) AND dim_key = 'first_order')")
    faulty = faulty.withColumn("value", F.when((k == 41) & (F.col("dim_key") == "nation"), "ATLANTIS").otherwise(F.col("value")))
    for row in ((7, "colour", "red"), (13, "segment", "OTHER"), (17, "priorities", "again"), (17, "priorities", "again"), (19, "first_order", None, 5.0), (23, "nation", "ATLANTIS", None, True), (29, "clearance", "high"), (31, "clearance", "high", None, True), (37, "first_order", "2025-02-30"), (43, "acctbal", "many", None, True), (43, "acctbal", None, float("inf"))):
        faulty = faulty.unionByName(extra(*row))
    values, _ = registry(s, d)
    silent = ids.where("request_id % 50 = 0").select((-F.col("request_id") - 1).alias("request_id"))
    return rules.validate_contexts(faulty, dimensions(s), values, requests=ids.unionByName(silent))


#: Dimensions that take every operator, so that one that does not fit is told by its kind and not by the list.
_EVERY = [*rules.PRESENCE, *rules.SINGLE, *rules.MULTI]
_OPERATOR_DIMS = [(dim, kind, number, missing, _EVERY if dim != "closed" else ["equals"], False, "caller") for dim, kind, number, missing in (
    ("segment", "string", "single", "no_match"), ("acctbal", "number", "single", "unknown"), ("nation", "enum", "single", "no_match"), ("priorities", "string", "multi", "ignore"),
    ("first_order", "date", "single", "unknown"), ("rich", "boolean", "single", "no_match"), ("closed", "string", "single", "no_match"))]
#: Whether a customer has a dimension, and what an absent one counts as.
_HAS = {"segment": ("segment is not null", 0), "acctbal": ("acctbal is not null", 1), "nation": ("nation is not null", 0), "priorities": ("prios is not null", 3), "first_order": ("first_order is not null", 1), "rich": ("acctbal is not null and k % 7 <> 0", 0), "closed": ("false", 0)}
#: (dimension, operator, operands, the match in SQL, its depth); without a match the leaf is an error.
_OPERATOR_RULES = [
    ("segment", "equals", ["BUILDING"], "segment = 'BUILDING'", "0"), ("segment", "not_equals", ["BUILDING"], "segment <> 'BUILDING'", "0"), ("segment", "in", ["BUILDING", "MACHINERY"], "segment in ('BUILDING', 'MACHINERY')", "0"),
    ("segment", "not_in", ["BUILDING", "MACHINERY"], "segment not in ('BUILDING', 'MACHINERY')", "0"), ("segment", "gt", ["A"], None, "0"), ("segment", "includes", ["BUILDING"], None, "0"),
    ("acctbal", "equals", ["1000"], "acctbal = 1000", "0"), ("acctbal", "not_equals", ["1000"], "acctbal <> 1000", "0"), ("acctbal", "in", ["1000", "2000"], "acctbal in (1000, 2000)", "0"), ("acctbal", "not_in", ["1000", "2000"], "acctbal not in (1000, 2000)", "0"),
    ("acctbal", "gt", ["3000"], "acctbal > 3000", "0"), ("acctbal", "gte", ["3000.5"], "acctbal >= 3000.5", "0"), ("acctbal", "lt", ["3000"], "acctbal < 3000", "0"), ("acctbal", "lte", ["-1"], "acctbal <= -1", "0"),
    ("acctbal", "between", ["0", "5000"], "acctbal between 0 and 5000", "0"), ("acctbal", "between", ["5000", "0"], None, "0"), ("acctbal", "equals", ["many"], None, "0"),
    ("nation", "equals", ["ASIA"], "region = 'ASIA'", "0"), ("nation", "equals", ["NATION_3"], "nation = 'NATION_3'", "1"), ("nation", "not_equals", ["ASIA"], "region <> 'ASIA'", "0"), ("nation", "in", ["ASIA", "NATION_3"], "region = 'ASIA' or nation = 'NATION_3'", "case when nation = 'NATION_3' then 1 else 0 end"),
    ("nation", "not_in", ["ASIA", "NATION_3"], "region <> 'ASIA' and nation <> 'NATION_3'", "0"), ("nation", "equals", ["ATLANTIS"], None, "0"),
    ("priorities", "includes", ["1-URGENT"], "list_contains(prios, '1-URGENT')", "0"), ("priorities", "includes_any", ["1-URGENT", "5-LOW"], "list_has_any(prios, ['1-URGENT', '5-LOW'])", "0"), ("priorities", "includes_all", ["1-URGENT", "5-LOW"], "list_has_all(prios, ['1-URGENT', '5-LOW'])", "0"), ("priorities", "equals", ["5-LOW"], None, "0"),
    ("first_order", "equals", ["1995-01-01"], "first_order = '1995-01-01'", "0"), ("first_order", "gt", ["1995-06-01"], "first_order > '1995-06-01'", "0"), ("first_order", "gte", ["1995-06-01"], "first_order >= '1995-06-01'", "0"), ("first_order", "lt", ["1995-06-01"], "first_order < '1995-06-01'", "0"),
    ("first_order", "lte", ["1995-06-01"], "first_order <= '1995-06-01'", "0"), ("first_order", "between", ["1995-01-01", "1995-12-31"], "first_order between '1995-01-01' and '1995-12-31'", "0"),
    ("rich", "equals", ["true"], "acctbal > 5000", "0"), ("rich", "not_equals", ["true"], "acctbal <= 5000", "0"), ("rich", "gt", ["true"], None, "0"),
]


def _operator_rules():
    """(rule_id, dimension, operator, operands, match, depth) with presence and operators that are refused wherever they stand."""
    out = [(f"{dim} {op} {'/'.join(v)}", dim, op, v, match, depth) for dim, op, v, match, depth in _OPERATOR_RULES]
    for dim, (has, _) in _HAS.items():
        out += [(f"{dim} exists", dim, "exists", None, has, None), (f"{dim} not_exists", dim, "not_exists", None, f"not ({has})", None)]
    return [*out, ("colour equals red", "colour", "equals", ["red"], "error", None), ("closed in x", "closed", "in", ["x"], "error", None), ("segment equals", "segment", "equals", None, "error", None), ("segment like", "segment", "like", ["x"], "error", None), ("segment exists x", "segment", "exists", ["x"], "error", None)]


def pr_operators(s, d):
    """Every operator on every kind of dimension for every customer, the rule without nodes, a group without children, and requests without context."""
    leaves = [(name, 0, None, 0, "leaf", dim, op, v) for name, dim, op, v, _, _ in _operator_rules()] + [("no children", 0, None, 0, "anyOf", None, None, None)]
    nodes = s.createDataFrame(leaves, "rule_id string, node_id int, parent_id int, level int, kind string, dim_key string, op string, operands array<string>")
    dims = s.createDataFrame(_OPERATOR_DIMS, "dim_key string, value_type string, cardinality string, missing string, allowed array<string>, required boolean, trust string")
    c = M.table(s, d, "customer")
    rich = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("request_id"), F.lit("rich").alias("dim_key"), F.when(F.col("c_acctbal") > 5000, "true").otherwise("false").alias("value"), F.lit(None).cast("double").alias("num"))
    values, closure = registry(s, d)
    silent = customers(s, d).where("request_id % 50 = 0").select((-F.col("request_id") - 1).alias("request_id"))
    every = nodes.select("rule_id").unionByName(s.createDataFrame([("{}",)], "rule_id string"))
    out = rules.evaluate(contexts(s, d).unionByName(rich), nodes, dims, values, closure, requests=customers(s, d).unionByName(silent), rules=every)
    return out.select("request_id", "rule_id", _named().alias("state"), "spec_a", "spec_b", "err")


def _operators_sql() -> str:
    parts = []
    for name, dim, op, _, match, depth in _operator_rules():
        if match == "error":
            st, err = "0", "1"
        elif depth is None:
            st, err = f"case when {match} then 2 else 0 end", "0"
        else:
            has, missing = _HAS[dim]
            st, err = f"case when not ({has}) then {missing} when {match or 'false'} then 2 else 0 end", "0" if match else f"case when {has} then 1 else 0 end"
        positive = op in rules.POSITIVE and depth is not None
        parts.append(f"select k, '{name}' as rule_id, {st} as st, {1 if positive else 0} as a, {depth if positive else 0} as b, {err} as err from who")
    parts += ["select k, '{}', 2, 0, 0, 0 from who", "select k, 'no children', 0, 0, 0, 1 from who"]
    return f"""with {_CTX},
who as (select request_id as k, ctx.* from ctx union all select -request_id - 1, null, null, null, null, null, null, null from ctx where request_id % 50 = 0),
x as ({' union all '.join(parts)})
select k as request_id, rule_id, (['false', 'unknown', 'true', 'true'])[st + 1] as state, cast(case when st = 2 then a else 0 end as int) as spec_a, cast(case when st = 2 then b else 0 end as int) as spec_b, cast(err as int) as err from x"""


def pr_lifecycle(s, d):
    """Chunks that each request may see: they and their items are published, or drafts where it asks for them."""
    r = M.requests(s, d).select("request_id", F.when(F.col("include_draft"), F.array(F.lit("published"), F.lit("draft"))).otherwise(F.array(F.lit("published"))).alias("allowed"))
    wanted = r.select("request_id", "allowed", F.explode("allowed").alias("status"))
    own = F.when(F.col("item_id") % 11 == 5, "deprecated").when((F.col("item_id") % 11 == 7) & (F.col("ordinal") > 0), "draft").otherwise(F.col("status"))
    kinds = M.chunks(s, d).select(own.alias("status"), F.col("status").alias("item_status"), "token_count").groupBy("status", "item_status").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    seen = wanted.join(kinds, "status").where(F.array_contains("allowed", F.col("item_status")))
    return seen.groupBy("request_id").agg(F.sum("n").alias("n_chunks"), F.sum("tokens").alias("tokens"))


def pr_effective_window(s, d):
    """Items are counted by window first: there are few different ones, and only those meet the times that requests name."""
    r = M.requests(s, d).select("request_id", "as_of")
    w = M.items(s, d).where("effective_from IS NOT NULL OR effective_to IS NOT NULL").groupBy("effective_from", "effective_to").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    within = (F.col("effective_from").isNull() | (F.col("effective_from") <= F.col("as_of"))) & (F.col("effective_to").isNull() | (F.col("as_of") < F.col("effective_to")))
    times = w.join(r.select("as_of").distinct(), within).groupBy("as_of").agg(F.sum("n").alias("n_items"), F.min("first").alias("first_item"))
    return r.join(times, "as_of").select("request_id", "n_items", "first_item")


def pr_hard_filters(s, d):
    """The nearest chunks of every request, confined to the items, concepts and domains that it names."""
    from sparkwell.catalog import retrieval as Q
    from sparkwell.plans import retrieve

    return retrieve.restrict(Q.tk_vector(s, d), Q._filters(s, d), Q._members(s, d)).select("request_id", "chunk_id", "rank")


QUERIES = {f.__name__: f for f in (pr_rules, pr_authorize, pr_simulate, pr_rule_dimensions, src_dim_registry, pr_context_validate, pr_operators, pr_lifecycle, pr_effective_window, pr_hard_filters)}

_CTX = """ctx as (
  select c_custkey as request_id, c_mktsegment as segment, c_acctbal as acctbal, n_name as nation, r_name as region, prios, first_order
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  left join (select o_custkey, list(distinct o_orderpriority) as prios, strftime(min(o_orderdate), '%Y-%m-%d') as first_order from orders group by 1) on o_custkey = c_custkey)"""
_EVAL = f"""{_CTX},
rule as (
  select p_brand || '/' || p_type as rule_id, min(p_partkey) as n, min(p_retailprice) as price from part group by p_brand, p_type),
leaf as (
  select request_id, rule_id, n,
    case when (case when n % 3 = 0 then nation = 'NATION_' || (n % 25)::varchar else region = (['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'])[n % 5 + 1] end) then 2 else 0 end as s1,
    case when n % 3 = 0 then 1 else 0 end as d1,
    case when acctbal >= round(price) * 5 - 2000 then 2 else 0 end as s2,
    case when segment = (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[n % 5 + 1] then 2 else 0 end as s3,
    case when n % 2 = 1 or prios is null then null when list_has_any(prios, ['1-URGENT', '5-LOW']) then 2 else 0 end as s4,
    case when first_order is null then 1 when first_order < '1997-' || lpad((n % 12 + 1)::varchar, 2, '0') || '-01' then 2 else 0 end as s5
  from ctx, rule),
ev as (
  select request_id, rule_id, n, s1, d1, greatest(s2, s3) as s23, least(s1, greatest(s2, s3), 2 - greatest(coalesce(s4, 0), s5)) as st from leaf),
done as (
  select request_id, rule_id, n, (['false', 'unknown', 'true'])[st + 1] as state,
    cast(case when st = 2 then 2 else 0 end as int) as spec_a, cast(case when st = 2 then d1 else 0 end as int) as spec_b, cast(0 as int) as err, st = 2 and n % 2 = 1 as allowed from ev)"""

SQL = {
    "pr_rules": f"with {_EVAL} select request_id, rule_id, state, spec_a, spec_b, err from done",
    "pr_authorize": f"with {_EVAL} select request_id, rule_id from done where allowed",
    "pr_simulate": f"with {_EVAL} select request_id, rule_id, state, allowed, case when n % 2 = 0 then 'UNSAFE_AUTHORIZATION_MISSING_BEHAVIOR' when state <> 'true' then 'AUTHORIZATION_NO_MATCH' else '' end as denial, state = 'true' as eligible, spec_a, spec_b, err from done",
    "pr_rule_dimensions": """with rule as (select p_brand || '/' || p_type as rule_id, min(p_partkey) as n from part group by p_brand, p_type),
u as (select rule_id, unnest(['nation', 'acctbal', 'segment', 'first_order']) as dim_key from rule union all select rule_id, 'priorities' from rule where n % 2 = 0)
select dim_key, count(*) as n_rules, string_agg(rule_id, ',' order by rule_id) as used_by from u group by dim_key""",
    "src_dim_registry": """select 'nation' as dim_key, r_name as value, 0 as depth, r_name as ancestors from region
union all select 'nation', n_name, 1, array_to_string(list_sort([n_name, r_name]), ',') from nation join region on n_regionkey = r_regionkey""",
    "pr_context_validate": """with m as (select c_custkey as request_id, c_custkey % 50 as r from customer)
select request_id, 'colour' as dim_key, 'UNKNOWN_CONTEXT_DIMENSION' as code from m where r = 7
union all select request_id, 'segment', 'REQUIRED_CONTEXT_DIMENSION_MISSING' from m where r = 11
union all select -request_id - 1, 'segment', 'REQUIRED_CONTEXT_DIMENSION_MISSING' from m where r = 0
union all select request_id, 'segment', 'CONTEXT_TYPE_MISMATCH' from m where r = 13
union all select request_id, 'priorities', 'INVALID_CONTEXT' from m where r = 17
union all select request_id, 'first_order', 'CONTEXT_TYPE_MISMATCH' from m where r in (19, 37)
union all select request_id, 'nation', 'CONTEXT_ENUM_VALUE_UNKNOWN' from m where r in (23, 41)
union all select request_id, 'clearance', 'CONTEXT_DIMENSION_NOT_CLIENT_SETTABLE' from m where r = 29
union all select request_id, 'acctbal', 'CONTEXT_TYPE_MISMATCH' from m where r = 43""",
    "pr_operators": _operators_sql(),
    "pr_lifecycle": f"""with {M.REQUESTS}, {M.CHUNKS}, c as (select *, case when item_id % 11 = 5 then 'deprecated' when item_id % 11 = 7 and ordinal > 0 then 'draft' else status end as own from chunks)
select request_id, count(*) as n_chunks, cast(sum(token_count) as bigint) as tokens from requests join c on (own = 'published' or (include_draft and own = 'draft')) and (status = 'published' or (include_draft and status = 'draft')) group by request_id""",
    "pr_effective_window": f"""with {M.REQUESTS}, {M.ITEMS}
select request_id, count(*) as n_items, min(item_id) as first_item from requests join items on (effective_from is null or effective_from <= as_of) and (effective_to is null or as_of < effective_to)
where effective_from is not null or effective_to is not null group by request_id""",
}
