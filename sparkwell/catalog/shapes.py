"""Join, aggregate, window, set and browse shapes over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwell.catalog import model as M
from sparkwell.catalog import retrieval as Q
from sparkwell.catalog import rules as R
from sparkwell.functions import text as T
from sparkwell.operators import channels, fusion, graph, inverted_lists, paging
from sparkwell.operators.cuts import written
from sparkwell.operators.similarity import trigram_join


def src_tables(s, d):
    return M.table(s, d, "part").where("p_brand = 'Brand#7'").select("p_partkey", "p_name", "p_type")


def jn_chunk_item(s, d):
    return M.chunks(s, d).select("chunk_id", "item_id").join(M.table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source"), "item_id")


def jn_edge_endpoints(s, d):
    c = M.concepts(s, d).where("status = 'published'").select("concept_id", "key")
    types = s.createDataFrame([("A", "associates"), ("N", "neighbours"), ("R", "requires")], "relation string, relation_name string")
    e = M.edges(s, d).join(F.broadcast(types), "relation")  # three rows; a shuffle by relation would have three tasks
    src = c.select(F.col("concept_id").alias("source"), F.col("key").alias("source_key"))
    tgt = c.select(F.col("concept_id").alias("target"), F.col("key").alias("target_key"))
    return e.join(src, "source").join(tgt, "target").select("edge_id", "source_key", "relation_name", "target_key")


def jn_alias_concept(s, d):
    c = M.concepts(s, d)
    return c.select("concept_id", "alias").join(c.select("concept_id", "key", "status"), "concept_id").where("status = 'published'").select("alias", "key")


def jn_link_entity(s, d):
    t = M.table(s, d, "conversations")
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"), F.count("*").alias("n"))


def jn_semi_concept(s, d):
    wanted = M.concepts(s, d).where("name LIKE 'red %'").select(F.col("concept_id").alias("l_partkey"))
    return M.table(s, d, "lineitem").join(wanted, "l_partkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def jn_semi_domain(s, d):
    c = M.concepts(s, d).where("domain = 'Brand#3'").select("concept_id")
    links = M.chunk_concepts(s, d).join(c, "concept_id", "left_semi")
    return M.chunks(s, d).join(links, "chunk_id", "left_semi").select("item_id").distinct()


def jn_left_state(s, d):
    """Orders as deployments of a customer's revisions; the latest is active."""
    o = M.table(s, d, "orders").select(F.col("o_custkey").alias("namespace"), F.col("o_orderkey").alias("revision"), "o_orderdate")
    state = o.groupBy("namespace").agg(F.max_by("revision", F.struct("o_orderdate", "revision")).alias("active_revision"))
    out = o.join(state, "namespace", "left").withColumn("active", F.col("revision") == F.col("active_revision"))
    w = Window.partitionBy("namespace").orderBy(F.desc("o_orderdate"), F.desc("revision"))
    return out.withColumn("n", F.row_number().over(w)).where("n <= 3").select("namespace", "revision", "active")


def jn_similarity(s, d):
    p = M.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    q = p.select(F.col("id").alias("query_id"), F.col("name").alias("query")).where("query_id % 20 = 0")
    return trigram_join(q, "query_id", "query", p, "id", "name", digits=9)


def jn_vector(s, d):
    e = M.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("request_id"), "vector")
    return channels.vector_channel(q, e, 5).select("request_id", F.col("chunk_id").alias("id"), "rank", "score")


def jn_vector_index(s, d):
    """As jn_vector, by inverted lists: approximate, so tested by its recall."""
    e = M.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("request_id"), "vector")
    index = inverted_lists.fit(e, 5)
    return inverted_lists.indexed_vector_channel(q, inverted_lists.file(e, index), index, 5).select("request_id", F.col("chunk_id").alias("id"), "rank", "score")


def jn_self_hierarchy(s, d):
    v = R.enum_values(s, d)
    top = v.where("parent IS NULL").select("value", F.col("value").alias("path"))
    below = v.where("parent IS NOT NULL").join(top.withColumnRenamed("value", "parent"), "parent").select("value", F.concat("path", F.lit(" > "), "value").alias("path"))
    return top.unionByName(below)


def jn_range_window(s, d):
    """Requests meet the items of their month; the window is tested within it."""
    r = M.requests(s, d).select("request_id", "as_of", F.trunc("as_of", "month").alias("month"))
    i = M.items(s, d).where("effective_from < effective_to").select("item_id", "effective_from", "effective_to")
    i = i.withColumn("month", F.explode(F.sequence(F.trunc("effective_from", "month"), F.trunc("effective_to", "month"), F.expr("interval 1 month"))))
    return i.join(r, "month").where("effective_from <= as_of AND as_of < effective_to").select("request_id", "item_id")


def ag_max_score(s, d):
    q = M.requests(s, d).select("request_id", F.col("text").alias("query"))
    c = M.chunks(s, d)
    names = c.select("chunk_id", F.col("title").alias("name")).unionByName(c.select("chunk_id", F.concat_ws(" ", "source", "part_key").alias("name")))
    return channels.trigram_channel(q, names, 20).select("request_id", "chunk_id", "score")


def ag_distinct(s, d):
    return M.table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()


def ag_total_count(s, d):
    return M.table(s, d, "part").where("p_type = 'SMALL'").agg(F.count("*").alias("total"))


def ag_percentiles(s, d):
    e = M.table(s, d, "events")
    cols = [F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.count("*").alias("n")]
    return e.groupBy(F.col("event_type").alias("stage")).agg(*cols).unionByName(e.agg(*cols).select(F.lit("total").alias("stage"), "p50", "p95", "n"))


def ag_metric_counts(s, d):
    e = M.table(s, d, "events")
    return e.groupBy("event_type", (F.col("user_id") % 3).alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(name) for name, q in (("p50", 0.5), ("p95", 0.95))])


def wn_selection_group(s, d):
    p = M.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 3).alias("spec_a"), (F.col("p_partkey") % 5).alias("spec_b"))
    k = F.regexp_extract("grp", r"(\d+)", 1).cast("int") % 3
    mode = F.when(k == 0, "all").when(k == 1, "most_specific").otherwise("highest_priority")
    return p.withColumn("chosen", fusion.group_winner("grp", mode, "id")).where("chosen").select("id", "grp")


def wn_final_order(s, d):
    return Q.qp_rankings(s, d).select("request_id", "chunk_id", "final_rank")


def wn_pack(s, d):
    """All chunks of a source as candidates of a request by id, with tight budgets."""
    c = M.chunks(s, d).select(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("request_id"), "chunk_id", (F.col("item_id") % 7).alias("item_id"), "token_count")
    return fusion.pack_long(c, 10, 5000, 3, "chunk_id").select("request_id", "chunk_id", "outcome")


def wn_keyset_page(s, d):
    return paging.keyset_page(M.table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", 500, 50)


def wn_rank_candidates(s, d):
    v = Q._concept_semantic(s, d)
    c = M.concepts(s, d).select("concept_id", "priority")
    r = M.requests(s, d).select("request_id")
    links = r.withColumn("concept_id", F.explode(F.array((F.col("request_id") * 3).cast("long"), (F.col("request_id") * 5 + 1).cast("long")))).distinct()
    both = v.join(links, ["request_id", "concept_id"], "full_outer").join(c, "concept_id")
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("score"), F.desc("priority"), "concept_id")
    return both.select("request_id", "concept_id", "score", F.row_number().over(w).alias("rank"))


def wn_fragment_order(s, d):
    w = Window.partitionBy("conv_id").orderBy("role", F.desc("turn"), "text")
    return M.table(s, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("place"))


def st_id_union(s, d):
    lines = M.table(s, d, "lineitem")
    return lines.where("l_quantity = 1").select("l_partkey").union(lines.where("l_quantity = 50").select("l_partkey")).distinct()


def st_except(s, d):
    p = M.table(s, d, "part").select("p_partkey")
    return p.exceptAll(M.table(s, d, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("p_partkey")).distinct())


def st_intersect(s, d):
    lines = M.table(s, d, "lineitem")
    return lines.where("l_returnflag = 'A' AND l_quantity < 3").select("l_partkey").intersect(lines.where("l_returnflag = 'R' AND l_quantity < 3").select("l_partkey"))


def gr_closure(s, d):
    return graph.closure(R.enum_values(s, d), "value", "parent")


def gr_topo_depth(s, d):
    return gr_closure(s, d).groupBy(F.col("descendant").alias("value")).agg(F.max("depth").alias("depth"))


def gr_neighbourhood(s, d):
    """Around every twentieth part: one or two hops (some ask for three, an error) in its direction, over its relations, into its domain; what was found, by kind."""
    i = F.col("p_partkey")
    k = F.expr("p_partkey div 20")
    c = M.table(s, d, "part").where("p_partkey % 20 = 0").select(
        i.alias("request_id"), i.alias("node"), F.when(i % 300 == 0, 3).otherwise(k % 2 + 1).cast("int").alias("depth"),
        F.when(k % 3 == 0, "outgoing").when(k % 3 == 1, "incoming").otherwise("both").alias("direction"), F.when(k % 5 == 0, F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("domain"),
    )
    only = c.where("depth = 2").select("request_id", F.explode(F.array(F.lit("A"), F.lit("R"))).alias("relation"))
    found = graph.neighbourhood(c, only, M.edges(s, d), M.concepts(s, d).select(F.col("concept_id").alias("node"), "domain"), M.chunk_concepts(s, d).select(F.col("concept_id").alias("node"), "chunk_id"))
    told = lambda name, first: found[name].groupBy("request_id").agg(F.count("*").alias("n"), F.min(first).alias("first")).withColumn("kind", F.lit(name))
    out = told("concepts", F.col("node") * 10 + F.col("hops")).unionByName(told("edges", F.col("source") * 100000 + F.col("target"))).unionByName(told("chunks", F.col("chunk_id")))
    return out.unionByName(found["errors"].select("request_id", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("first"), F.col("code").alias("kind"))).select("request_id", "kind", "n", "first")


def _dag(s, d):
    return graph.cut(M.tool_edges(s, d))


def _origins(s, d):
    """Every twentieth part as a query of its own."""
    return M.table(s, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))


def gr_reachable(s, d):
    return graph.reachable(_origins(s, d), _dag(s, d), ["origin"])


def gr_dependents(s, d):
    back = _dag(s, d).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.reachable(_origins(s, d), back, ["origin"])


def _turned(s, d):
    """All dependencies, optional ones too, and beside one of every hundredth part one that turns it back."""
    e = graph.cut(_dag(s, d).select("source", "target"))
    back = e.where("source % 100 = 7").groupBy("source").agg(F.min("target").alias("target"))
    return e.unionByName(back.select(F.col("target").alias("source"), F.col("source").alias("target")))


def gr_cycle_paths(s, d):
    return graph.cycle_paths(_turned(s, d)).select("component", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def gr_cycles(s, d):
    return graph.cycles(_turned(s, d))


def br_list(s, d):
    c = M.concepts(s, d).where("status = 'published' AND domain IN ('Brand#2', 'Brand#4') AND contains(lower(name), 'bolt')")
    page = paging.keyset_page(c.select("concept_id", "key"), "concept_id", -1, 10)
    return page.join(c.agg(F.count("*").alias("total")))


def _entities(s, d):
    """Everything that can be browsed: (kind, id, key, parent, status)."""
    def kind(df, name, id_col, key, parent=None, status=None):
        return df.select(F.lit(name).alias("kind"), F.col(id_col).cast("long").alias("id"), key.alias("key"), (parent if parent is not None else F.lit(None)).cast("long").alias("parent"), (status if status is not None else F.lit("published")).alias("status"))

    c = M.concepts(s, d)
    number = F.regexp_extract("domain", r"(\d+)", 1).cast("long")
    t = M.table(s, d, "conversations")
    out = kind(c, "concept", "concept_id", F.col("key"), status=F.col("status"))
    out = out.unionByName(kind(c.select("domain").distinct().withColumn("n", number), "domain", "n", F.col("domain")))
    out = out.unionByName(kind(M.items(s, d), "item", "item_id", F.concat_ws("/", "source", F.col("item_id").cast("string")), status=F.col("status")))
    out = out.unionByName(kind(M.chunks(s, d), "chunk", "chunk_id", F.col("part_key"), F.col("item_id"), F.col("status")))
    out = out.unionByName(kind(M.table(s, d, "part"), "tool", "p_partkey", F.concat(F.lit("tool-"), F.col("p_partkey").cast("string"))))
    out = out.unionByName(kind(M.table(s, d, "part").select(F.expr("p_partkey div 4").alias("n")).distinct(), "skill", "n", F.concat(F.lit("skill-"), F.col("n").cast("string"))))
    return out.unionByName(kind(t.groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("n")).agg(F.min("role").alias("role")), "fragment", "n", F.concat_ws("-", "role", F.col("n").cast("string"))))


def br_list_kinds(s, d):
    """The first twenty published ones of every kind whose key holds a 1, with totals."""
    e = _entities(s, d).where((F.col("status") == "published") & T.contains_any(F.lit("1"), F.col("key")))
    return paging.page_per_kind(e, 20).select("kind", "id", "key", "place", "total", "has_next_page")


def br_list_all(s, d):
    """Dimensions, groups, domains, profiles and templates (one for each role of a turn) by key."""
    dims = R.dimensions(s).select(F.lit("dimension").alias("kind"), F.col("dim_key").alias("key"), F.col("value_type").alias("detail"))
    groups = Q._modes(s, d).select(F.lit("group").alias("kind"), F.col("selection_group").alias("key"), F.col("mode").alias("detail"))
    domains = M.concepts(s, d).groupBy(F.col("domain").alias("key")).agg(F.count("*").cast("string").alias("detail")).select(F.lit("domain").alias("kind"), "key", "detail")
    w = Window.partitionBy("kind").orderBy("key")
    profiles = Q._profiles(s, d).select(F.lit("profile").alias("kind"), F.col("profile").alias("key"), F.when(F.col("is_default"), "default").otherwise("").alias("detail"))
    templates = M.table(s, d, "conversations").groupBy("role").agg(F.count("*").cast("string").alias("detail")).select(F.lit("template").alias("kind"), F.concat(F.lit("template-"), "role").alias("key"), "detail")
    return dims.unionByName(groups).unionByName(domains).unionByName(profiles).unionByName(templates).select("kind", "key", "detail", F.row_number().over(w).alias("place"))


def br_get(s, d):
    """Concepts, items and chunks by id or by key (a chunk's within its item), some that are not there, some asked by both or neither."""
    r = M.requests(s, d)
    i, none, text = F.col("request_id"), F.lit(None).cast("long"), F.lit(None).cast("string")
    asks = [("concept", none, F.col("concept_text"), none), ("concept", i * 3, text, none), ("item", i * 40, text, none), ("chunk", none, F.lit("part-02"), i * 7), ("chunk", none, F.lit(""), i * 7), ("tool", i, F.lit("tool-1"), none), ("skill", none, text, none)]
    asked = r.select(i, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("id"), b.alias("key"), p.alias("parent")) for k, a, b, p in asks])).alias("x")).select("request_id", "x.*")
    return paging.lookup(asked, _entities(s, d).select("kind", "id", "key", "parent")).select("request_id", "kind", F.coalesce("found", F.lit(-1)).alias("found"), F.coalesce("code", F.lit("")).alias("code"))


def _link(df, parent_kind, parent, child_kind, child, place):
    text = lambda c: c.cast("string")
    return df.select(F.lit(parent_kind).alias("parent_kind"), text(parent).alias("parent"), F.lit(child_kind).alias("child_kind"), text(child).alias("child"), place.cast("long").alias("place"))


def br_children(s, d):
    """Aliases and relations of concepts, chunks of items, values of dimensions, members of groups, steps of skills."""
    # edges are read from both ends; written, they are put together once, and no task holds them while it sorts links
    c, e, zero = M.concepts(s, d), written(M.edges(s, d).select("source", "target", "relation")), F.lit(0)
    col = F.col
    out = _link(c, "concept", col("concept_id"), "alias", col("alias"), zero)
    out = out.unionByName(_link(e, "concept", col("source"), "relation_out", F.concat_ws(":", "relation", "target"), zero)).unionByName(_link(e, "concept", col("target"), "relation_in", F.concat_ws(":", "relation", "source"), zero))
    out = out.unionByName(_link(M.chunks(s, d), "item", col("item_id"), "chunk", col("chunk_id"), col("ordinal")))
    out = out.unionByName(_link(R.enum_values(s, d), "dimension", col("dim_key"), "value", col("value"), zero))
    out = out.unionByName(_link(M.items(s, d).where("selection_group IS NOT NULL"), "group", col("selection_group"), "item", col("item_id"), col("item_id")))
    return paging.children(out.unionByName(_link(M.table(s, d, "part"), "skill", F.expr("p_partkey div 4"), "tool", col("p_partkey"), col("p_partkey"))))


def br_backlinks(s, d):
    """Who uses an entity: tools each other and skills them, chunks concepts, templates and skills fragments, rules dimensions."""
    def use(df, kind, id_, by_kind, by):
        return df.select(F.lit(kind).alias("kind"), id_.cast("string").alias("id"), F.lit(by_kind).alias("used_by_kind"), by.cast("string").alias("used_by"))

    col = F.col
    turns = M.table(s, d, "conversations").select((col("conv_id") * 1000 + col("turn")).alias("fragment"), "conv_id", "turn", "role")
    out = use(M.tool_edges(s, d), "tool", col("target"), "tool", col("source"))
    out = out.unionByName(use(M.table(s, d, "part").where("p_partkey % 4 >= 2"), "tool", col("p_partkey"), "skill", F.expr("p_partkey div 4")))
    out = out.unionByName(use(M.chunk_concepts(s, d), "concept", col("concept_id"), "chunk", col("chunk_id")))
    out = out.unionByName(use(turns.where("turn % 2 = 0"), "fragment", col("fragment"), "template", col("conv_id"))).unionByName(use(turns.where("role = 'assistant'"), "fragment", col("fragment"), "skill", col("turn") % 2))
    return paging.backlinks(out.unionByName(use(R.nodes(s, d).where("kind = 'leaf'"), "dimension", col("dim_key"), "rule", col("rule_id"))))


def br_list_items(s, d):
    """The first twenty published items of groups that are in use, with a chunk about some concept of four brands, and how many there are."""
    wanted = M.concepts(s, d).where("domain IN ('Brand#2', 'Brand#4', 'Brand#6', 'Brand#8')").select("concept_id")
    about = M.chunk_concepts(s, d).join(wanted, "concept_id", "left_semi").join(M.chunks(s, d).select("chunk_id", "item_id"), "chunk_id").select("item_id").distinct()
    found = M.items(s, d).where("status = 'published' AND selection_group IS NOT NULL").join(about, "item_id", "left_semi").select("item_id", "selection_group")
    return paging.keyset_page(found, "item_id", -1, 20).join(found.agg(F.count("*").alias("total")))


QUERIES = {f.__name__: f for f in (src_tables, jn_chunk_item, jn_edge_endpoints, jn_alias_concept, jn_link_entity, jn_semi_concept, jn_semi_domain, jn_left_state, jn_similarity, jn_vector, jn_vector_index, jn_self_hierarchy, jn_range_window, ag_max_score, ag_distinct, ag_total_count, ag_percentiles, ag_metric_counts, wn_selection_group, wn_final_order, wn_pack, wn_keyset_page, wn_rank_candidates, wn_fragment_order, st_id_union, st_except, st_intersect, gr_closure, gr_topo_depth, gr_neighbourhood, gr_reachable, gr_dependents, gr_cycles, gr_cycle_paths, br_list, br_list_items, br_list_kinds, br_list_all, br_get, br_children, br_backlinks)}

_HIER = "v as (select r_name as value, null::varchar as parent from region union all select n_name, r_name from nation join region on n_regionkey = r_regionkey)"
_NEAR = f"""{M.EDGES}, {M.CHUNKS}, {M.CONCEPTS}, {M.CHUNK_CONCEPTS},
c as (
  select p_partkey as q, case when p_partkey % 300 = 0 then 3 else (p_partkey // 20) % 2 + 1 end as depth, (p_partkey // 20) % 3 as way,
    case when (p_partkey // 20) % 5 = 0 then 'Brand#' || cast((p_partkey // 20) % 25 + 1 as varchar) end as dom from part where p_partkey % 20 = 0),
w0 as (select q, q as node, depth, way, dom from c where depth in (1, 2)),
e1 as (
  select q, source, relation, target, target as nx from w0 join edges on source = node and (depth = 1 or relation in ('A', 'R')) where way <> 1
  union select q, source, relation, target, source from w0 join edges on target = node and (depth = 1 or relation in ('A', 'R')) where way <> 0),
n1 as (select distinct q, nx as node from e1 where nx <> q),
w1 as (select n1.q, n1.node, way from n1 join w0 using (q) where depth = 2),
e2 as (
  select q, source, relation, target, target as nx from w1 join edges on source = node and relation in ('A', 'R') where way <> 1
  union select q, source, relation, target, source from w1 join edges on target = node and relation in ('A', 'R') where way <> 0),
n2 as (select distinct q, nx as node from e2 where nx <> q and (q, nx) not in (select (q, node) from n1)),
nb as (
  select x.q, x.node, hops from (select q, node, 1 as hops from n1 union all select q, node, 2 from n2) x join w0 z on z.q = x.q
  join concepts on concept_id = x.node where z.dom is null or domain = z.dom),
vis as (select q, node from nb union select q, q from w0),
ed as (select distinct q, source, relation, target from (select * from e1 union all select * from e2) where (q, source) in (select (q, node) from vis) and (q, target) in (select (q, node) from vis)),
ch as (select distinct q, chunk_id from vis join chunk_concepts on concept_id = node)"""

_ENTITIES = """entities as (
  select 'concept' as kind, concept_id as id, key, null::bigint as parent, status from concepts
  union all select distinct 'domain', cast(regexp_extract(domain, '([0-9]+)', 1) as bigint), domain, null::bigint, 'published' from concepts
  union all select 'item', item_id, source || '/' || cast(item_id as varchar), null, status from items
  union all select 'chunk', chunk_id, part_key, item_id, status from chunks
  union all select 'tool', p_partkey, 'tool-' || cast(p_partkey as varchar), null, 'published' from part
  union all select distinct 'skill', p_partkey // 4, 'skill-' || cast(p_partkey // 4 as varchar), null::bigint, 'published' from part
  union all select 'fragment', conv_id * 1000 + turn, min(role) || '-' || cast(conv_id * 1000 + turn as varchar), null, 'published' from conversations group by conv_id * 1000 + turn)"""

SQL = {
    "src_tables": "select p_partkey, p_name, p_type from part where p_brand = 'Brand#7'",
    "jn_chunk_item": f"with {M.CHUNKS} select chunk_id, item_id, d.lang, d.source from chunks join documents d on d.doc_id = item_id",
    "jn_edge_endpoints": f"""with {M.EDGES}, {M.CONCEPTS}, t(relation, relation_name) as (values ('A', 'associates'), ('N', 'neighbours'), ('R', 'requires'))
select edge_id, a.key as source_key, relation_name, b.key as target_key from edges join t using (relation) join concepts a on a.concept_id = source and a.status = 'published' join concepts b on b.concept_id = target and b.status = 'published'""",
    "jn_alias_concept": f"with {M.CONCEPTS} select alias, key from concepts where status = 'published'",
    "jn_link_entity": "select conv_id, string_agg(role, ',' order by turn, role) as roles, count(*) as n from conversations group by conv_id",
    "jn_semi_concept": "select l_returnflag, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_name like 'red %') group by 1",
    "jn_semi_domain": f"with {M.CHUNKS}, {M.CHUNK_CONCEPTS} select distinct item_id from chunks where chunk_id in (select chunk_id from chunk_concepts join part on p_partkey = concept_id where p_brand = 'Brand#3')",
    "jn_left_state": """select o_custkey as namespace, o_orderkey as revision, row_number() over w = 1 as active from orders window w as (partition by o_custkey order by o_orderdate desc, o_orderkey desc) qualify row_number() over w <= 3""",
    "jn_similarity": f"""with p as (select p_partkey as id, p_name as name, {Q._grams('p_name')} as g from part)
select q.id as query_id, p.id, round(len(list_intersect(q.g, p.g)) / len(list_distinct(list_concat(q.g, p.g))), 9) as score from p q, p where q.id % 20 = 0 and len(list_intersect(q.g, p.g)) / len(list_distinct(list_concat(q.g, p.g))) > 0.3""",
    "jn_vector": """with s as (select q.vec_id as request_id, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as score from embeddings q, embeddings v where q.vec_id % 20 = 0)
select request_id, id, cast(row_number() over (partition by request_id order by score desc, id) as int) as rank, score from s qualify rank <= 5""",
    "jn_self_hierarchy": f"with {_HIER} select value, case when parent is null then value else parent || ' > ' || value end as path from v",
    "jn_range_window": f"with {M.REQUESTS}, {M.ITEMS} select request_id, item_id from requests join items on effective_from <= as_of and as_of < effective_to",
    "ag_max_score": f"""with {M.REQUESTS}, {M.CHUNKS}, tq as (select request_id, {Q._grams('text')} as a from requests),
nm as (select chunk_id, title as name from chunks union all select chunk_id, concat_ws(' ', source, part_key) from chunks),
g as (select name, {Q._grams('name')} as b from (select distinct name from nm)),
sim as (select request_id, name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as score from tq, g where len(b) > 0),
h as (select request_id, chunk_id, round(max(score), 9) as score from sim join nm using (name) where score > 0.3 group by 1, 2)
select request_id, chunk_id, score from h qualify row_number() over (partition by request_id order by score desc, chunk_id) <= 20""",
    "ag_distinct": "select distinct l_orderkey, l_partkey from lineitem",
    "ag_total_count": "select count(*) as total from part where p_type = 'SMALL'",
    "ag_percentiles": """select event_type as stage, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, count(*) as n from events group by 1
union all select 'total', quantile_disc(value, 0.5), quantile_disc(value, 0.95), count(*) from events""",
    "ag_metric_counts": "select event_type, user_id % 3 as outcome, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1, 2",
    "wn_selection_group": """with p as (select p_partkey as id, p_brand as grp, p_size as priority, p_partkey % 3 as a, p_partkey % 5 as b, cast(regexp_extract(p_brand, '(\\d+)', 1) as int) % 3 as k from part)
select id, grp from p qualify case k when 0 then true when 1 then row_number() over (partition by grp order by a desc, b desc, priority desc, id) = 1 else row_number() over (partition by grp order by priority desc, a desc, b desc, id) = 1 end""",
    "wn_final_order": f"with recursive {Q._DONE} select request_id, chunk_id, final_rank from finished where final_rank is not null",
    "wn_pack": f"""with recursive {M.CHUNKS},
c as (select cast(regexp_extract(source, '(\\d+)', 1) as bigint) as request_id, chunk_id, item_id % 7 as item_id, token_count, row_number() over (partition by source order by chunk_id) as r from chunks),
f as (
  select request_id, 0::bigint as i, 0::bigint as n, 0::bigint as used, cast([] as bigint[]) as took, null::bigint as chunk_id, null::varchar as outcome from (select distinct request_id from c)
  union all
  select request_id, i + 1, n + case when o = 'PACKED' then 1 else 0 end, used + case when o = 'PACKED' then token_count else 0 end, case when o = 'PACKED' then list_append(took, item_id) else took end, cid, o
  from (select f.*, c.item_id, c.token_count, c.chunk_id as cid, case when n >= 10 then 'TOKEN_BUDGET' when len(list_filter(took, lambda z: z = c.item_id)) >= 3 then 'ITEM_CAP' when used + token_count > 5000 then 'TOKEN_BUDGET' else 'PACKED' end as o
    from f join c on c.request_id = f.request_id and c.r = f.i + 1))
select request_id, chunk_id, outcome from f where i > 0""",
    "wn_keyset_page": """with p as (select p_partkey, p_name from part where p_partkey > 500 order by p_partkey limit 51)
select p_partkey, p_name, to_base64(encode('cursor:' || cast(p_partkey as varchar))) as cursor, (select count(*) from p) > 50 as has_next_page from (select * from p order by p_partkey limit 50)""",
    "wn_rank_candidates": f"""with {M.REQUESTS}, {Q._RESOLVE},
v as (select request_id, concept_id, score from sem qualify row_number() over (partition by request_id order by score desc, concept_id) <= 10),
l as (select distinct request_id, unnest([request_id * 3, request_id * 5 + 1]) as concept_id from requests)
select request_id, concept_id, score, cast(row_number() over (partition by request_id order by score desc nulls last, priority desc, concept_id) as int) as rank
from (select * from v full join l using (request_id, concept_id)) join concepts using (concept_id)""",
    "wn_fragment_order": "select conv_id, turn, cast(row_number() over (partition by conv_id order by role, turn desc, text) as int) as place from conversations",
    "st_id_union": "select l_partkey from lineitem where l_quantity = 1 union select l_partkey from lineitem where l_quantity = 50",
    "st_except": "select p_partkey from part except select l_partkey from lineitem where l_quantity < 5",
    "st_intersect": "select l_partkey from lineitem where l_returnflag = 'A' and l_quantity < 3 intersect select l_partkey from lineitem where l_returnflag = 'R' and l_quantity < 3",
    "gr_closure": f"with {_HIER} select value as ancestor, value as descendant, cast(0 as int) as depth from v union all select parent, value, 1 from v where parent is not null",
    "gr_topo_depth": f"with {_HIER} select value, cast(case when parent is null then 0 else 1 end as int) as depth from v",
    "gr_neighbourhood": f"""with {_NEAR} select q as request_id, 'concepts' as kind, count(*) as n, min(node * 10 + hops) as first from nb group by q
union all select q, 'edges', count(*), min(source * 100000 + target) from ed group by q union all select q, 'chunks', count(*), min(chunk_id) from ch group by q
union all select q, 'INVALID_INPUT', 1, 0 from c where depth = 3""",
    "gr_reachable": f"with recursive {M.TOOL_EDGES}, r as (select p_partkey as origin, p_partkey as node from part where p_partkey % 20 = 0 union select origin, target from r join tool_edges on source = node) select origin, node from r",
    "gr_dependents": f"with recursive {M.TOOL_EDGES}, r as (select p_partkey as origin, p_partkey as node from part where p_partkey % 20 = 0 union select origin, source from r join tool_edges on target = node) select origin, node from r",
    # every cycle uses a turned edge, so a node lies on one when its start is reached from the node and the node from its end
    "gr_cycles": f"""with recursive {M.TOOL_EDGES}, must as (select source, target from tool_edges),
turned as (select min(target) as source, source as target from must where source % 100 = 7 group by source),
e as (select source, target from must union all select source, target from turned),
fw as (select target as k, target as node from turned union select k, e.target from fw join e on fw.node = e.source),
bw as (select target as k, source as node from turned union select k, e.source from bw join e on bw.node = e.target)
select distinct fw.node from fw join bw on fw.k = bw.k and fw.node = bw.node""",
    "br_list": f"""with {M.CONCEPTS}, c as (select concept_id, key from concepts where status = 'published' and domain in ('Brand#2', 'Brand#4') and contains(lower(name), 'bolt')), p as (select * from c order by concept_id limit 11)
select concept_id, key, to_base64(encode('cursor:' || cast(concept_id as varchar))) as cursor, (select count(*) from p) > 10 as has_next_page, (select count(*) from c) as total from (select * from p order by concept_id limit 10)""",
    "br_list_kinds": f"""with {M.CHUNKS}, {M.CONCEPTS}, {_ENTITIES}, e as (select * from entities where status = 'published' and contains(key, '1'))
select kind, id, key, cast(row_number() over w as int) as place, count(*) over (partition by kind) as total, count(*) over (partition by kind) > 20 as has_next_page from e window w as (partition by kind order by id, key) qualify row_number() over w <= 20""",
    "br_list_all": f"""with {M.ITEMS}, {M.CONCEPTS}, a as (
  select 'dimension' as kind, dim_key as key, value_type as detail from (values {", ".join(f"('{x[0]}', '{x[1]}')" for x in R.DIMENSIONS)}) t(dim_key, value_type)
  union all select 'group', g, case cast(split_part(g, '-', -1) as int) % 24 when 8 then 'all' when 16 then 'most_specific' else 'highest_priority' end from (select distinct selection_group as g from items where selection_group is not null)
  union all select 'domain', domain, cast(count(*) as varchar) from concepts group by domain
  union all select 'profile', k, v from (values ('wide', ''), ('tight', ''), ('base', 'default')) t(k, v)
  union all select 'template', 'template-' || role, cast(count(*) as varchar) from conversations group by role)
select kind, key, detail, cast(row_number() over (partition by kind order by key) as int) as place from a""",
    "br_get": f"""with {M.REQUESTS}, {M.CHUNKS}, {_ENTITIES},
a as (select request_id, 'concept' as kind, null::bigint as id, concept_text as key, null::bigint as parent from requests union all select request_id, 'concept', request_id * 3, null, null from requests
  union all select request_id, 'item', request_id * 40, null, null from requests union all select request_id, 'chunk', null, 'part-02', request_id * 7 from requests union all select request_id, 'chunk', null, '', request_id * 7 from requests
  union all select request_id, 'tool', request_id, 'tool-1', null from requests union all select request_id, 'skill', null, null, null from requests),
f as (select a.*, (select min(e.id) from entities e where e.kind = a.kind and e.id = a.id) as by_id, (select min(e.id) from entities e where e.kind = a.kind and e.key = a.key and e.parent is not distinct from a.parent) as by_key from a)
select request_id, kind, coalesce(case when (id is null) = (key is null) then null when id is not null then by_id else by_key end, -1) as found,
  case when (id is null) = (key is null) then 'INVALID_INPUT' when coalesce(by_id, by_key) is null then 'ENTITY_NOT_FOUND' else '' end as code from f""",
    "br_children": f"""with {M.EDGES}, {M.CHUNKS}, {M.CONCEPTS}, {_HIER}, l as (
  select 'concept' as parent_kind, cast(concept_id as varchar) as parent, 'alias' as child_kind, alias as child, 0 as place from concepts
  union all select 'concept', cast(source as varchar), 'relation_out', relation || ':' || cast(target as varchar), 0 from edges
  union all select 'concept', cast(target as varchar), 'relation_in', relation || ':' || cast(source as varchar), 0 from edges
  union all select 'item', cast(item_id as varchar), 'chunk', cast(chunk_id as varchar), ordinal from chunks
  union all select 'dimension', 'nation', 'value', value, 0 from v
  union all select 'group', selection_group, 'item', cast(item_id as varchar), item_id from items where selection_group is not null
  union all select 'skill', cast(p_partkey // 4 as varchar), 'tool', cast(p_partkey as varchar), p_partkey from part)
select parent_kind, parent, child_kind, count(*) as n, (array_agg(child order by place, child))[1] as first, (array_agg(child order by place desc, child desc))[1] as last from l group by 1, 2, 3""",
    "br_backlinks": f"""with {M.TOOL_EDGES}, {M.CHUNKS}, {M.CHUNK_CONCEPTS}, r as (select p_brand || '/' || p_type as rule, min(p_partkey) as n from part group by p_brand, p_type), b as (
  select 'tool' as kind, cast(target as varchar) as id, 'tool' as used_by_kind, cast(source as varchar) as used_by from tool_edges
  union select 'tool', cast(p_partkey as varchar), 'skill', cast(p_partkey // 4 as varchar) from part where p_partkey % 4 >= 2
  union select 'concept', cast(concept_id as varchar), 'chunk', cast(chunk_id as varchar) from chunk_concepts
  union select 'fragment', cast(conv_id * 1000 + turn as varchar), 'template', cast(conv_id as varchar) from conversations where turn % 2 = 0
  union select 'fragment', cast(conv_id * 1000 + turn as varchar), 'skill', cast(turn % 2 as varchar) from conversations where role = 'assistant'
  union select 'dimension', unnest(['nation', 'acctbal', 'segment', 'first_order']), 'rule', rule from r union select 'dimension', 'priorities', 'rule', rule from r where n % 2 = 0)
select kind, id, used_by_kind, count(*) as n, min(used_by) as first from b group by 1, 2, 3""",
    "br_list_items": f"""with {M.CHUNKS}, {M.CONCEPTS}, {M.CHUNK_CONCEPTS}, f as (
  select item_id, selection_group from items where status = 'published' and selection_group is not null
    and item_id in (select item_id from chunks join chunk_concepts using (chunk_id) join concepts using (concept_id) where domain in ('Brand#2', 'Brand#4', 'Brand#6', 'Brand#8'))),
p as (select * from f order by item_id limit 21)
select item_id, selection_group, to_base64(encode('cursor:' || cast(item_id as varchar))) as cursor, (select count(*) from p) > 20 as has_next_page, (select count(*) from f) as total from (select * from p order by item_id limit 20)""",
}
