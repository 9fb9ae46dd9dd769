"""Assembly over parts as tools, brands as skills and conversation turns as fragments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwell.catalog import model as M
from sparkwell.catalog import retrieval as Q
from sparkwell.catalog import rules as R
from sparkwell.functions import text as T
from sparkwell.operators import channels, fusion, graph, rules
from sparkwell.operators.concepts import SPREAD
from sparkwell.operators.cuts import written
from sparkwell.plans import assemble as A


def _semantic(s, d):
    """Per label (entity type) the five nearest vectors of each request, all labels in one pass."""
    e = M.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))
    scores = channels.vector_scores(Q._request_vectors(s, d), e, 5, by="kind")
    w = Window.partitionBy("request_id", "kind").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("request_id", "kind", F.col("id").alias("entity_id"), "score", "rank")


def _linked(s, d):
    r = M.requests(s, d).select("request_id")
    ids = r.withColumn("entity_id", F.explode(F.array(F.col("request_id") * 2, F.col("request_id") * 3 + 1))).distinct()
    return ids.join(M.table(s, d, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("label").alias("kind")), "entity_id")


def as_discover(s, d):
    a = A.discover(_semantic(s, d), _linked(s, d))
    return a.select("request_id", "kind", "entity_id", "score", F.coalesce("rank", F.lit(0)).alias("rank"), "reasons")


def _gated(s, d):
    """Parts offered to customers that stand for requests: a link rule every third part, an applicability rule every fourth."""
    values, closure = R.registry(s, d)
    ids = M.requests(s, d).select("request_id")
    nodes = R.nodes(s, d)
    got = rules.evaluate(R.contexts(s, d).join(ids, "request_id", "left_semi"), nodes, R.dimensions(s), values, closure, requests=R.customers(s, d).join(ids, "request_id", "left_semi"))
    # written, so that Spark knows the verdicts of few requests for the smaller side; parts are dealt out, as each meets every request
    verdict = written(rules.authorize(got, nodes, R.dimensions(s)).select("request_id", "rule_id", "state", "allowed", "spec_a", "spec_b"))
    part = M.table(s, d, "part")
    p = part.repartition(1 + part.count() // SPREAD, "p_partkey").select(F.col("p_partkey").alias("entity_id"), F.concat_ws("/", "p_brand", "p_type").alias("rule_id"), F.when(F.col("p_size") % 10 == 0, "draft").otherwise("published").alias("status"), F.col("p_brand").alias("grp"), F.col("p_size").alias("priority"))
    offered = verdict.join(p, "rule_id")
    i = F.col("entity_id")
    return A.gates(offered.withColumn("authorized", F.when(i % 3 == 0, F.col("allowed"))).withColumn("applicable", F.when(i % 4 == 0, F.col("state") == 2)))


def as_gate(s, d):
    return _gated(s, d).where("code IS NOT NULL").groupBy("request_id", "code").agg(F.count("*").alias("n"), F.min(F.when(F.col("code") != "AUTHORIZATION_NO_MATCH", F.col("entity_id")).otherwise(-1)).alias("first_entity"))


def as_groups(s, d):
    live = _gated(s, d).where("code IS NULL")
    k = F.regexp_extract("grp", r"(\d+)", 1).cast("int") % 4
    live = live.withColumn("mode", F.when(k == 0, "all").when(k == 1, "most_specific").when(k == 2, "highest_priority")).withColumn("grp", F.when(F.col("mode").isNotNull(), F.col("grp")))
    return fusion.group_winners(live, "grp", F.col("mode"), "entity_id", ("request_id",)).select("request_id", "entity_id")


def _turns(s, d):
    c = M.table(s, d, "conversations")
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn"), "role", F.col("text").alias("content"), T.estimate_tokens(F.col("text")).alias("tokens"))


def _fragments(s, d):
    """Turns as fragments: how they are included, a gate that some fail, a group of three neighbours, its mode (one kind of group has none)."""
    t = _turns(s, d).groupBy("request_id", "turn").agg(F.max(F.col("role") == "assistant").alias("answers"))
    i, k = F.col("turn"), F.expr("turn div 4")
    return t.select(
        "request_id", "answers", "turn", (F.col("request_id") * 1000 + i).alias("fragment"),
        F.when(i % 3 == 0, "always").when(i % 3 == 1, "applicable").otherwise("task_relevant").alias("inclusion"),
        F.when((F.col("request_id") + i) % 11 == 0, "LIFECYCLE_NOT_PUBLISHED").alias("gate"), F.when(i % 4 != 0, k).alias("grp"),
        F.when(k % 3 == 0, "highest_priority").when(k % 3 == 1, "most_specific").alias("mode"), ((7 * i + F.col("request_id")) % 5).alias("priority"), (i % 2).alias("spec_a"), F.lit(0).cast("long").alias("spec_b"),
    )


def as_fragments(s, d):
    """Turns from a template, from three of four tasks and from skills (the answers), merged, gated, and resolved again where skills add to a group."""
    f = graph.cut(_fragments(s, d))
    has_task = F.col("request_id") % 4 != 3
    pick = lambda condition: f.where(condition).select("request_id", "fragment")
    merged = A.merge_fragments(
        pick((F.col("turn") % 2 == 0) | (F.col("turn") % 5 == 1)), pick((F.col("turn") % 3 == 0) & has_task),
        f.where("answers").select("request_id", "fragment", (F.col("turn") % 2).alias("skill")), f.select("fragment", "inclusion"),
    )
    done = A.resolve_fragments(merged, f.drop("request_id", "answers", "turn"), f.select("request_id", has_task.alias("has_task")).distinct())
    return done.select("request_id", "fragment", F.array_join("sources", ",").alias("sources"), F.array_join("reasons", ",").alias("reasons"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("round", F.lit(-1)).alias("round"))


def as_budgets(s, d):
    r = M.requests(s, d).select("request_id")
    m = F.col("request_id") % 3
    template = F.when(m != 0, F.lit(10))
    asked = F.when(m == 1, (F.col("request_id") % 20).cast("int"))
    return r.select("request_id", A.budget(template, asked, F.lit(A.CEILINGS["skills"])).alias("skills"), A.budget(F.when(m == 2, F.lit(80)), F.lit(A.CEILINGS["tools"])).alias("tools"))


def _graph(s, d):
    gate = F.when(F.col("p_size") == 25, "LIFECYCLE_NOT_PUBLISHED").when(F.col("p_size") == 50, "AUTHORIZATION_NO_MATCH")
    nodes = M.table(s, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 25 != 0).alias("usable"), gate.alias("code"))
    return nodes, graph.cut(M.tool_edges(s, d))


def _seeds(s, d):
    """Every request asks for four parts; the first is required."""
    n = M.table(s, d, "part").count()
    r = M.requests(s, d).select("request_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    return r.select("request_id", ((13 * F.col("request_id") + 101 * F.col("j")) % n).alias("node"), (F.col("j") == 0).alias("required"))


def gr_dep_closure(s, d):
    nodes, edges = _graph(s, d)
    v, _ = graph.dependency_closure(_seeds(s, d), nodes, edges)
    return v.select("request_id", "node", "usable", "included", "required", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("root", F.lit(-1)).alias("root"))


def as_provenance(s, d):
    """Why every tool is there: asked for, or needed or offered by others that are, and by which."""
    nodes, edges = _graph(s, d)
    v, e = graph.dependency_closure(_seeds(s, d), nodes, edges)
    return A.provenance(v, e, _seeds(s, d)).select("request_id", "node", *[F.array_join(c, ",").alias(c) for c in ("sources", "required_by", "reasons")])


def as_edge_status(s, d):
    nodes, edges = _graph(s, d)
    return graph.dependency_closure(_seeds(s, d), nodes, edges)[1].withColumn("cause", F.coalesce("cause", F.lit(-1)))


def _skills(s, d):
    """A skill is four neighbouring parts and needs the two largest of them; every request asks for six."""
    n = M.table(s, d, "part").count() // 4
    r = M.requests(s, d).select("request_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    p = M.table(s, d, "part").select(F.expr("p_partkey div 4").alias("skill"), F.col("p_partkey").alias("tool"))
    return r.select("request_id", ((7 * F.col("request_id") + 31 * F.col("j")) % n).alias("skill")).distinct(), p.where("tool % 4 >= 2").select("skill", "tool")


def as_skill_select(s, d):
    skills, needs = _skills(s, d)
    return A.select_skills(skills, needs, *_graph(s, d))[0]


def as_removed_skills(s, d):
    """Why skills went: each tool that cannot be used, and the gated tool behind it."""
    return A.select_skills(*_skills(s, d), *_graph(s, d))[2]


def as_usage(s, d):
    skills, needs = _skills(s, d)
    return A.usage(skills, *A.select_skills(skills, needs, *_graph(s, d)), as_budgets(s, d))


def as_tool_budget(s, d):
    nodes, edges = _graph(s, d)
    v, _ = graph.dependency_closure(_seeds(s, d), nodes, edges)
    p = M.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("priority"))
    seed = _seeds(s, d).select("request_id", "node", F.lit(True).alias("seed"))
    tools = v.where("included").join(p, "node").join(seed, ["request_id", "node"], "left").select("request_id", "node", "required", "score", "priority", F.coalesce("seed", F.lit(False)).alias("seed"), F.lit(A.CEILINGS["tools"]).alias("budget"))
    return A.trim_tools(tools, edges)


def as_bootstrap(s, d):
    """Retrieval confined to the concepts that a request resolves to, under the bootstrap budget; one that resolves to none is not confined."""
    seeds = Q._seeds(s, d).select("request_id", F.lit("concept").alias("kind"), F.col("concept_id").cast("string").alias("value"))
    limits = Q._profiled(s, d).withColumn("max_tokens", F.least("max_tokens", F.lit(A.CEILINGS["bootstrap_tokens"])))
    return Q._done(s, d, seeds, limits).where("code IS NULL").select("request_id", "chunk_id", "final_rank")


def as_render(s, d):
    f = _turns(s, d).withColumn("place", F.col("turn")).withColumn("always", F.col("turn") == 0)
    out = A.render(f, 600)
    return out.select("request_id", "status", F.md5("text").alias("text_md5"), F.col("tokens").cast("long").alias("tokens"), F.col("n").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (as_discover, as_gate, as_groups, as_fragments, as_budgets, gr_dep_closure, as_provenance, as_edge_status, as_skill_select, as_removed_skills, as_usage, as_tool_budget, as_bootstrap, as_render)}

_GATED = f"""{R._EVAL}, p as (select p_partkey as entity_id, p_brand || '/' || p_type as rule_id, case when p_size % 10 = 0 then 'draft' else 'published' end as status, p_brand as grp, p_size as priority from part),
g as (select request_id, p.*, spec_a, spec_b, case when status <> 'published' then 'LIFECYCLE_NOT_PUBLISHED' when entity_id % 3 = 0 and not allowed then 'AUTHORIZATION_NO_MATCH' when entity_id % 4 = 0 and state <> 'true' then 'APPLICABILITY_NO_MATCH' end as code
  from done join p using (rule_id) where request_id in (select item_id from benchmark))"""


def _closure_sql(seeds: str) -> str:
    """Verdicts and edge statuses for seeds(request_id, node, required)."""
    return f"""{M.TOOL_EDGES}, nodes as (select p_partkey as node, p_size % 25 <> 0 as usable from part), seeds as ({seeds}),
rooted as (select node, node as root, 0 as hops from nodes where not usable union select source, root, hops + 1 from tool_edges join rooted on target = node where requirement = 'required'),
broken as (select node, case when min(hops) > 0 then 'REQUIRED_DEPENDENCY_UNAVAILABLE' else (select case p_size when 25 then 'LIFECYCLE_NOT_PUBLISHED' else 'AUTHORIZATION_NO_MATCH' end from part where p_partkey = node) end as code, (array_agg(root order by hops, root))[1] as root from rooted group by node),
considered as (select request_id, node from seeds union select request_id, target from considered join tool_edges on source = node),
included as (select request_id, node from seeds where node not in (select node from broken) union select request_id, target from included join tool_edges on source = node where target not in (select node from broken)),
req as (select request_id, node from seeds where required and node not in (select node from broken) union select request_id, target from req join tool_edges on source = node where requirement = 'required' and target not in (select node from broken)),
verdict as (select request_id, node, node not in (select node from broken) as usable, (request_id, node) in (select (request_id, node) from included) as included, (request_id, node) in (select (request_id, node) from req) as required from considered),
status as (
  select s.request_id, source, target, requirement, coalesce(b.root, -1) as cause, case when t.usable and s.included then 'INCLUDED' when not t.usable and requirement = 'required' then 'UNAVAILABLE' when not t.usable then 'OPTIONAL_OMITTED' else 'BLOCKED_BY_DEPENDENCY' end as status
  from tool_edges join verdict s on s.node = source join verdict t on t.node = target and t.request_id = s.request_id left join broken b on b.node = target)"""


_SEEDS = "select item_id as request_id, (13 * item_id + 101 * j) % (select count(*) from part) as node, j = 0 as required from benchmark, range(4) t(j)"
# a skill stays when both its tools are usable: skills do not touch each other's gates, so one round decides
_SKILLS = f"""with recursive {_closure_sql(_SEEDS)},
skills as (select distinct item_id as request_id, (7 * item_id + 31 * j) % (select count(*) // 4 from part) as skill from benchmark, range(6) t(j)),
kept as (select request_id, skill from skills where skill not in (select node // 4 from broken where node % 4 >= 2)),
used as (select kept.request_id, p_partkey as node from kept join part on p_partkey // 4 = skill and p_partkey % 4 >= 2),
inc as (select request_id, node from used union select request_id, target from inc join tool_edges on source = node where target not in (select node from broken))"""
_BOOTSTRAP = "hf as (select request_id, 'concept' as kind, cast(concept_id as varchar) as value from seeds)"
CEILING = A.CEILINGS["bootstrap_tokens"]

SQL = {
    "as_discover": """with s as (select i.item_id as request_id, v.label as kind, v.vec_id as entity_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as score from benchmark i join embeddings q on q.vec_id = i.item_id, embeddings v),
r as (select *, cast(row_number() over (partition by request_id, kind order by score desc, entity_id) as int) as rank from s qualify rank <= 5),
l as (select distinct x.request_id, label as kind, x.entity_id from (select item_id as request_id, unnest([item_id * 2, item_id * 3 + 1]) as entity_id from benchmark) x join embeddings on vec_id = x.entity_id)
select coalesce(r.request_id, l.request_id) as request_id, coalesce(r.kind, l.kind) as kind, coalesce(r.entity_id, l.entity_id) as entity_id, score, coalesce(rank, 0) as rank, concat_ws(',', case when rank is not null then 'VECTOR_MATCH' end, case when l.request_id is not null then 'DIRECT_CONCEPT_LINK' end) as reasons
from r full join l on r.request_id = l.request_id and r.kind = l.kind and r.entity_id = l.entity_id""",
    "as_gate": f"with {_GATED} select request_id, code, count(*) as n, min(case when code <> 'AUTHORIZATION_NO_MATCH' then entity_id else -1 end) as first_entity from g where code is not null group by 1, 2",
    "as_groups": f"""with {_GATED}, h as (select *, cast(regexp_extract(grp, '(\\d+)', 1) as int) % 4 as k from g where code is null)
select request_id, entity_id from h qualify case when k in (0, 3) then true when k = 1 then row_number() over (partition by request_id, grp order by spec_a desc, spec_b desc, priority desc, entity_id) = 1 else row_number() over (partition by request_id, grp order by priority desc, spec_a desc, spec_b desc, entity_id) = 1 end""",
    "as_fragments": """with t as (
  select conv_id as request_id, turn, conv_id * 1000 + turn as fragment, bool_or(role = 'assistant') as answers, turn // 4 as k, case when turn % 4 <> 0 and (turn // 4) % 3 <> 2 then turn // 4 end as grp,
    (7 * turn + conv_id) % 5 as priority, turn % 2 as spec, turn % 2 = 0 or turn % 5 = 1 as tpl, turn % 3 = 0 and conv_id % 4 <> 3 as tsk,
    case when (conv_id + turn) % 11 = 0 then 'LIFECYCLE_NOT_PUBLISHED' when turn % 3 = 2 and conv_id % 4 = 3 then 'TASK_REQUIRED_FOR_FRAGMENT' end as gate from conversations group by conv_id, turn),
m as (
  select *, not (tpl or tsk) as late, concat_ws(',', case when answers then 'skill:' || cast(turn % 2 as varchar) end, case when tsk and not tpl then 'task' end, case when tpl then 'template' end) as sources,
    concat_ws(',', case when tpl and turn % 3 = 1 then 'APPLICABLE_FRAGMENT' end, case when answers then 'SELECTED_SKILL' end, case when (tpl and turn % 3 = 2) or (tsk and not tpl) then 'TASK_RELEVANT_FRAGMENT' end, case when tpl and turn % 3 = 0 then 'TEMPLATE_FRAGMENT' end) as reasons
  from t where tpl or tsk or answers),
a as (select *, row_number() over (partition by request_id, grp order by case when k % 3 = 1 then spec end desc, priority desc, spec desc, fragment) as r from m where gate is null and grp is not null and not late),
lost1 as (select fragment from a where r > 1),
b as (
  select *, row_number() over (partition by request_id, grp order by case when k % 3 = 1 then spec end desc, priority desc, spec desc, fragment) as r from m
  where gate is null and grp is not null and fragment not in (select fragment from lost1) and (request_id, grp) in (select (request_id, grp) from m where gate is null and grp is not null and late))
select request_id, fragment, sources, reasons, coalesce(gate, case when fragment in (select fragment from lost1) or fragment in (select fragment from b where r > 1) then 'SELECTION_GROUP_NOT_SELECTED' end, '') as code,
  cast(case when gate is not null then 0 when fragment in (select fragment from lost1) then 1 when fragment in (select fragment from b where r > 1) then 2 else -1 end as int) as round from m""",
    "as_budgets": "select item_id as request_id, cast(least(case when item_id % 3 <> 0 then 10 end, case when item_id % 3 = 1 then item_id % 20 end, 32) as int) as skills, cast(least(case when item_id % 3 = 2 then 80 end, 64) as int) as tools from benchmark",
    "gr_dep_closure": f"with recursive {_closure_sql(_SEEDS)} select request_id, node, usable, included, required, coalesce(code, '') as code, coalesce(root, -1) as root from verdict left join broken using (node)",
    "as_provenance": f"""with recursive {_closure_sql(_SEEDS)},
b as (select request_id, target as node, string_agg(cast(source as varchar), ',' order by source) as by_all, string_agg(case when requirement = 'required' then cast(source as varchar) end, ',' order by source) as by_required, bool_or(requirement = 'required') as must, bool_or(requirement = 'optional') as may from status where status = 'INCLUDED' group by 1, 2),
k as (select distinct request_id, node, required from seeds)
select v.request_id, v.node, concat_ws(',', case when k.node is not null then 'request' end, (select string_agg('tool:' || cast(source as varchar), ',' order by 'tool:' || cast(source as varchar)) from status s where s.request_id = v.request_id and s.target = v.node and s.status = 'INCLUDED')) as sources,
  coalesce(by_required, '') as required_by, concat_ws(',', case when may then 'OPTIONAL_TOOL_DEPENDENCY' end, case when k.node is not null then 'REQUESTED_TOOL' end, case when must then 'REQUIRED_TOOL_DEPENDENCY' end) as reasons
from verdict v left join b on b.request_id = v.request_id and b.node = v.node left join k on k.request_id = v.request_id and k.node = v.node where v.included""",
    "as_edge_status": f"with recursive {_closure_sql(_SEEDS)} select request_id, source, target, requirement, status, cause from status",
    "as_skill_select": f"{_SKILLS} select request_id, skill from kept",
    "as_removed_skills": f"{_SKILLS} select request_id, skill, node as tool, code, root from skills join broken on node // 4 = skill and node % 4 >= 2",
    "as_usage": f"""{_SKILLS}, why as (select request_id, string_agg(code || ':' || cast(n as varchar), ',' order by code) as removed from (select request_id, code, count(distinct skill) as n from skills join broken on node // 4 = skill and node % 4 >= 2 group by 1, 2) group by 1),
caps as (select item_id as request_id, least(case when item_id % 3 <> 0 then 10 end, case when item_id % 3 = 1 then item_id % 20 end, 32) as skills, least(case when item_id % 3 = 2 then 80 end, 64) as tools from benchmark),
u as (select request_id, 'skills' as budget, (select count(*) from kept k where k.request_id = c.request_id) as used, skills as most from caps c union all select request_id, 'tools', (select count(*) from inc i where i.request_id = c.request_id), tools from caps c)
select request_id, budget, used, cast(most as bigint) as most, used > most as over, coalesce(removed, '') as removed from u left join why using (request_id)""",
    "as_render": """with recursive t as (select conv_id as request_id, turn, text, cast(ceil(length(text) / 4.0) as bigint) as tokens, row_number() over (partition by conv_id order by turn, text) as r from conversations),
x as (select request_id, sum(case when turn = 0 then tokens else 0 end)::bigint as fixed, max(r) as last from t group by 1),
f as (select request_id, 0::bigint as r, fixed as used, 0::bigint as n, '' as out from x
  union all select f.request_id, f.r + 1, case when turn <> 0 and used + tokens <= 600 then used + tokens else used end, case when turn = 0 or used + tokens <= 600 then n + 1 else n end,
    case when turn = 0 or used + tokens <= 600 then case when n = 0 then text else out || chr(10) || chr(10) || text end else out end from f join t on t.request_id = f.request_id and t.r = f.r + 1)
select f.request_id, case when fixed <= 600 then 'OK' else 'PROMPT_OVER_BUDGET' end as status, md5(case when fixed <= 600 then out else '' end) as text_md5, case when fixed <= 600 then used else 0 end as tokens, case when fixed <= 600 then n else 0 end as n
from f join x on x.request_id = f.request_id and x.last = f.r""",
    "as_bootstrap": f"with recursive {Q._done_sql(_BOOTSTRAP, CEILING)} select request_id, chunk_id, final_rank from finished where final_code is null",
}
