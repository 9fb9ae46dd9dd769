"""Retrieval over benchmark requests and documents: channels, resolution, fusion, packing, and the whole plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.catalog import model as M
from sparkwell.catalog import rules as R
from sparkwell.operators import channels as C
from sparkwell.operators import concepts as K
from sparkwell.operators import fusion, graph, rules
from sparkwell.operators.cuts import cut, written
from sparkwell.plans import retrieve as P

LIMITS = P.DEFAULTS


def _request_vectors(s, d):
    v = M.table(s, d, "embeddings").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"))
    return M.requests(s, d).select("request_id").join(v, "request_id")


def _chunk_vectors(s, d):
    docs = M.table(s, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return M.table(s, d, "embeddings").join(docs.hint("merge"), "vec_id").select((F.col("vec_id") * M.STRIDE).alias("id"), F.col("embedding").alias("vector"))


def tk_vector(s, d):
    return C.vector_channel(_request_vectors(s, d), _chunk_vectors(s, d), LIMITS["vector"])


def _names(s, d):
    """Names of the concepts of every chunk."""
    named = M.chunk_concepts(s, d).join(M.concepts(s, d).select("concept_id", "name").hint("merge"), "concept_id")
    return named.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))


def tk_fulltext(s, d):
    return C.fulltext_channel(M.requests(s, d), C.postings(M.chunks(s, d), _names(s, d)), LIMITS["full_text"])


def tk_fulltext_stemmed(s, d):
    """As tk_fulltext, with words cut to their English stems on both sides."""
    return C.fulltext_channel(M.requests(s, d), C.postings(M.chunks(s, d), _names(s, d), keep=True), LIMITS["full_text"], stemmed=True)


def _headings(s, d):
    c = M.chunks(s, d)
    return c.select("chunk_id", F.col("title").alias("name")).unionByName(c.select("chunk_id", F.col("heading").alias("name")))


def tk_trigram(s, d):
    """Titles of items and headings of chunks; the better of both counts."""
    return C.trigram_channel(M.requests(s, d), _headings(s, d), LIMITS["trigram"])


def _concept_semantic(s, d):
    """The ten nearest published concepts by vector (concept i has vector i)."""
    live = M.concepts(s, d).where("status = 'published'").select(F.col("concept_id").alias("vec_id"))
    v = M.table(s, d, "embeddings").join(live.hint("merge"), "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return C.vector_channel(_request_vectors(s, d), v, 10).select("request_id", F.col("chunk_id").alias("concept_id"), "score")


def _asked(s, d):
    return M.requests(s, d).select("request_id", F.col("concept_text").alias("text"))


def qp_resolve_concepts(s, d):
    return K.resolve_concepts(_asked(s, d), M.concepts(s, d), _concept_semantic(s, d))


def ag_ambiguous(s, d):
    a = K.ambiguous(K.match_hits(_asked(s, d), M.concepts(s, d)))
    return a.select("request_id", "n", F.array_join("concept_ids", ",").alias("concept_ids"))


def ag_strongest_match(s, d):
    return K.strongest(K.match_hits(_asked(s, d), M.concepts(s, d))).select("request_id", "concept_id", "class", "matched_text", "score")


def st_hits_union(s, d):
    return K.match_hits(_asked(s, d), M.concepts(s, d)).groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("n_requests"))


def _seeds(s, d):
    return written(qp_resolve_concepts(s, d).where(F.col("rank") <= LIMITS["seeds"]).select("request_id", "concept_id", F.col("rank").alias("seed_rank")))


def tk_concept(s, d):
    return C.concept_channel(_seeds(s, d), M.chunk_concepts(s, d), LIMITS["concept_linked"])


def _published(s, d):
    return M.concepts(s, d).where("status = 'published'").select(F.col("concept_id").alias("node"))


def _expanded(s, d, hops):
    return graph.expand(_seeds(s, d).withColumnRenamed("concept_id", "node"), M.edges(s, d), _published(s, d), hops)


def gr_expand(s, d):
    return _expanded(s, d, 2).select("request_id", "node", "seed", "seed_rank", "hops", "first_relation")


def gr_paths(s, d):
    return _expanded(s, d, 2).select("request_id", "node", "hops", F.array_join("path", " ").alias("path"))


def tk_graph(s, d):
    return C.graph_channel(_expanded(s, d, LIMITS["graph_depth"]), M.chunk_concepts(s, d), M.concepts(s, d), ["R", "A"], LIMITS["graph_limit"])


def _profiles(s, d):
    b = M.table(s, d, "benchmark").agg(F.count("*").cast("int").alias("n"))
    fields = dict.fromkeys(LIMITS, F.lit(None).cast("int"))

    def profile(name, default, **given):
        return b.select(F.lit(name).alias("profile"), F.lit(default).alias("is_default"), *[c.alias(f) for f, c in (fields | given).items()])

    return profile("wide", False, vector=F.col("n")).unionByName(profile("tight", False, max_chunks=F.lit(5))).unionByName(profile("base", True, trigram=F.lit(50)))


def _profiled(s, d):
    """Every request with the limits of its profile (named, default or built in), and why it cannot be answered."""
    r = M.requests(s, d)
    named = r.select("request_id", F.when(F.col("request_id") % 4 == 0, "wide").when(F.col("request_id") % 4 == 1, "tight").when(F.col("request_id") % 4 == 2, "absent").alias("profile"))
    return P.errors(r, P.profiles(named, _profiles(s, d)))


def _services(s, d):
    """Whether the vector of a request and the graph could be had."""
    i = F.col("request_id")
    return M.requests(s, d).select("request_id", (i % 5 != 4).alias("has_vector"), (i % 8 != 3).alias("has_graph"))


def _candidates(s, d):
    """All channels under the limits of each request's profile; requests in error have none, and a channel that is down is left out."""
    limits = cut(_profiled(s, d).where("error_code IS NULL"))
    limit = lambda name: limits.select("request_id", F.col(name).alias("limit"))
    most = limits.agg(F.max("vector")).first()[0] or 1
    services = _services(s, d)
    asked = M.requests(s, d).join(limits.select("request_id"), "request_id", "left_semi")
    vectors = _request_vectors(s, d).join(services.where("has_vector"), "request_id", "left_semi").join(limits.select("request_id"), "request_id", "left_semi")
    seeds = written(qp_resolve_concepts(s, d).join(limits.select("request_id", "seeds"), "request_id").where("rank <= seeds").select("request_id", "concept_id", F.col("rank").alias("seed_rank")))
    links = M.chunk_concepts(s, d)
    walk = seeds.join(services.where("has_graph"), "request_id", "left_semi").withColumnRenamed("concept_id", "node")
    near = graph.expand(walk, M.edges(s, d), _published(s, d), limits.agg(F.max("graph_depth")).first()[0] or 1)
    near = near.join(limits.select("request_id", "graph_depth"), "request_id").where("hops <= graph_depth").drop("graph_depth")
    out = C.vector_channel(vectors, _chunk_vectors(s, d), limit("vector"), most=most)
    for part in (
        C.fulltext_channel(asked, C.postings(M.chunks(s, d), _names(s, d)), limit("full_text")), C.trigram_channel(asked, _headings(s, d), limit("trigram")),
        C.concept_channel(seeds, links, limit("concept_linked")), C.graph_channel(near, links, M.concepts(s, d), ["R", "A"], limit("graph_limit")),
    ):
        out = out.unionByName(part)
    return cut(out)


def st_channel_union(s, d):
    return _candidates(s, d).groupBy("request_id", "chunk_id").agg(F.count("*").alias("n_channels"), F.min("rank").alias("best_rank"))


def ag_channel_pivot(s, d):
    m = fusion.merge_channels(_candidates(s, d))
    return m.select("request_id", "chunk_id", *[c for ch in fusion.CHANNELS for c in (_rank(ch), f"{ch}_score")])


def _rank(channel):
    """A channel's rank, 0 where the chunk is not in it."""
    return F.coalesce(f"{channel}_rank", F.lit(0)).alias(f"{channel}_rank")


def ag_rrf(s, d):
    return fusion.merge_channels(_candidates(s, d)).select("request_id", "chunk_id", "rrf")


def qp_reasons(s, d):
    return fusion.merge_channels(_candidates(s, d)).select("request_id", "chunk_id", F.array_join(fusion.reasons(), ",").alias("reasons"))


def _gated_chunks(s, d):
    """Chunks with rules: every fourth item has an authorization, another fourth an applicability rule (of some brand and type)."""
    p = M.table(s, d, "part")
    n = p.count()
    rule = p.select(F.col("p_partkey").alias("k"), F.concat_ws("/", "p_brand", "p_type").alias("rule_id"))
    i = F.col("item_id")
    c = M.chunks(s, d).withColumn("k", (7 * i) % n).join(rule.hint("merge"), "k")
    own = F.when(i % 11 == 5, "deprecated").otherwise(F.col("status"))
    return c.select("chunk_id", "item_id", own.alias("status"), F.col("status").alias("item_status"), "priority", "authority", "effective_from", "effective_to", "selection_group", "token_count", F.when(i % 4 == 1, F.col("rule_id")).alias("authorization"), F.when(i % 4 == 2, F.col("rule_id")).alias("applicability"))


def _verdicts(s, d):
    """Rules for the customers that stand for the requests."""
    values, closure = R.registry(s, d)
    ids = M.requests(s, d).select("request_id")
    nodes = R.nodes(s, d)
    got = rules.evaluate(R.contexts(s, d).join(ids, "request_id", "left_semi"), nodes, R.dimensions(s), values, closure, requests=R.customers(s, d).join(ids, "request_id", "left_semi"))
    return rules.authorize(got, nodes, R.dimensions(s))


def _modes(s, d):
    g = M.items(s, d).select("selection_group").where("selection_group IS NOT NULL").distinct()
    k = F.substring_index("selection_group", "-", -1).cast("int") % 24
    return g.select("selection_group", F.when(k == 8, "all").when(k == 16, "most_specific").otherwise("highest_priority").alias("mode"))


def _members(s, d):
    """What chunks belong to: their item, their concepts, the domains of these."""
    links = M.chunk_concepts(s, d).join(M.concepts(s, d).select("concept_id", "domain").hint("merge"), "concept_id")
    member = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
    own = M.chunks(s, d).select("chunk_id", member("item", "item_id").alias("x")).unionByName(links.select("chunk_id", F.explode(F.array(member("concept", "concept_id"), member("domain", "domain"))).alias("x")))
    return own.select("chunk_id", "x.*").distinct()


def _filters(s, d):
    """A fifth of the requests is confined to items, one to concepts, two to domains (one of them also to concepts), the rest to nothing."""
    r = written(M.requests(s, d).select("request_id", (F.col("request_id") % 5).alias("m")))
    i = F.col("request_id")
    items = M.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("value"), (F.col("doc_id") % 7).alias("k"))
    concepts = M.concepts(s, d).select(F.col("concept_id").cast("string").alias("value"), (F.col("concept_id") % 3).alias("k"))
    domains = M.concepts(s, d).select(F.col("domain").alias("value"), (F.regexp_extract("domain", r"(\d+)", 1).cast("long") % 2).alias("k")).distinct()
    confined = lambda kind, asked, among, n: asked.withColumn("k", i % n).join(among, "k").select("request_id", F.lit(kind).alias("kind"), "value")
    return confined("item", r.where("m = 1"), items, 7).unionByName(confined("concept", r.where("m = 2"), concepts, 3)).unionByName(confined("domain", r.where("m IN (2, 3)"), domains, 2))


def _done(s, d, filters=None, limits=None):
    filters = _filters(s, d) if filters is None else filters
    limits = _profiled(s, d) if limits is None else limits
    return P.retrieve(_candidates(s, d), cut(_gated_chunks(s, d)), M.requests(s, d), cut(_verdicts(s, d)), _modes(s, d), limits, cut(filters), cut(_members(s, d)))


def qp_retrieve(s, d):
    return _done(s, d).where("code IS NULL").select("request_id", "chunk_id", "item_id", "final_rank", "rrf", "token_count")


def qp_exclusions(s, d):
    return P.exclusions(_done(s, d)).withColumn("chunk_id", F.coalesce(F.col("chunk_id").cast("string"), F.lit("redacted")))


def qp_rankings(s, d):
    return _done(s, d).where("final_rank IS NOT NULL").select("request_id", "chunk_id", "final_rank", *[_rank(ch) for ch in fusion.CHANNELS], F.col("code").isNull().alias("packed"))


def ag_funnel(s, d):
    return P.funnel(_done(s, d))


def ag_token_total(s, d):
    return qp_retrieve(s, d).groupBy("request_id").agg(F.sum("token_count").alias("tokens"), F.count("*").alias("n"))


def qp_degrade(s, d):
    return P.warnings(_services(s, d))


def qp_profile(s, d):
    return _profiled(s, d).select("request_id", "vector", "trigram", "max_chunks", "max_tokens", "error_code")


QUERIES = {f.__name__: f for f in (tk_vector, tk_fulltext, tk_fulltext_stemmed, tk_trigram, qp_resolve_concepts, ag_ambiguous, ag_strongest_match, st_hits_union, tk_concept, gr_expand, gr_paths, tk_graph, st_channel_union, ag_channel_pivot, ag_rrf, qp_reasons, qp_retrieve, qp_exclusions, qp_rankings, ag_funnel, ag_token_total, qp_degrade, qp_profile)}

# ---- the same in SQL ----


def _grams(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _lexemes(c: str) -> str:
    from sparkwell.catalog.functions import _folded
    from sparkwell.functions.text import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_split_to_array(lower({_folded(c)}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' and w not in ({stop}))"


_BASE = f"{M.REQUESTS}, {M.CHUNKS}, {M.CHUNK_CONCEPTS}"
_VECTOR = """qv as (select request_id, embedding as q from requests join embeddings on vec_id = request_id),
vector_hits as (
  select request_id, v.vec_id * 100000 as chunk_id, round(list_cosine_similarity(q::double[], embedding::double[]), 9) as score
  from qv, embeddings v where v.vec_id in (select doc_id from documents)),
tk_vector as (select request_id, 'vector' as channel, chunk_id, cast(row_number() over (partition by request_id order by score desc, chunk_id) as int) as rank, score from vector_hits qualify rank <= 60)"""
_FULL = f"""cnames as (select chunk_id, string_agg(name, ' ' order by name) as names from chunk_concepts join concepts using (concept_id) group by 1),
post as (
  select chunk_id, unnest(list_concat(list_concat(a, b), c)) as lexeme, unnest(range(0, len(a) + len(b) + len(c))) as pos, len(a) as na, len(a) + len(b) as nb
  from (select chunk_id, {_lexemes('title')} as a, {_lexemes('content')} as b, {_lexemes("coalesce(names, '')")} as c from chunks left join cnames using (chunk_id))),
ask as (select request_id, unnest(q) as lexeme, unnest(range(0, len(q))) as k, len(q) as n from (select request_id, list_sort(list_distinct({_lexemes('query')})) as q from requests)),
hold as (select request_id, chunk_id from (select distinct chunk_id, lexeme from post) join ask using (lexeme) group by 1, 2 having count(*) = any_value(n)),
found as (select request_id, chunk_id, k, n, pos, case when pos < na then 1.0 when pos < nb then 0.4 else 0.2 end::double as weight from hold join post using (chunk_id) join ask using (request_id, lexeme)),
latest as (select e.request_id, e.chunk_id, e.pos as e, f.k, any_value(e.n) as n, max(f.pos) as pos, arg_max(f.weight, f.pos) as w from found e join found f on f.request_id = e.request_id and f.chunk_id = e.chunk_id and f.pos <= e.pos group by 1, 2, 3, 4),
ends as (select request_id, chunk_id, e, any_value(n) as n, min(pos) as s, list_sum(list(1 / w order by k)) as inv from latest group by 1, 2, 3 having count(*) = any_value(n)),
covers as (select request_id, chunk_id, s, min(e) as e, arg_min(inv, e) as inv, any_value(n) as n from ends group by 1, 2, 3),
full_hits as (select request_id, chunk_id, round(sum((n / inv) / (1 + e - s + 1 - n)), 9) as score from covers group by 1, 2),
tk_fulltext as (select request_id, 'fullText' as channel, chunk_id, cast(row_number() over (partition by request_id order by score desc, chunk_id) as int) as rank, score from full_hits qualify rank <= 40)"""
_TRGM = f"""tq as (select request_id, {_grams('query')} as a from requests),
tn as (select chunk_id, title as name from chunks union all select chunk_id, heading from chunks where heading is not null),
tt as (select name, {_grams('name')} as b from (select distinct name from tn)),
tsim as (select request_id, name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double as score from tq, tt where len(b) > 0),
tri_hits as (select request_id, chunk_id, round(max(score), 9) as score from tsim join tn using (name) where score > 0.3 group by 1, 2),
tk_trigram as (select request_id, 'trigram' as channel, chunk_id, cast(row_number() over (partition by request_id order by score desc, chunk_id) as int) as rank, score from tri_hits qualify rank <= 20)"""


def _similar(what: str) -> str:
    return f"""select request_id, concept_id, case when contains(n, q) then 4 else 5 end as place, {what} as matched_text, round(sim, 9) as score
  from (select request_id, q, concept_id, {what}, n, len(list_intersect(g, qg)) / len(list_distinct(list_concat(g, qg)))::double as sim
    from (select *, {_grams('n')} as g from (select concept_id, {what}, lower(trim({what})) as n from live)), (select *, {_grams('q')} as qg from asked)) where contains(n, q) or sim > 0.3"""


_RESOLVE = f"""live as (select * from concepts where status = 'published'),
asked as (select request_id, concept_text as t, lower(trim(concept_text)) as q from requests),
sem as (
  select request_id, vec_id as concept_id, round(list_cosine_similarity(q::double[], embedding::double[]), 9) as score
  from (select request_id, embedding as q from requests join embeddings on vec_id = request_id), embeddings v where v.vec_id in (select concept_id from live)),
hits as (
  select request_id, concept_id, 1 as place, key as matched_text, null::double as score from asked join live on t = key
  union all select request_id, concept_id, 2, name, null from asked join live on q = lower(name)
  union all select request_id, concept_id, 3, alias, null from asked join live on q = lower(alias)
  union all {_similar('key')}
  union all {_similar('name')}
  union all {_similar('alias')}),
all_hits as (
  select * from hits union all select request_id, concept_id, 6, name, score from (
    select request_id, concept_id, score from sem qualify row_number() over (partition by request_id order by score desc, concept_id) <= 10) join live using (concept_id)),
best as (select * from all_hits qualify row_number() over (partition by request_id, concept_id order by place, coalesce(score, 0) desc, matched_text) = 1),
resolved as (
  select request_id, concept_id, (['EXACT_KEY', 'EXACT_NAME', 'EXACT_ALIAS', 'LEXICAL', 'TRIGRAM', 'SEMANTIC'])[place] as class, matched_text, score,
    cast(row_number() over (partition by request_id order by place, case when place <= 3 then key end, case when place > 3 then -coalesce(score, 0) end, concept_id) as int) as rank
  from best join (select concept_id, key from concepts) using (concept_id) qualify rank <= 10),
seeds as (select request_id, concept_id, rank as seed_rank from resolved where rank <= 4)"""
_BEST_LEX = """lex as (select * from hits qualify row_number() over (partition by request_id, concept_id order by place, coalesce(score, 0) desc, matched_text) = 1)"""
_CONCEPT = """con_hits as (select distinct request_id, chunk_id from seeds join chunk_concepts using (concept_id)),
tk_concept as (select request_id, 'conceptLinked' as channel, chunk_id, cast(row_number() over (partition by request_id order by chunk_id) as int) as rank, null::double as score from con_hits qualify rank <= 30)"""


def _hop(n: int) -> str:
    before = " union all ".join(f"select request_id, node from layer{i}" for i in range(n))
    return f"""walk{n} as (
  select f.request_id, e.target as next, f.seed, f.seed_rank, f.first_relation, f.path, '>' as way, e.relation, e.edge_id, e.source, e.target from layer{n - 1} f join led e on f.node = e.source
  union all select f.request_id, e.source, f.seed, f.seed_rank, f.first_relation, f.path, '<', e.relation, e.edge_id, e.source, e.target from layer{n - 1} f join led e on f.node = e.target
    where not exists (select 1 from layer{n - 1} g where g.request_id = f.request_id and g.node = e.source)),
layer{n} as (
  select request_id, next as node, seed, seed_rank, {n} as hops, coalesce(first_relation, relation) as first_relation, path || case when path = '' then '' else ' ' end || way || relation || ':' || cast(next as varchar) as path
  from walk{n} anti join (select request_id, node as next from ({before})) using (request_id, next)
  qualify row_number() over (partition by request_id, next order by relation, edge_id, source, target) = 1)"""


_EXPAND = f"""{M.EDGES},
led as (select * from edges where source in (select concept_id from live) and target in (select concept_id from live)),
layer0 as (select request_id, concept_id as node, concept_id as seed, seed_rank, 0 as hops, null::varchar as first_relation, '' as path from seeds),
{_hop(1)}"""
_GRAPH = """gr_hits as (
  select request_id, chunk_id, seed_rank, hops, case first_relation when 'R' then 0 when 'A' then 1 else 1073741824 end as t, c.key
  from layer1 join (select concept_id as node, chunk_id from chunk_concepts) using (node) join (select concept_id as node, key from concepts) c using (node)),
gr_once as (select * from gr_hits qualify row_number() over (partition by request_id, chunk_id order by seed_rank, hops, t, key) = 1),
tk_graph as (select request_id, 'graphLinked' as channel, chunk_id, cast(row_number() over (partition by request_id order by seed_rank, hops, t, key, chunk_id) as int) as rank, null::double as score from gr_once qualify rank <= 30)"""
_CANDIDATES = f"""{_BASE}, {_VECTOR.replace("rank <= 60", "rank <= 100000")}, {_FULL}, {_TRGM.replace("rank <= 20", "rank <= 50")}, {_RESOLVE}, {_CONCEPT}, {_EXPAND}, {_GRAPH},
asks as (
  select request_id, case when request_id % 4 = 2 then 'PROFILE_NOT_FOUND' when trim(query) = '' then 'INVALID_INPUT' end as err,
    case when request_id % 4 = 0 then (select count(*) from benchmark) else 60 end as v_lim, case when request_id % 4 = 1 then 5 else 10 end as c_lim from requests),
cand as materialized (
  select c.* from (select * from tk_vector union all select * from tk_fulltext union all select * from tk_trigram union all select * from tk_concept union all select * from tk_graph) c join asks using (request_id)
  where err is null and case channel when 'vector' then rank <= v_lim and request_id % 5 <> 4 when 'graphLinked' then request_id % 8 <> 3 else true end)"""
_CH = ["vector", "fullText", "trigram", "conceptLinked", "graphLinked"]
_MERGED = f"""{_CANDIDATES},
merged as (
  select request_id, chunk_id, {', '.join(f"min(rank) filter (channel = '{c}') as {c}_rank, arg_min(score, rank) filter (channel = '{c}') as {c}_score" for c in _CH)} from cand group by 1, 2),
fused as (select *, round({' + '.join(f"coalesce(1.0::double / (60 + {c}_rank), 0)" for c in _CH)}, 12) as rrf from merged)"""
_FILTERS = """hf as (
  select request_id, 'item' as kind, cast(doc_id as varchar) as value from requests join documents on doc_id % 7 = request_id % 7 where request_id % 5 = 1
  union all select request_id, 'concept', cast(concept_id as varchar) from requests join concepts on concept_id % 3 = request_id % 3 where request_id % 5 = 2
  union all select distinct request_id, 'domain', domain from requests join concepts on cast(regexp_extract(domain, '([0-9]+)', 1) as bigint) % 2 = request_id % 2 where request_id % 5 in (2, 3))"""


def _done_sql(filters: str, tokens: int) -> str:
    """The whole plan under filters hf(request_id, kind, value) and a token budget."""
    return _PLAN.replace("{FILTERS}", filters).replace("{TOKENS}", str(tokens))


_PLAN = f"""{_MERGED}, {R._EVAL}, {{FILTERS}},
member as (
  select chunk_id, 'item' as kind, cast(item_id as varchar) as value from chunks union select chunk_id, 'concept', cast(concept_id as varchar) from chunk_concepts
  union select chunk_id, 'domain', domain from chunk_concepts join concepts using (concept_id)),
wanted as (select request_id, count(distinct kind) as n from hf group by 1),
kept as (
  select f.* from fused f left join wanted w using (request_id)
  where w.n is null or w.n = (select count(distinct m.kind) from member m join hf on hf.kind = m.kind and hf.value = m.value where m.chunk_id = f.chunk_id and hf.request_id = f.request_id)),
vd as (select request_id, rule_id, case state when 'true' then 2 else 0 end as st, spec_a, spec_b, allowed from done where request_id in (select request_id from requests)),
gch as (
  select c.*, case when item_id % 4 = 1 then p_brand || '/' || p_type end as authz, case when item_id % 4 = 2 then p_brand || '/' || p_type end as appl
  from chunks c join part on p_partkey = (7 * item_id) % (select count(*) from part)),
gated as (
  select f.*, g.item_id, g.priority, g.authority, g.selection_group, g.token_count, k.c_lim, coalesce(b.spec_a, 0) as spec_a, coalesce(b.spec_b, 0) as spec_b,
    authz is not null and not coalesce(a.allowed, false) as redacted,
    case when not (status = 'published' or (status = 'draft' and include_draft)) or item_id % 11 = 5 then 'LIFECYCLE_NOT_PUBLISHED'
      when coalesce(effective_from > as_of, false) or coalesce(effective_to <= as_of, false) then 'OUTSIDE_EFFECTIVE_WINDOW'
      when authz is not null and not coalesce(a.allowed, false) then 'AUTHORIZATION_NO_MATCH'
      when appl is not null and coalesce(b.st, 0) <> 2 then 'APPLICABILITY_NO_MATCH' end as code
  from kept f join gch g using (chunk_id) join requests r using (request_id) join asks k using (request_id)
  left join vd a on a.request_id = f.request_id and a.rule_id = authz left join vd b on b.request_id = f.request_id and b.rule_id = appl),
won as (
  select *, case when selection_group is null then true
    when cast(split_part(selection_group, '-', 2) as int) % 24 = 8 then true
    when cast(split_part(selection_group, '-', 2) as int) % 24 = 16 then row_number() over (partition by request_id, selection_group order by spec_a desc, spec_b desc, priority desc, chunk_id) = 1
    else row_number() over (partition by request_id, selection_group order by priority desc, spec_a desc, spec_b desc, chunk_id) = 1 end as wins
  from gated where code is null),
ordered as materialized (select *, cast(row_number() over (partition by request_id order by rrf desc, coalesce(authority, 0) desc, priority desc, chunk_id) as int) as final_rank from won where wins),
fold as (
  select request_id, 0 as i, 0::bigint as n, 0::bigint as used, cast([] as bigint[]) as took, null::bigint as chunk_id, null::varchar as outcome from (select distinct request_id from ordered)
  union all
  select f.request_id, i + 1, n + case when o = 'PACKED' then 1 else 0 end, used + case when o = 'PACKED' then token_count else 0 end, case when o = 'PACKED' then list_append(took, item_id) else took end, cid, o
  from (select f.*, x.item_id, x.token_count, x.chunk_id as cid,
      case when f.n >= x.c_lim then 'TOKEN_BUDGET' when len(list_filter(took, lambda z: z = x.item_id)) >= 3 then 'ITEM_CAP' when used + token_count > {{TOKENS}} then 'TOKEN_BUDGET' else 'PACKED' end as o
    from fold f join ordered x on x.request_id = f.request_id and x.final_rank = f.i + 1) f),
finished as (
  select g.*, o.final_rank, coalesce(g.code, case when w.wins = false then 'SELECTION_GROUP_NOT_SELECTED' end, case fold.outcome when 'ITEM_CAP' then 'PACKING_ITEM_CAP' when 'TOKEN_BUDGET' then 'PACKING_TOKEN_BUDGET' end) as final_code
  from gated g left join won w using (request_id, chunk_id) left join ordered o using (request_id, chunk_id) left join fold on fold.request_id = g.request_id and fold.chunk_id = g.chunk_id)"""
_DONE = _done_sql(_FILTERS, 7000)
_MEMBER = _PLAN[_PLAN.index("member as (") : _PLAN.index("wanted as (")]

SQL = {
    "pr_hard_filters": f"""with {_BASE}, {_VECTOR}, {_FILTERS}, {_MEMBER} wanted as (select request_id, count(distinct kind) as n from hf group by 1)
select request_id, chunk_id, rank from tk_vector v left join wanted w using (request_id)
where n is null or n = (select count(distinct m.kind) from member m join hf on hf.kind = m.kind and hf.value = m.value where m.chunk_id = v.chunk_id and hf.request_id = v.request_id)""",
    "tk_vector": f"with {_BASE}, {_VECTOR} select * from tk_vector",
    "tk_fulltext": f"with {_BASE}, {_FULL} select * from tk_fulltext",
    "tk_trigram": f"with {_BASE}, {_TRGM} select * from tk_trigram",
    "qp_resolve_concepts": f"with {_BASE}, {_RESOLVE} select * from resolved",
    "ag_ambiguous": f"with {_BASE}, {_RESOLVE}, {_BEST_LEX} select request_id, count(*) as n, string_agg(cast(concept_id as varchar), ',' order by concept_id) as concept_ids from lex where place in (2, 3) group by 1 having count(*) > 1",
    "ag_strongest_match": f"with {_BASE}, {_RESOLVE}, {_BEST_LEX} select request_id, concept_id, (['EXACT_KEY', 'EXACT_NAME', 'EXACT_ALIAS', 'LEXICAL', 'TRIGRAM'])[place] as class, matched_text, score from lex",
    "st_hits_union": f"with {_BASE}, {_RESOLVE} select (['EXACT_KEY', 'EXACT_NAME', 'EXACT_ALIAS', 'LEXICAL', 'TRIGRAM'])[place] as class, count(*) as n, count(distinct request_id) as n_requests from hits group by 1",
    "tk_concept": f"with {_BASE}, {_RESOLVE}, {_CONCEPT} select * from tk_concept",
    "gr_expand": f"with {_BASE}, {_RESOLVE}, {_EXPAND}, {_hop(2)} select request_id, node, seed, seed_rank, hops, first_relation from (select * from layer1 union all select * from layer2)",
    "gr_paths": f"with {_BASE}, {_RESOLVE}, {_EXPAND}, {_hop(2)} select request_id, node, hops, path from (select * from layer1 union all select * from layer2)",
    "tk_graph": f"with {_BASE}, {_RESOLVE}, {_EXPAND}, {_GRAPH} select * from tk_graph",
    "st_channel_union": f"with {_CANDIDATES} select request_id, chunk_id, count(*) as n_channels, min(rank) as best_rank from cand group by 1, 2",
    "ag_channel_pivot": f"with {_MERGED} select request_id, chunk_id, {', '.join(f'coalesce({c}_rank, 0) as {c}_rank, {c}_score' for c in _CH)} from merged",
    "ag_rrf": f"with {_MERGED} select request_id, chunk_id, rrf from fused",
    "qp_reasons": f"""with {_MERGED} select request_id, chunk_id, concat_ws(',', case when vector_rank is not null then 'VECTOR_MATCH' end, case when fullText_rank is not null then 'FULL_TEXT_MATCH' end, case when trigram_rank is not null then 'TRIGRAM_MATCH' end, case when conceptLinked_rank is not null then 'DIRECT_CONCEPT_LINK' end, case when graphLinked_rank is not null then 'ONTOLOGY_CONCEPT_LINK' end) as reasons from merged""",
    "qp_retrieve": f"with recursive {_DONE} select request_id, chunk_id, item_id, final_rank, rrf, token_count from finished where final_code is null",
    "qp_exclusions": f"""with recursive {_DONE} select request_id, case when redacted then 'redacted' else cast(chunk_id as varchar) end as chunk_id,
  case when final_code in ('LIFECYCLE_NOT_PUBLISHED', 'OUTSIDE_EFFECTIVE_WINDOW') then 'lifecycle_filter' when final_code = 'AUTHORIZATION_NO_MATCH' then 'authorization' when final_code = 'APPLICABILITY_NO_MATCH' then 'applicability'
    when final_code = 'SELECTION_GROUP_NOT_SELECTED' then 'selection_groups' else 'packing' end as stage, final_code as code from finished where final_code is not null""",
    "qp_rankings": f"with recursive {_DONE} select request_id, chunk_id, final_rank, {', '.join(f'coalesce({c}_rank, 0) as {c}_rank' for c in _CH)}, final_code is null as packed from finished where final_rank is not null",
    "ag_funnel": f"""with recursive {_DONE}, c as (select request_id, coalesce(final_code, '') as k from finished)
select request_id, count(*) as merged, cast(count_if(k not in ('LIFECYCLE_NOT_PUBLISHED', 'OUTSIDE_EFFECTIVE_WINDOW')) as bigint) as alive, cast(count_if(k not in ('LIFECYCLE_NOT_PUBLISHED', 'OUTSIDE_EFFECTIVE_WINDOW', 'AUTHORIZATION_NO_MATCH')) as bigint) as authorized,
  cast(count_if(k not in ('LIFECYCLE_NOT_PUBLISHED', 'OUTSIDE_EFFECTIVE_WINDOW', 'AUTHORIZATION_NO_MATCH', 'APPLICABILITY_NO_MATCH')) as bigint) as applicable,
  cast(count_if(k in ('', 'PACKING_ITEM_CAP', 'PACKING_TOKEN_BUDGET')) as bigint) as selected, cast(count_if(k = '') as bigint) as packed from c group by 1""",
    "ag_token_total": f"with recursive {_DONE} select request_id, cast(sum(token_count) as bigint) as tokens, count(*) as n from finished where final_code is null group by 1",
    "qp_degrade": "select item_id as request_id, 'VECTOR_CHANNEL_UNAVAILABLE' as warning from benchmark where item_id % 5 = 4 union all select item_id, 'ONTOLOGY_CHANNEL_UNAVAILABLE' from benchmark where item_id % 8 = 3",
    "qp_profile": """select item_id as request_id, cast(case when item_id % 4 = 0 then (select count(*) from benchmark) else 60 end as int) as vector, cast(50 as int) as trigram,
  cast(case when item_id % 4 = 1 then 5 else 10 end as int) as max_chunks, cast(7000 as int) as max_tokens, case when item_id % 4 = 2 then 'PROFILE_NOT_FOUND' when item_id % 10 = 9 then 'INVALID_INPUT' end as error_code from benchmark""",
}
