"""Sources, builds, checks, evaluations and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.catalog import model as M
from sparkwell.catalog import retrieval as Q
from sparkwell.catalog import rules as R
from sparkwell.functions import text as T
from sparkwell.operators import checks, graph
from sparkwell.operators.chunking import hard_split
from sparkwell.operators.cuts import written
from sparkwell.plans import build, evaluate, snapshot
from sparkwell.sources import corpus
from sparkwell.streaming import feeds


def _v1(s, d):
    i = M.items(s, d)
    return build.hashes(i.select(F.col("item_id").alias("id"), "title", "body", "lang", "source", "priority"))


def _v2(s, d):
    """The next revision: some documents dropped, edited, given a new priority, or added."""
    i = M.items(s, d).select(F.col("item_id").alias("id"), "title", "body", "lang", "source", "priority")
    k = F.col("id")
    old = i.where("id % 17 <> 0").withColumn("body", F.when(k % 13 == 0, F.concat("body", F.lit(" edited"))).otherwise(F.col("body"))).withColumn("priority", F.when(k % 11 == 0, F.col("priority") + 1).otherwise(F.col("priority")))
    new = i.where("id % 19 = 0").withColumn("id", k + 10_000_000)
    return build.hashes(old.unionByName(new))


def _actions(s, d):
    return build.plan(_v1(s, d), _v2(s, d))


def bd_hashes(s, d):
    return _v1(s, d).select("id", "source_hash", "semantic_hash", "compiled_hash")


def bd_plan(s, d):
    return _actions(s, d)


def _parts(rows):
    """The chunks of documents, children of their row."""
    return hard_split(rows.select("id", "body"), "body", M.CHUNK_LIMIT).select("id", "ordinal", "content")


def sink_apply_plan(s, d):
    """Both revisions as bucketed snapshots; the second writes the buckets it touches, chunks go and come with their document."""
    home = feeds.shared(s)
    v1, v2 = _v1(s, d), _v2(s, d)
    put = lambda actions, rows: snapshot.apply(s, home, actions, {"items": ("id", rows), "chunks": ("id", _parts(rows))}, buckets=32)
    put(v1.select("id", F.lit("upsert").alias("action")), v1)
    put(build.plan(snapshot.read(s, home, "items", v1.schema), v2), v2)
    items = snapshot.read(s, home, "items", v2.schema)
    chunks = snapshot.read(s, home, "chunks", _parts(v2).schema).groupBy("id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))
    return items.join(chunks, "id").select("id", "priority", F.md5("body").alias("body_md5"), "n_chunks", "n_chars")


def bd_apply(s, d):
    state = M.table(s, d, "nation").select(F.concat(F.lit("ns"), F.col("n_regionkey").cast("string")).alias("namespace"), F.col("n_name").alias("environment"), F.lit(1).alias("revision"), F.lit("active").alias("status"))
    return build.revisions(state, "ns1")


def bd_verify(s, d):
    a = _actions(s, d)
    return build.verify(build.apply(_v1(s, d), _v2(s, d), a), a)


def bd_equivalence(s, d):
    inc = build.apply(_v1(s, d), _v2(s, d), _actions(s, d)).select("id", "compiled_hash", "semantic_hash")
    return build.differences(inc, _v2(s, d).select("id", "compiled_hash", "semantic_hash")).agg(F.count("*").alias("n_different"))


def bd_embed_work(s, d):
    return build.embed_work(_v1(s, d), _v2(s, d)).select("id")


def _measured(texts):
    """A provider for the store: length, bytes and words of a text."""
    return [[float(len(t)), float(len(t.encode())), float(len(t.split()))] for t in texts]


def bd_vector_store(s, d):
    """Vectors of the second revision: those of texts that the first had are taken from the store."""
    text = T.joined_lines(F.col("title"), F.col("body")).alias("semantic_text")
    v1, v2 = (rows.select("id", "semantic_hash", text) for rows in (_v1(s, d), _v2(s, d)))
    store = s.createDataFrame([], "config_hash string, semantic_hash string, vector array<double>")
    other = v1.where("id % 2 = 0").select(F.lit("other").alias("config_hash"), "semantic_hash", F.array(F.lit(0.0)).alias("vector"))  # made under another configuration
    store = store.unionByName(build.semantic_vectors(v1, store, "lengths", _measured, 3)[1]).unionByName(other)
    got = build.semantic_vectors(v2, store, "lengths", _measured, 3)[0]
    return got.select("id", "reused", F.element_at("vector", 1).cast("long").alias("length"), F.element_at("vector", 2).cast("long").alias("bytes"))


def jn_anti_deletes(s, d):
    return _v1(s, d).select("id").join(_v2(s, d).select("id"), "id", "left_anti")


def _orders(s, d):
    """Orders with some customers that do not exist."""
    return M.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("cust"), "o_orderstatus")


def dq_unique(s, d):
    return checks.unique(M.table(s, d, "part"), ["p_brand", "p_name", "p_size"], "DUPLICATE_KEY")


def dq_refs(s, d):
    return checks.references(_orders(s, d), "o_orderkey", "cust", M.table(s, d, "customer"), "c_custkey", "REFERENCE_NOT_FOUND")


def dq_ref_suggestions(s, d):
    """References to parts by name and to suppliers by name: some misspelt, some naming the other kind."""
    p, sup = M.table(s, d, "part"), M.table(s, d, "supplier")
    targets = p.select(F.col("p_name").alias("key"), F.lit("part").alias("kind")).unionByName(sup.select(F.col("s_name").alias("key"), F.lit("supplier").alias("kind")))
    k = F.col("p_partkey")
    ref = F.when(k % 5 == 0, F.expr("concat(substr(p_name, 1, 1), substr(p_name, 3))")).when(k % 5 == 1, F.lit("no part is called like this")).otherwise(F.col("p_name"))
    rows = p.select(F.concat(F.lit("p"), k.cast("string")).alias("subject"), ref.alias("ref"), F.when(k % 7 == 0, "supplier").otherwise("part").alias("kind"))
    return checks.reference_faults(rows, targets).select("subject", "ref", "code", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def _bad_nodes(s, d):
    """The rules with a fault by the number of their brand: see PLANTED."""
    n = R.nodes(s, d).withColumn("k", F.regexp_extract("rule_id", r"(\d+)", 1).cast("int") % 10)
    n = n.where("k <> 9 OR node_id < 6")
    column = {c: F.col(c) for c in ("dim_key", "op", "operands")}
    for k, node, c, value in _planted():
        column[c] = F.when((F.col("node_id") == node) & (F.col("k") == k), value).otherwise(column[c])
    return n.withColumns(column).drop("k")


def _texts(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _planted():
    """(brand number modulo ten, node, column, value): an unknown dimension, an operator that the dimension does not take,
    an empty list, a value that is not registered or no number, bounds the wrong way round, an operand too many, a single
    operator on a multi dimension, no operand."""
    none = F.lit(None).cast("array<string>")
    return [
        (1, 1, "dim_key", F.lit("colour")), (2, 4, "op", F.lit("gt")), (3, 8, "operands", _texts()), (4, 1, "operands", _texts("ATLANTIS")), (5, 3, "operands", _texts("plenty")),
        (6, 3, "op", F.lit("between")), (6, 3, "operands", _texts("10", "5")), (7, 3, "op", F.lit("exists")), (8, 6, "op", F.lit("equals")), (0, 4, "operands", none),
    ]


def dq_rules(s, d):
    """Faults planted in the rules of parts; rules of every fourth kind of part grant access, by a dimension that describes."""
    dims = R.dimensions(s).withColumn("category", F.when(F.col("dim_key") == "segment", "descriptive").otherwise("applicability"))
    grants = M.table(s, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("n")).where("n % 4 = 0").select(F.concat_ws("/", "p_brand", "p_type").alias("rule_id"))
    found = checks.rule_faults(_bad_nodes(s, d), dims, R.registry(s, d)[0], grants)
    return found.groupBy("code", "severity", "reason").agg(F.count("*").alias("n"), F.min("subject").alias("first"))


def dq_groups(s, d):
    p = M.table(s, d, "part")
    members = p.select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("grp"), F.col("p_type").alias("kind"))
    groups = p.groupBy(F.col("p_brand").alias("grp")).agg(F.min_by("p_type", "p_partkey").alias("group_kind"))
    return checks.group_kinds(members, groups)


def _status(s, d):
    return M.concepts(s, d).select(F.col("concept_id").alias("node"), "status")


def dq_lifecycle_deps(s, d):
    return checks.lifecycle_dependencies(M.tool_edges(s, d), _status(s, d))


def dq_self_and_cycles(s, d):
    """Every edge between parts, and some parts that depend on themselves."""
    e = M.edges(s, d).select("source", "target").distinct()
    own = M.table(s, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("node"))
    circles = checks.faults(graph.strong_components(e), F.col("node"), "TOOL_DEPENDENCY_CYCLE")
    return circles.unionByName(checks.faults(own, F.col("node"), "TOOL_SELF_DEPENDENCY"))


def dq_name_collision(s, d):
    c = M.concepts(s, d)
    return checks.name_collisions(c.select("concept_id", "name").unionByName(c.select("concept_id", F.col("alias").alias("name"))))


def dq_domain_values(s, d):
    i = M.items(s, d)
    status = checks.allowed(_orders(s, d), "o_orderkey", "o_orderstatus", ["O", "F"], "INVALID_STATUS")
    life = checks.allowed(i.select("item_id", F.when(F.col("item_id") % 90 == 1, "retired").otherwise(F.col("status")).alias("status")), "item_id", "status", ["draft", "published", "deprecated"], "INVALID_LIFECYCLE")
    mode = checks.allowed(M.table(s, d, "part"), "p_partkey", "p_type", MODES, "INVALID_MODE")
    return status.unionByName(life).unionByName(mode).unionByName(checks.window_order(i, "item_id", "effective_from", "effective_to"))


#: Types that stand for the modes a group may have.
MODES = ["SMALL", "LARGE", "MEDIUM", "ECONOMY"]


def dq_summary(s, d):
    return checks.summary(dq_unique(s, d).unionByName(dq_refs(s, d)).unionByName(dq_name_collision(s, d)).unionByName(dq_domain_values(s, d)))


def _cases(s, d):
    """Two documents per request as expectations: those that hold its first words, and the request's own number."""
    r = M.requests(s, d)
    base = r.select(F.col("request_id").alias("case_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), ((F.col("request_id") * m) * M.STRIDE).alias("ref_a"), ((F.col("request_id") * m + 1) * M.STRIDE).alias("ref_b"), F.lit(w).alias("within")) for k, m, w in (("include", 1, 0), ("exclude", 3, 0), ("topk", 1, 3), ("outranks", 1, 0))])).alias("x"))
    named = r.select(F.col("request_id").alias("case_id"), F.lit("resolved").alias("kind"), ((13 * F.col("request_id")) % M.table(s, d, "part").count()).alias("ref_a"), F.lit(-1).cast("long").alias("ref_b"), F.lit(0).alias("within"))
    return base.select("case_id", "x.*").unionByName(named)


def _results(s, d):
    got = Q.qp_retrieve(s, d).select(F.col("request_id").alias("case_id"), F.col("chunk_id").alias("ref"), F.col("final_rank").alias("rank"))
    named = Q.qp_resolve_concepts(s, d).select(F.col("request_id").alias("case_id"), F.col("concept_id").alias("ref"))
    return evaluate.assertions(_cases(s, d), graph.cut(got), graph.cut(named))


def ev_retrieval(s, d):
    return _results(s, d).select("case_id", "kind", "passed")


def ev_report(s, d):
    return evaluate.report(_results(s, d))


def ev_assembly(s, d):
    """A case per request: its first seed should be included among the tools, and another part not."""
    from sparkwell.catalog import assembly

    got = assembly.gr_dep_closure(s, d).where("included").select(F.col("request_id").alias("case_id"), F.col("node").alias("ref"), F.lit(1).alias("rank"))
    n = M.table(s, d, "part").count()
    r = M.requests(s, d).select(F.col("request_id").alias("case_id"), ((13 * F.col("request_id")) % n).alias("yes"), ((17 * F.col("request_id") + 5) % n).alias("no"))
    none = F.lit(-1).cast("long").alias("ref_b")
    want = r.select("case_id", F.lit("include").alias("kind"), F.col("yes").alias("ref_a"), none, F.lit(0).alias("within")).unionByName(r.select("case_id", F.lit("exclude").alias("kind"), F.col("no").alias("ref_a"), none, F.lit(0).alias("within")))
    return evaluate.assertions(want, graph.cut(got)).select("case_id", "kind", "passed")


def ev_refs(s, d):
    return evaluate.references(M.chunks(s, d))


def _authored(s, d):
    """Documents as authored files in the shared folder: JSON with comments, at most 200 entities each."""
    home = feeds.shared(s)
    one = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "n_chars", F.concat("source", F.lit(',] "q\\" // {,} /* x')).alias("note")))
    # a file costs as much whatever its size, so the number of tasks that write them isn't left to the size of what is shuffled
    docs = M.table(s, d, "documents").withColumn("b", F.expr("doc_id div 200")).repartition(4 * s.sparkContext.defaultParallelism, "source", "b")
    groups = docs.groupBy("source", "b").agg(F.array_join(F.array_sort(F.collect_list(one)), ",\n").alias("rows"))
    files = groups.select(F.concat(F.lit("// entities, \"all\" of them\n["), "rows", F.lit(", /* the last, ] */\n]\n")).alias("value"), F.concat(F.lit("knowledge-"), "source").alias("folder"))
    # tasks put their files in place themselves, else the driver moves one after the other; nothing reads the folder before all are done
    files.write.partitionBy("folder").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(home)
    return corpus.read_corpus(s, home, {"folder=knowledge-src1": "first", "folder=knowledge-": "other"})


def src_corpus(s, d):
    return _authored(s, d).groupBy("kind").agg(F.count("*").alias("n_files"))


def src_entities(s, d):
    e = corpus.read_entities(_authored(s, d), "struct<id:bigint,lang:string,n_chars:bigint,note:string>")
    return e.select("kind", "id", "lang", "n_chars", "note")


def src_documents(s, d):
    """Documents as files with front matter; some lack a fence, some have no JSON there."""
    i = F.col("doc_id")
    front = F.when(i % 13 == 0, F.lit("lang = en")).otherwise(F.concat(F.to_json(F.struct(i.alias("id"), "lang")), F.lit(" // a comment")))
    first, last = F.when(i % 17 == 0, "").otherwise(" --- \n"), F.when(i % 19 == 0, "").otherwise("---\r\n")
    files = M.table(s, d, "documents").select(i.cast("string").alias("path"), F.lit("document").alias("kind"), F.concat(first, front, F.lit("\n"), last, F.coalesce("text", F.lit(""))).alias("text"))
    got = corpus.read_documents(files, "struct<id:bigint,lang:string>")
    return got.select(F.col("path").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"), F.coalesce("body_line", F.lit(-1)).alias("body_line"), F.coalesce("code", F.lit("")).alias("code"))


def sm_ingest(s, d):
    """Events as a feed of several micro-batches; a user whose newest event is an error is gone."""
    home, events = feeds.shared(s), M.table(s, d, "events")
    events.repartitionByRange(8, "event_id").write.parquet(f"{home}/feed")
    feed = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{home}/feed")
    return feeds.ingest(feed, home, "user_id", "event_id", ["user_id", "event_id", "event_type", "value"], F.col("event_type") == "error", 16)


def sm_metrics(s, d):
    return feeds.metric_windows(s, f"{d}/event[s].parquet", M.table(s, d, "events").schema)


QUERIES = {f.__name__: f for f in (bd_hashes, bd_plan, sink_apply_plan, bd_apply, bd_verify, bd_equivalence, bd_embed_work, bd_vector_store, jn_anti_deletes, dq_unique, dq_refs, dq_ref_suggestions, dq_rules, dq_groups, dq_lifecycle_deps, dq_self_and_cycles, dq_name_collision, dq_domain_values, dq_summary, ev_retrieval, ev_report, ev_assembly, ev_refs, src_corpus, src_entities, src_documents, sm_ingest, sm_metrics)}

_V = f"""{M.ITEMS}, v1 as (select item_id as id, title, body, lang, source, priority from items),
v2 as (
  select id, title, case when id % 13 = 0 then body || ' edited' else body end as body, lang, source, cast(case when id % 11 = 0 then priority + 1 else priority end as int) as priority from v1 where id % 17 <> 0
  union all select id + 10000000, title, body, lang, source, priority from v1 where id % 19 = 0)"""
_ORD = "ord as (select o_orderkey, case when o_orderkey % 97 = 0 then -o_custkey - 1 else o_custkey end as cust, o_orderstatus from orders)"
_UNIQUE = "select 'DUPLICATE_KEY' as code, 'error' as severity, p_brand || '/' || p_name || '/' || cast(p_size as varchar) as subject from part group by p_brand, p_name, p_size having count(*) > 1"
_REFS = "select 'REFERENCE_NOT_FOUND' as code, 'error' as severity, cast(o_orderkey as varchar) as subject from ord where cust not in (select c_custkey from customer)"
_NAMES = "select 'CONCEPT_NAME_COLLISION' as code, 'warning' as severity, name as subject from (select concept_id, name from concepts union all select concept_id, alias from concepts) group by name having count(distinct concept_id) > 1"
_DOMAIN = f"""select 'INVALID_STATUS' as code, 'error' as severity, cast(o_orderkey as varchar) as subject from ord where o_orderstatus not in ('O', 'F')
union all select 'INVALID_LIFECYCLE', 'error', cast(item_id as varchar) from items where item_id % 90 = 1
union all select 'INVALID_MODE', 'error', cast(p_partkey as varchar) from part where p_type not in ({', '.join(f"'{m}'" for m in MODES)})
union all select 'INVALID_EFFECTIVE_WINDOW', 'error', cast(item_id as varchar) from items where effective_to < effective_from"""
_EV = f"""{Q._DONE}, dl as (select request_id as case_id, chunk_id as ref, final_rank as rank from finished where final_code is null),
xp as (select request_id as case_id, unnest([{{'kind': 'include', 'm': 1}}, {{'kind': 'exclude', 'm': 3}}, {{'kind': 'topk', 'm': 1}}, {{'kind': 'outranks', 'm': 1}}]) as x from requests),
rs as (
  select xp.case_id, x.kind as kind, coalesce(case x.kind when 'include' then a.rank is not null when 'exclude' then a.rank is null when 'topk' then a.rank <= 3 else a.rank < b.rank end, false) as passed
  from xp left join dl a on a.case_id = xp.case_id and a.ref = xp.case_id * x.m * {M.STRIDE} left join dl b on b.case_id = xp.case_id and b.ref = (xp.case_id * x.m + 1) * {M.STRIDE}
  union all select request_id, 'resolved', (request_id, (13 * request_id) % (select count(*) from part)) in (select (request_id, concept_id) from resolved) from requests)"""

from sparkwell.catalog import assembly as _A  # noqa: E402

SQL = {
    "bd_hashes": f"with {_V} select id, sha256(to_json({{'body': body, 'lang': lang, 'source': source, 'title': title}})) as source_hash, sha256(array_to_string(list_filter([trim(title, ' '), trim(body, ' ')], lambda x: x <> ''), chr(10))) as semantic_hash, sha256(to_json({{'body': body, 'lang': lang, 'priority': priority, 'source': source, 'title': title}})) as compiled_hash from v1",
    "bd_plan": f"""with {_V} select coalesce(a.id, b.id) as id, case when b.id is null then 'delete' else 'upsert' end as action from v1 a full join v2 b on a.id = b.id
where a.id is null or b.id is null or a.body <> b.body or a.priority <> b.priority""",
    "sink_apply_plan": f"with {_V} select id, priority, md5(body) as body_md5, cast(greatest(1, ceil(length(body) / {M.CHUNK_LIMIT}.0)) as bigint) as n_chunks, length(body) as n_chars from v2",
    "bd_apply": """with st as (select 'ns' || cast(n_regionkey as varchar) as namespace, n_name as environment from nation)
select namespace, environment, cast(1 as int) as revision, case when namespace = 'ns1' then 'superseded' else 'active' end as status from st union all select namespace, environment, 2, 'active' from st where namespace = 'ns1'""",
    "bd_verify": "select cast(0 as bigint) as n_missing, cast(0 as bigint) as n_left",
    "bd_equivalence": "select cast(0 as bigint) as n_different",
    "bd_embed_work": f"with {_V}, h as (select id, trim(title, ' ') || chr(10) || trim(body, ' ') as t from v2), o as (select trim(title, ' ') || chr(10) || trim(body, ' ') as t from v1) select min(id) as id from h where t not in (select t from o) group by t",
    "bd_vector_store": f"with {_V}, o as (select trim(title, ' ') || chr(10) || trim(body, ' ') as t from v1), n as (select id, array_to_string(list_filter([trim(title, ' '), trim(body, ' ')], lambda x: x <> ''), chr(10)) as t from v2), k as (select array_to_string(list_filter([trim(title, ' '), trim(body, ' ')], lambda x: x <> ''), chr(10)) as t from v1) select id, t in (select t from k) as reused, length(t) as length, cast(strlen(t) as bigint) as bytes from n",
    "jn_anti_deletes": f"with {_V} select id from v1 where id not in (select id from v2)",
    "dq_unique": _UNIQUE,
    "dq_refs": f"with {_ORD} {_REFS}",
    "dq_ref_suggestions": """with t as (select p_name as key, 'part' as kind from part union select s_name, 'supplier' from supplier),
r as (select 'p' || cast(p_partkey as varchar) as subject, case p_partkey % 5 when 0 then substr(p_name, 1, 1) || substr(p_name, 3) when 1 then 'no part is called like this' else p_name end as ref, case when p_partkey % 7 = 0 then 'supplier' else 'part' end as kind from part),
l as (select * from r where not exists (select 1 from t where t.key = ref and t.kind = r.kind)),
c as (select *, case when ref in (select key from t) then 'REFERENCE_TYPE_MISMATCH' else 'REFERENCE_NOT_FOUND' end as code from l),
n as (select ref, kind, key from (select distinct ref, kind from c where code = 'REFERENCE_NOT_FOUND') a join t using (kind) where levenshtein(ref, key) <= greatest(2, length(ref) / 3.0) qualify row_number() over (partition by ref, kind order by levenshtein(ref, key), key) = 1)
select subject, ref, code, coalesce(key, '') as suggestion from c left join n on n.ref = c.ref and n.kind = c.kind and code = 'REFERENCE_NOT_FOUND'""".replace("select subject, ref, code", "select subject, c.ref as ref, code"),
    "dq_rules": """with r as (select p_brand || '/' || p_type as rule, cast(regexp_extract(p_brand, '(\\d+)', 1) as int) % 10 as k, min(p_partkey) as n from part group by p_brand, p_type),
f as (
  select rule || '#/allOf/0' as subject, 'UNKNOWN_DIMENSION' as code, 'error' as severity, 'UNKNOWN_DIMENSION' as reason from r where k = 1
  union all select rule || '#/allOf/1/anyOf/1', 'INVALID_OPERATOR_FOR_DIMENSION', 'error', unnest(['NOT_ALLOWED', 'NEEDS_ORDER']) from r where k = 2
  union all select rule || '#/allOf/2/noneOf/' || (case when n % 2 = 0 then '1' else '0' end) || '/allOf/0', 'INVALID_EXPRESSION', 'error', 'WRONG_SHAPE' from r where k = 3
  union all select rule || '#/allOf/0/value/0', 'DIMENSION_VALUE_NOT_FOUND', 'error', 'WRONG_VALUE' from r where k = 4
  union all select rule || '#/allOf/1/anyOf/0/value/0', 'INVALID_FIELD_TYPE', 'error', 'WRONG_VALUE' from r where k = 5
  union all select rule || '#/allOf/1/anyOf/0', 'INVALID_EXPRESSION', 'error', 'REVERSED_BOUNDS' from r where k = 6
  union all select rule || '#/allOf/1/anyOf/0', 'INVALID_EXPRESSION', 'error', 'VALUE_FORBIDDEN' from r where k = 7
  union all select rule || '#/allOf/2/noneOf/0', 'INVALID_OPERATOR_FOR_DIMENSION', 'error', unnest(['NOT_ALLOWED', 'NEEDS_SINGLE']) from r where k = 8 and n % 2 = 0
  union all select rule || '#/allOf/2/noneOf/0', 'INVALID_EXPRESSION', 'error', 'WRONG_SHAPE' from r where k = 8 and n % 2 = 0
  union all select rule || '#/allOf/2', 'INVALID_EXPRESSION', 'error', 'EMPTY_GROUP' from r where k = 9
  union all select rule || '#/allOf/1/anyOf/1', 'INVALID_EXPRESSION', 'error', 'VALUE_MISSING' from r where k = 0
  union all select rule || '#/allOf/2/noneOf/0', 'UNSAFE_AUTHORIZATION_MISSING_BEHAVIOR', 'error', 'SKIPPED_WHEN_MISSING' from r where n % 4 = 0 and k <> 9
  union all select rule || '#/allOf/1/anyOf/1', 'SUSPICIOUS_DIMENSION_CATEGORY_USAGE', 'warning', 'CATEGORY' from r where n % 4 = 0)
select code, severity, reason, count(*) as n, min(subject) as first from f group by 1, 2, 3""",
    "dq_groups": "with g as (select p_brand, arg_min(p_type, p_partkey) as k from part group by 1) select 'SELECTION_GROUP_TYPE_MISMATCH' as code, 'error' as severity, cast(p_partkey as varchar) as subject from part join g using (p_brand) where p_type <> k",
    "dq_lifecycle_deps": f"""with {M.TOOL_EDGES}, {M.CONCEPTS} select 'INVALID_LIFECYCLE_DEPENDENCY' as code, 'error' as severity, cast(source as varchar) || '->' || cast(target as varchar) as subject
from tool_edges join concepts a on a.concept_id = source and a.status = 'published' join concepts b on b.concept_id = target and b.status <> 'published'""",
    # the component of one busy node first, then all with all in what it leaves
    "dq_self_and_cycles": f"""with recursive {M.EDGES}, e as materialized (select distinct source, target from edges), hub as (select source as node from e group by source order by count(*) desc, source limit 1),
fw as (select node from hub union select target from fw join e on node = source), bw as (select node from hub union select source from bw join e on node = target),
core as materialized (select node from fw intersect select node from bw), rest as materialized (select source, target from e where source not in (select node from core) and target not in (select node from core)),
r as (select source as origin, target as node from rest union select origin, target from r join rest on source = node),
c as (select node from core where (select count(*) from core) > 1 union select node from r where origin = node)
select 'TOOL_DEPENDENCY_CYCLE' as code, 'error' as severity, cast(node as varchar) as subject from c
union all select 'TOOL_SELF_DEPENDENCY', 'error', cast(p_partkey as varchar) from part where p_size = 7""",
    "dq_name_collision": f"with {M.CONCEPTS} {_NAMES}",
    "dq_domain_values": f"with {_ORD}, {M.ITEMS} {_DOMAIN}",
    "dq_summary": f"with {_ORD}, {M.CONCEPTS}, {M.ITEMS} select severity, count(*) as n from ({_UNIQUE} union all {_REFS} union all {_NAMES} union all {_DOMAIN}) group by 1",
    "ev_retrieval": f"with recursive {_EV} select case_id, kind, passed from rs",
    "ev_report": f"with recursive {_EV} select kind, cast(count_if(passed) as bigint) as n_passed, cast(count_if(not passed) as bigint) as n_failed, coalesce(string_agg(case when not passed then cast(case_id as varchar) end, ',' order by case_id), '') as failed_cases from rs group by 1",
    "ev_assembly": f"""with recursive {_A._closure_sql(_A._SEEDS)}, b as (select item_id as case_id, (13 * item_id) % n as yes, (17 * item_id + 5) % n as no from benchmark, (select count(*) as n from part))
select case_id, 'include' as kind, (case_id, yes) in (select (request_id, node) from included) as passed from b union all select case_id, 'exclude', (case_id, no) not in (select (request_id, node) from included) from b""",
    "ev_refs": f"with {M.CHUNKS} select cast(item_id as varchar) || '#' || case when part_key = '' then 'intro' else part_key end as ref, chunk_id from chunks",
    "src_corpus": "select case when source like 'src1%' then 'first' else 'other' end as kind, count(distinct source || '/' || cast(doc_id // 200 as varchar)) as n_files from documents group by 1",
    "src_entities": """select case when source like 'src1%' then 'first' else 'other' end as kind, doc_id as id, lang, n_chars, source || ',] "q\\" // {,} /* x' as note from documents""",
    "src_documents": """with c as (select *, case when doc_id % 17 = 0 then 'MISSING_OPENING_FENCE' when doc_id % 19 = 0 then 'MISSING_CLOSING_FENCE' when doc_id % 13 = 0 then 'INVALID_JSON' else '' end as code from documents)
select doc_id, case when code = '' then lang else '' end as lang, md5(case when code in ('', 'INVALID_JSON') then text else '' end) as body_md5, cast(case when code in ('', 'INVALID_JSON') then 4 else -1 end as int) as body_line, code from c""",
    "sm_ingest": "select * from (select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1) where event_type <> 'error'",
    "sm_metrics": """select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total, max(value) as most, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events
where time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select date_trunc('millisecond', max(ts)) - interval '10 minutes' from events) group by 1, 2""",
}
