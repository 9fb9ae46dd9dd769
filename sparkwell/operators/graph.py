"""Hierarchies and graphs by join loops; lineage is cut in the shared checkpoint folder every round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.operators.cuts import cut, forget, written


def closure(parents: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(ancestor, descendant, depth): every value with itself at 0 and all above it; cycles end where a pair repeats."""
    up = parents.select(F.col(child).alias("c"), F.col(parent).alias("p"))
    found = up.select(F.col("c").alias("ancestor"), F.col("c").alias("descendant")).distinct().withColumn("depth", F.lit(0))
    found, edge = cut(found), up.where("p IS NOT NULL").distinct()
    edge = cut(edge)
    front, depth = found, 0
    while not front.isEmpty():
        depth += 1
        step = front.join(edge, F.col("ancestor") == F.col("c")).select(F.col("p").alias("ancestor"), "descendant").distinct()
        front = cut(step.join(found, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        found = cut(found.unionByName(front))
    return found


#: Columns of 64 bits in a row of a walk; so many times 64 start keys share a row.
LANES = 4
#: Slices into which the nodes that one block reaches are dealt when their bits become rows.
SLICES = 8


def _numbered(seeds: DataFrame, key: list[str]) -> DataFrame:
    """(key..., block, lane, bit): a place for every key; those that start at neighbouring nodes share a block."""
    starts = seeds.groupBy(*key).agg(F.min("node").alias("first")).repartitionByRange("first", *key).sortWithinPartitions("first", *key)
    n = F.col("n")
    return written(starts.withColumn("n", F.monotonically_increasing_id()).select(*key, F.expr(f"n div {64 * LANES}").alias("block"), F.expr(f"int(n div 64 % {LANES})").alias("lane"), (n % 64).cast("int").alias("bit")))


def reachable(seeds: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key..., node) reachable from seeds(key..., node) over edges(source, target), seeds included.

    A row of the walk is a node with the bits of the keys of one block that reach it, so an edge is walked once a round
    for all of them. Each round carries on only bits that are new, and replaces what the one before has written. At the
    end rows of bits meet the keys of their lane and become rows of keys there, so those are never shuffled.
    """
    names = _numbered(seeds, key)
    lanes = [f"b{i}" for i in range(LANES)]
    either = lambda of: [F.bit_or(c).alias(c) for c in of]
    own = seeds.join(names, key).select("node", "block", *[F.when(F.col("lane") == i, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0)).cast("long").alias(c) for i, c in enumerate(lanes)])
    start = own.groupBy("node", "block").agg(*either(lanes))
    edge = written(edges.select("source", "target").distinct())
    state = written(start.select("*", *[F.col(c).alias(f"new_{c}") for c in lanes]))
    some = F.exists(F.array(*[f"new_{c}" for c in lanes]), lambda x: x != 0)
    while True:
        front = state.where(some).select(F.col("node").alias("source"), "block", *[F.col(f"new_{c}").alias(f"met_{c}") for c in lanes])
        step = front.join(edge.hint("merge"), "source").groupBy(F.col("target").alias("node"), "block").agg(*either([f"met_{c}" for c in lanes]))
        both = state.select("node", "block", *lanes).join(step, ["node", "block"], "full_outer")
        had, met = (lambda c: F.coalesce(c, F.lit(0).cast("long"))), (lambda c: F.coalesce(f"met_{c}", F.lit(0).cast("long")))
        last, state = state, written(both.select("node", "block", *[had(c).bitwiseOR(met(c)).alias(c) for c in lanes], *[met(c).bitwiseAND(F.bitwise_not(had(c))).alias(f"new_{c}") for c in lanes]))
        forget(last)
        if state.where(some).isEmpty():
            break
    forget(edge)
    bits = state.select("node", "block", F.posexplode(F.array(*lanes)).alias("lane", "bits")).where("bits <> 0").withColumn("slice", F.pmod(F.xxhash64("node"), F.lit(SLICES)))
    keys = F.array_sort(F.collect_list(F.struct("bit", F.struct(*key).alias("key"))))  # a lane's bits begin at 0, without a gap
    named = names.groupBy("block", "lane").agg(keys.alias("keys")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)).cast("array<bigint>")))
    met = bits.join(named, ["block", "lane", "slice"]).select("node", F.explode(F.expr("filter(keys, (x, i) -> getbit(bits, i) = 1)")).alias("x"))
    return met.select(*[F.col(f"x.key.{c}").alias(c) for c in key], "node")


def expand(seeds: DataFrame, edges: DataFrame, published: DataFrame, hops: int = 2, direction: str = "both") -> DataFrame:
    """Layered neighbours: (request_id, node, seed, seed_rank, hops, first_relation, path).

    seeds(request_id, node, seed_rank); edges(edge_id, source, relation, target); published(node). Both ends of an
    edge must be published. Within a layer a node keeps its first edge by (relation, edge id), takes over the seed of
    where it came from, and nodes of earlier layers are never entered again. Where both ends are on the frontier an
    edge is walked from its source.
    """
    # ids compress so well that Spark would broadcast them from their shuffle files, hence the hints; frontiers are
    # written, so that Spark knows them for the smaller side
    end = lambda name: published.select(F.col("node").alias(name)).hint("merge")
    live = written(edges.join(end("source"), "source", "left_semi").join(end("target"), "target", "left_semi").select("edge_id", "source", "relation", "target"))
    start = seeds.select("request_id", "node", F.col("node").alias("seed"), "seed_rank", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("first_relation"), F.array().cast("array<string>").alias("path"))
    found = front = written(start)
    for hop in range(1, hops + 1):
        walks = []
        if direction in ("outgoing", "both"):
            walks.append(front.join(live, F.col("node") == F.col("source")).withColumn("next", F.col("target")).withColumn("way", F.lit(">")))
        if direction in ("incoming", "both"):
            back = front.join(live, F.col("node") == F.col("target"))
            if direction == "both":  # an edge between two frontier nodes is walked from its source only
                back = back.join(front.select("request_id", F.col("node").alias("source")), ["request_id", "source"], "left_anti")
            walks.append(back.withColumn("next", F.col("source")).withColumn("way", F.lit("<")))
        walk = walks[0]
        for w in walks[1:]:
            walk = walk.unionByName(w)
        fresh = walk.join(found.select("request_id", F.col("node").alias("next")), ["request_id", "next"], "left_anti")
        order = Window.partitionBy("request_id", "next").orderBy("relation", "edge_id", "source", "target")
        step = fresh.withColumn("r", F.row_number().over(order)).where("r = 1").select(
            "request_id", F.col("next").alias("node"), "seed", "seed_rank", F.lit(hop).alias("hops"),
            F.coalesce("first_relation", "relation").alias("first_relation"),
            F.concat("path", F.array(F.concat(F.col("way"), "relation", F.lit(":"), F.col("next").cast("string")))).alias("path"),
        )
        front = written(step)
        found = found.unionByName(front)
    return found.where("hops > 0")


def neighbourhood(centres: DataFrame, relations: DataFrame, edges: DataFrame, domains: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """errors, concepts, edges and chunks around every centre of centres(request_id, node, depth, direction, domain), in one walk of two hops.

    relations(request_id, relation): which ones a request follows, all where it names none; direction is outgoing,
    incoming or both; edges(source, relation, target) whatever the status of their ends. A depth other than 1 or 2 is an
    error. Concepts (request_id, node, hops) are those of the domain, where one is given, by domains(node, domain); an
    edge that was walked stays when both its ends do, the centre's among them; chunks are those of links(node, chunk_id).
    """
    bad = ~F.coalesce(F.col("depth").isin(1, 2), F.lit(False))
    errors = centres.where(bad).select("request_id", F.lit("INVALID_INPUT").alias("code"))
    asked = cut(centres.where(~bad).select("request_id", "node", "depth", "direction", "domain"))
    wanted = relations.select("request_id", "relation").distinct()
    some = wanted.select("request_id").distinct().withColumn("some", F.lit(True))
    both = cut(edges.select("source", "relation", "target").distinct())
    terms = asked.join(some, "request_id", "left").select("request_id", "depth", "direction", F.coalesce("some", F.lit(False)).alias("some"))
    found = front = asked.select("request_id", "node", F.lit(0).alias("hops"))
    walked = None
    for hop in (1, 2):
        here = front.join(terms, "request_id").where(F.col("depth") >= hop).drop("hops", "depth")
        out = here.where("direction <> 'incoming'").join(both, F.col("node") == F.col("source")).withColumn("next", F.col("target"))
        back = here.where("direction <> 'outgoing'").join(both, F.col("node") == F.col("target")).withColumn("next", F.col("source"))
        step = out.unionByName(back)
        free = step.where("NOT some").unionByName(step.where("some").join(wanted, ["request_id", "relation"], "left_semi").select(step.columns))
        met = cut(free.select("request_id", "source", "relation", "target", "next").distinct())
        walked = met if walked is None else walked.unionByName(met)
        front = cut(met.select("request_id", F.col("next").alias("node")).distinct().join(found.select("request_id", "node"), ["request_id", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        found = found.unionByName(front)
    confined = found.where("hops > 0").join(asked.select("request_id", "domain"), "request_id")
    inside = confined.where("domain IS NOT NULL").join(domains.select("node", "domain").distinct(), ["node", "domain"], "left_semi")
    concepts = cut(confined.where("domain IS NULL").unionByName(inside.select(confined.columns)).select("request_id", "node", "hops"))
    seen = concepts.select("request_id", "node").unionByName(asked.select("request_id", "node"))
    end = lambda name: seen.withColumnRenamed("node", name)
    kept = walked.select("request_id", "source", "relation", "target").distinct().join(end("source"), ["request_id", "source"], "left_semi").join(end("target"), ["request_id", "target"], "left_semi").select("request_id", "source", "relation", "target")
    chunks = seen.join(links.select("node", "chunk_id"), "node").select("request_id", "chunk_id").distinct()
    return {"errors": errors, "concepts": concepts, "edges": kept, "chunks": chunks}


def broken(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(node, code, root, hops): nodes that cannot be used, and why.

    nodes(node, usable, and if there is one code) and edges(source, target, requirement); ends(node) may name more nodes.
    A node is gated when it is not usable (its own code, or NOT_USABLE) or not known (NOT_FOUND), and broken when it
    needs a broken one over a required edge (REQUIRED_DEPENDENCY_UNAVAILABLE). The cause travels backwards with the walk:
    root is the gated node that is fewest required edges away, the least of several; a gated node is its own.
    """
    must = cut(edges.where("requirement = 'required'").select("source", "target").distinct())
    every = edges.select(F.explode(F.array("source", "target")).alias("node"))
    every = (every if ends is None else every.unionByName(ends.select("node"))).distinct()
    own = F.col("code") if "code" in nodes.columns else F.lit(None).cast("string")
    known = every.join(nodes.select("node", "usable", own.alias("code")), "node", "left").where("usable IS NULL OR NOT usable")
    why = F.when(F.col("usable").isNull(), "NOT_FOUND").otherwise(F.coalesce("code", F.lit("NOT_USABLE")))
    front = cut(known.select("node", why.alias("code"), F.col("node").alias("root"), F.lit(0).alias("hops")))
    found, hops = front, 0
    while not front.isEmpty():
        hops += 1
        step = front.select(F.col("node").alias("target"), "root").join(must, "target").groupBy(F.col("source").alias("node")).agg(F.min("root").alias("root"))
        front = cut(step.join(found, "node", "left_anti").select("node", F.lit("REQUIRED_DEPENDENCY_UNAVAILABLE").alias("code"), "root", F.lit(hops).alias("hops")))
        found = found.unionByName(front)
    return cut(found)


#: What a walk has found out of a node: it is considered, included, required.
SEEN, INCLUDED, REQUIRED = 1, 2, 4


def dependency_closure(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, edge statuses) of dependencies for every request.

    seeds(request_id, node, required), nodes(node, usable and perhaps code), edges(source, target, requirement). A node
    is unusable when it is gated or unknown, or reaches a such one over required edges; its code and root tell why (see
    broken). Included: reachable from usable seeds over usable nodes; required: the same over required edges from
    required seeds. The three are found in one walk, whose rows carry what is new of a node. The cause of an edge is the
    root of its target, where that is unusable.
    """
    edges = cut(edges.select("source", "target", "requirement").distinct())
    bad = broken(nodes, edges, seeds)
    ids = bad.select("node")
    open_ = F.col("s_bad").isNull() & F.col("t_bad").isNull()
    marked = edges.join(ids.select(F.col("node").alias("source"), F.lit(True).alias("s_bad")), "source", "left").join(ids.select(F.col("node").alias("target"), F.lit(True).alias("t_bad")), "target", "left")
    ways = cut(marked.select("source", "target", (F.lit(SEEN) + F.when(open_, INCLUDED).otherwise(0) + F.when(open_ & (F.col("requirement") == "required"), REQUIRED).otherwise(0)).alias("way")))
    start = seeds.join(ids.withColumn("bad", F.lit(True)), "node", "left").groupBy("request_id", "node").agg(F.max(F.when(F.col("bad"), SEEN).when(F.col("required"), SEEN + INCLUDED + REQUIRED).otherwise(SEEN + INCLUDED)).alias("bits"))
    state = cut(start.withColumn("fresh", F.col("bits")))
    while True:
        front = state.where("fresh <> 0").select("request_id", F.col("node").alias("source"), "fresh")
        step = front.join(ways, "source").groupBy("request_id", F.col("target").alias("node")).agg(F.bit_or(F.col("fresh").bitwiseAND(F.col("way"))).alias("met"))
        both = state.select("request_id", "node", "bits").join(step, ["request_id", "node"], "full_outer")
        had, met = F.coalesce("bits", F.lit(0)), F.coalesce("met", F.lit(0))
        state = cut(both.select("request_id", "node", had.bitwiseOR(met).alias("bits"), met.bitwiseAND(F.bitwise_not(had)).alias("fresh")))
        if state.where("fresh <> 0").isEmpty():
            break
    flag = lambda bit: F.col("bits").bitwiseAND(F.lit(bit)) != 0
    verdict = state.join(bad, "node", "left").select("request_id", "node", F.col("root").isNull().alias("usable"), (F.coalesce("hops", F.lit(1)) > 0).alias("own_gate"), flag(INCLUDED).alias("included"), flag(REQUIRED).alias("required"), "code", "root")
    verdict = cut(verdict)
    src = verdict.select("request_id", F.col("node").alias("source"), F.col("included").alias("source_in"))
    tgt = verdict.select("request_id", F.col("node").alias("target"), F.col("usable").alias("target_ok"), F.col("root").alias("cause"))
    status = (
        F.when(F.col("target_ok") & F.col("source_in"), "INCLUDED")
        .when(~F.col("target_ok") & (F.col("requirement") == "required"), "UNAVAILABLE")
        .when(~F.col("target_ok"), "OPTIONAL_OMITTED")
        .otherwise("BLOCKED_BY_DEPENDENCY")
    )
    resolved = edges.join(src, "source").join(tgt, ["request_id", "target"]).select("request_id", "source", "target", "requirement", status.alias("status"), "cause")
    return verdict, resolved


#: A first peeling ends with a round that takes less than this part of the edges: what it leaves is found by colours.
WORTH = 0.05


def _peeled(edges: DataFrame, worth: float = 0.0) -> DataFrame:
    """Edges without those that no cycle can hold: of nodes that nothing enters or leaves, round by round, while a round takes more than `worth` of them."""
    left, n = edges, edges.count()
    while n:
        left = written(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi"))
        was, n = n, left.count()
        if was - n <= worth * was:
            break
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges(source, target) that reach each other with some other node; the component is its largest node.

    Round by round, every node takes the largest node that reaches it; those of one such colour that reach back to it
    are a component, and go. No table grows beyond nodes and edges, whatever the sizes of components. Only nodes whose
    colour has changed send it on; they are written, so few of them are broadcast and the edges stay where they are.
    """
    left = _peeled(written(edges.select("source", "target").where("source <> target").distinct()), WORTH)
    found = None
    while not left.isEmpty():
        colour = left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node"))
        colour = front = written(colour)
        while True:
            over = front.select(F.col("node").alias("source"), F.col("colour").alias("by")).join(left, "source").groupBy(F.col("target").alias("node")).agg(F.max("by").alias("by"))
            front = written(colour.join(over, "node").where("by > colour").select("node", F.col("by").alias("colour")))
            if front.isEmpty():
                break
            colour = written(colour.join(front.withColumnRenamed("colour", "by"), "node", "left").select("node", F.coalesce("by", "colour").alias("colour")))
        ends = left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("a")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("b")), "target")
        inside = written(ends.where("a = b").select("source", "target", F.col("a").alias("component")))
        back = inside.select("component", F.col("target").alias("source"), F.col("source").alias("target"))
        seeds = inside.select("component").distinct().withColumn("node", F.col("component"))
        whole = _reach_within(seeds, back)
        found = whole if found is None else found.unionByName(whole)
        gone = whole.select("node")
        left = _peeled(written(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")))
    if found is None:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    return found.join(found.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component")


def _reach_within(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, node) reachable from seeds(component, node) over edges(component, source, target) of the same component."""
    found = front = written(seeds.select("component", "node").distinct())
    while True:
        step = front.withColumnRenamed("node", "source").join(edges, ["component", "source"]).select("component", F.col("target").alias("node")).distinct()
        front = written(step.join(found, ["component", "node"], "left_anti"))
        if front.isEmpty():
            return written(found)
        found = found.unionByName(front)


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle, a self dependency among them."""
    own = edges.where("source = target").select(F.col("source").alias("node"))
    return strong_components(edges).select("node").unionByName(own).distinct()


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(component, path): a shortest cycle through the largest node of every component, from it and back to it; of several the least."""
    inside = strong_components(edges)
    a, b = (inside.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component")) for end in ("source", "target"))
    live = cut(edges.select("source", "target").where("source <> target").distinct().join(a, "source").join(b, "target").where("source_component = target_component").select(F.col("source_component").alias("component"), "source", "target"))
    front = cut(inside.select("component", F.col("component").alias("node")).distinct().withColumn("path", F.array("node")))
    seen, done = front.select("component", "node"), None
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "source").join(live, ["component", "source"]).groupBy("component", "target").agg(F.min(F.concat("path", F.array("target"))).alias("path"))
        step = cut(step.withColumnRenamed("target", "node"))
        closed = step.where("node = component").select("component", "path")
        done = closed if done is None else done.unionByName(closed)
        front = cut(step.join(done.select("component"), "component", "left_anti").join(seen, ["component", "node"], "left_anti"))
        seen = cut(seen.unionByName(front.select("component", "node")))
    return done if done is not None else inside.select("component", F.array("node").alias("path")).limit(0)
