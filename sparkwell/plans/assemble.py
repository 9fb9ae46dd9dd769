"""Assembly for a batch of requests: discover, gate, choose within groups, close over dependencies, budget, render."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.operators import fusion, graph

#: Ceilings of every request.
CEILINGS = {"skills": 32, "tools": 64, "prompt_tokens": 32768, "bootstrap_tokens": 4096}


def discover(semantic: DataFrame, linked: DataFrame) -> DataFrame:
    """(request_id, kind, entity_id, score, rank, reasons): semantic hits and concept-linked ones of every kind; a link alone has no score."""
    by = ["request_id", "kind", "entity_id"]
    both = semantic.select(*by, "score", "rank").join(linked.select(*by).distinct().withColumn("linked", F.lit(True)), by, "full_outer")
    why = F.concat_ws(",", F.when(F.col("rank").isNotNull(), "VECTOR_MATCH"), F.when(F.col("linked"), "DIRECT_CONCEPT_LINK"))
    return both.select(*by, "score", "rank", why.alias("reasons"))


def gates(found: DataFrame) -> DataFrame:
    """found(status, authorized, applicable; null: no rule) plus code of the first gate that fails."""
    code = (
        F.when(F.col("status") != "published", "LIFECYCLE_NOT_PUBLISHED")
        .when(~F.coalesce("authorized", F.lit(True)), "AUTHORIZATION_NO_MATCH")
        .when(~F.coalesce("applicable", F.lit(True)), "APPLICABILITY_NO_MATCH")
    )
    return found.withColumn("code", code)


#: Fixed reason codes of fragments by how a template includes them.
INCLUSION = {"always": "TEMPLATE_FRAGMENT", "applicable": "APPLICABLE_FRAGMENT", "task_relevant": "TASK_RELEVANT_FRAGMENT"}


def merge_fragments(template: DataFrame, task: DataFrame, skills: DataFrame, fragments: DataFrame) -> DataFrame:
    """(request_id, fragment, sources, reasons, late): fragments of three sources merged.

    template(request_id, fragment), task(request_id, fragment) found by relevance, skills(request_id, fragment, skill) of
    selected skills, fragments(fragment, inclusion). A task brings only what the template does not have; late tells
    fragments that skills alone brought.
    """
    kind: Column = F.lit(None).cast("string")
    for k, v in INCLUSION.items():
        kind = F.when(F.col("inclusion") == k, v).otherwise(kind)
    by = ["request_id", "fragment"]
    one = template.join(fragments.select("fragment", "inclusion"), "fragment").select(*by, F.lit("template").alias("source"), kind.alias("reason"), F.lit(False).alias("late"))
    two = task.join(template, by, "left_anti").select(*by, F.lit("task").alias("source"), F.lit(INCLUSION["task_relevant"]).alias("reason"), F.lit(False).alias("late"))
    three = skills.select(*by, F.concat(F.lit("skill:"), F.col("skill").cast("string")).alias("source"), F.lit("SELECTED_SKILL").alias("reason"), F.lit(True).alias("late"))
    every = one.unionByName(two).unionByName(three).distinct()
    return every.groupBy(*by).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.bool_and("late").alias("late"))


def resolve_fragments(merged: DataFrame, fragments: DataFrame, tasks: DataFrame) -> DataFrame:
    """merged plus code (null: chosen) and round: 0 for gates, 1 or 2 for the resolution of groups that left a fragment out.

    fragments(fragment, inclusion, gate, grp, mode, priority, spec_a, spec_b): gate is the code of a gate that fails or
    null, a group without a mode does not compete. tasks(request_id, has_task): what is relevant to a task needs one.
    Groups are resolved over what template and task brought. Those, and only those, that skills add an eligible
    fragment to are resolved again over what was left of them and the new ones, so no skill gets round its group.
    """
    rows = merged.join(fragments, "fragment").join(tasks, "request_id", "left")
    needs = (F.col("inclusion") == "task_relevant") & ~F.coalesce("has_task", F.lit(False))
    rows = rows.withColumn("code", F.coalesce("gate", F.when(needs, "TASK_REQUIRED_FOR_FRAGMENT"))).withColumn("grp", F.when(F.col("mode").isNotNull(), F.col("grp")))
    rows = graph.cut(rows.withColumn("round", F.when(F.col("code").isNotNull(), 0)))

    def losers(open_: DataFrame, round_: int) -> DataFrame:
        chosen = open_.withColumn("wins", fusion.group_winner("grp", F.col("mode"), "fragment", ("request_id",)))
        return chosen.where("NOT wins").select("request_id", "fragment", F.lit(round_).alias("lost"))

    eligible = rows.where("code IS NULL AND grp IS NOT NULL")
    first = graph.cut(losers(eligible.where("NOT late"), 1))
    gained = eligible.where("late").select("request_id", "grp").distinct()
    second = losers(eligible.join(gained, ["request_id", "grp"], "left_semi").join(first, ["request_id", "fragment"], "left_anti"), 2)
    out = rows.join(first.unionByName(second), ["request_id", "fragment"], "left")
    code = F.coalesce("code", F.when(F.col("lost").isNotNull(), "SELECTION_GROUP_NOT_SELECTED"))
    return out.select("request_id", "fragment", "sources", "reasons", "late", code.alias("code"), F.coalesce("round", "lost").alias("round"))


def budget(*limits: Column) -> Column:
    """The least of the limits that are set."""
    return F.least(*limits)


def top_skills(found: DataFrame, most: str) -> DataFrame:
    """The first `most` (a column) of each request by score (null last), priority and id."""
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("score"), F.desc("priority"), "entity_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col(most))


def select_skills(skills: DataFrame, needs: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skills that stay, verdicts of their tools, causes of those that go).

    skills(request_id, skill), needs(skill, tool), nodes and edges as in graph.dependency_closure. A skill goes when one
    of its tools is not included. Its tools are seeds, and a usable seed is included whatever other skills go, so one
    look at what is broken decides, and the closure is taken once, of what stays. Causes are (request_id, skill, tool,
    code, root): every tool of a skill that cannot be used, its code, and the gated tool that is nearest behind it.
    """
    asked = graph.cut(skills.select("request_id", "skill").distinct())
    pairs = graph.cut(asked.join(needs.select("skill", "tool").distinct(), "skill"))
    bad = graph.broken(nodes, edges, pairs.select(F.col("tool").alias("node")))
    causes = graph.cut(pairs.join(bad.select(F.col("node").alias("tool"), "code", "root"), "tool").select("request_id", "skill", "tool", "code", "root"))
    kept = graph.cut(asked.join(causes.select("request_id", "skill").distinct(), ["request_id", "skill"], "left_anti"))
    seeds = pairs.join(kept, ["request_id", "skill"], "left_semi").select("request_id", F.col("tool").alias("node"), F.lit(True).alias("required")).distinct()
    return kept, graph.dependency_closure(seeds, nodes, edges)[0], causes


def usage(asked: DataFrame, kept: DataFrame, verdicts: DataFrame, causes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(request_id, budget, used, most, over) for skills and tools, and skills_removed: how many skills went for which codes.

    budgets(request_id, skills, tools) are the maxima. A request without any skill that stays uses none.
    """
    count = lambda df, name: df.groupBy("request_id").agg(F.count("*").alias(name))
    why = causes.groupBy("request_id", "code").agg(F.countDistinct("skill").alias("n")).groupBy("request_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "code", F.col("n").cast("string")))).alias("codes"))  # a handful of codes
    all_ = budgets.join(asked.select("request_id").distinct(), "request_id").join(count(kept, "n_skills"), "request_id", "left").join(count(verdicts.where("included"), "n_tools"), "request_id", "left").join(why, "request_id", "left")
    used = lambda name: F.coalesce(name, F.lit(0))
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), used(f"n_{b}").alias("used"), F.col(b).cast("long").alias("most")) for b in ("skills", "tools")])).alias("x")
    return all_.select("request_id", rows, F.array_join(F.coalesce("codes", F.array().cast("array<string>")), ",").alias("removed")).select("request_id", "x.*", (F.col("x.used") > F.col("x.most")).alias("over"), "removed")


def provenance(verdicts: DataFrame, resolved: DataFrame, seeds: DataFrame) -> DataFrame:
    """(request_id, node, sources, required_by, reasons) of every included tool of graph.dependency_closure.

    sources: the request for a seed, and every included tool with an edge to it; required_by: those whose edge is a
    required one; reasons: codes of how it came in, all that hold. A tool's list is as long as its edges.
    """
    into = resolved.where("status = 'INCLUDED'").select("request_id", F.col("target").alias("node"), F.concat(F.lit("tool:"), F.col("source").cast("string")).alias("source"), F.when(F.col("requirement") == "required", F.col("source")).alias("needs"), F.when(F.col("requirement") == "required", "REQUIRED_TOOL_DEPENDENCY").otherwise("OPTIONAL_TOOL_DEPENDENCY").alias("reason"))
    own = seeds.select("request_id", "node", F.lit("request").alias("source"), F.lit(None).cast("long").alias("needs"), F.lit("REQUESTED_TOOL").alias("reason")).distinct()
    why = into.unionByName(own).join(verdicts.where("included").select("request_id", "node"), ["request_id", "node"], "left_semi").groupBy("request_id", "node")
    told = why.agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("needs")).alias("needs"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return told.select("request_id", "node", "sources", F.transform("needs", lambda x: x.cast("string")).alias("required_by"), "reasons")


def trim_tools(tools: DataFrame, edges: DataFrame) -> DataFrame:
    """tools(request_id, node, required, score, priority, seed, budget) cut to the budget: (request_id, node, status).

    Required ones over budget fail the request (OVER_BUDGET); else the optional one with the least (score, priority)
    and then the larger id goes, with those that only it brought in, until the rest fits. edges(source, target) hold no
    cycle, so a tool stays while it is a seed or something that stays needs it, and a count of those tells. One request
    is a sequential problem over its closure, so requests are the groups.
    """
    ends = tools.select("request_id", F.col("node").alias("target"))
    inside = edges.select(F.col("source").alias("node"), "target").join(ends, "target")  # what a request does not hold it need not see
    needs = tools.select("request_id", "node").join(inside, ["request_id", "node"]).groupBy("request_id", "node").agg(F.collect_set("target").alias("targets"))
    wide = tools.select("request_id", "node", "required", "score", "priority", "seed", "budget").join(needs, ["request_id", "node"], "left")

    def one(t: pa.Table) -> pa.Table:
        rows = {r["node"]: r for r in t.to_pylist()}
        request, most = t["request_id"][0].as_py(), t["budget"][0].as_py()
        live = {n for n, r in rows.items() if r["seed"]}
        held, work = {n: int(r["seed"]) for n, r in rows.items()}, list(live)
        while work:  # who stays needs its targets, each counted once
            for x in rows[work.pop()]["targets"] or ():
                held[x] += 1
                if x not in live:
                    live.add(x)
                    work.append(x)
        if sum(r["required"] for r in rows.values()) > most:
            status = dict.fromkeys(rows, "OVER_BUDGET")
        else:
            order = sorted((n for n, r in rows.items() if not r["required"]), key=lambda n: (rows[n]["score"] if rows[n]["score"] is not None else float("-inf"), rows[n]["priority"], -n))
            for least in order:
                if len(live) <= most:
                    break
                gone = [least] if least in live else []
                while gone:
                    n = gone.pop()
                    live.discard(n)
                    for x in rows[n]["targets"] or ():
                        held[x] -= 1
                        if not held[x] and x in live:
                            gone.append(x)
            status = {n: "INCLUDED" if n in live else "BUDGET_OMITTED" for n in rows}
        nodes = sorted(rows)
        return pa.table({"request_id": pa.array([request] * len(nodes), pa.int64()), "node": pa.array(nodes, pa.int64()), "status": pa.array([status[n] for n in nodes])})

    return wide.groupBy("request_id").applyInArrow(one, "request_id long, node long, status string")


def render(fragments: DataFrame, max_tokens: int) -> DataFrame:
    """(request_id, status, text, tokens, n): fragments(request_id, place, always, tokens, content) into one prompt.

    Those marked always must fit together, or the request fails; the rest are taken in order while they fit.
    """
    fixed = F.sum(F.when(F.col("always"), F.col("tokens")).otherwise(0)).over(Window.partitionBy("request_id"))
    rows = fragments.withColumn("fixed", fixed)
    xs = rows.groupBy("request_id").agg(F.max("fixed").alias("fixed"), F.array_sort(F.collect_list(F.struct("place", "always", F.col("tokens").cast("long").alias("tokens"), "content"))).alias("xs"))
    start = F.struct(F.col("fixed").cast("long").alias("used"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = x["always"] | (s["used"] + x["tokens"] <= max_tokens)
        return F.struct((s["used"] + F.when(fits & ~x["always"], x["tokens"]).otherwise(0)).alias("used"), F.when(fits, F.concat(s["out"], F.array(x["content"]))).otherwise(s["out"]).alias("out"))

    done = xs.withColumn("s", F.aggregate("xs", start, step))
    ok = F.col("fixed") <= max_tokens
    return done.select("request_id", F.when(ok, "OK").otherwise("PROMPT_OVER_BUDGET").alias("status"), F.when(ok, F.array_join("s.out", "\n\n")).otherwise("").alias("text"), F.when(ok, F.col("s.used")).otherwise(0).alias("tokens"), F.when(ok, F.size("s.out")).otherwise(0).alias("n"))
