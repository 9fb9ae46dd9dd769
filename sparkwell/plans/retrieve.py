"""The retrieval plan for a batch of requests: channels, gates, groups, fusion, order, packing, and what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.operators import fusion
from sparkwell.operators.cuts import written

#: Built-in profile, field by field.
DEFAULTS = {"vector": 60, "full_text": 40, "trigram": 20, "concept_linked": 30, "seeds": 4, "graph_depth": 1, "graph_limit": 30, "max_chunks": 10, "max_tokens": 7000, "max_per_item": 3}


def profiles(requests: DataFrame, named: DataFrame) -> DataFrame:
    """requests plus every profile field: the request's profile, then the default one, then the built-in; unknown keys give error_code.

    requests(request_id, profile), named(profile, is_default, fields...): a missing field is null.
    """
    own = named.select("profile", F.lit(True).alias("known"), *[F.col(f).alias(f"own_{f}") for f in DEFAULTS])
    default = named.where("is_default").select(*[F.max(f).alias(f"base_{f}") for f in DEFAULTS])
    both = requests.join(own, "profile", "left").join(F.broadcast(default))  # one row
    fields = [F.coalesce(f"own_{f}", f"base_{f}", F.lit(v)).cast("int").alias(f) for f, v in DEFAULTS.items()]
    return both.select(*requests.columns, *fields, F.when(F.col("profile").isNotNull() & F.col("known").isNull(), "PROFILE_NOT_FOUND").alias("error_code"))


def errors(requests: DataFrame, profiled: DataFrame) -> DataFrame:
    """profiled(request_id, fields, error_code) with INVALID_INPUT for requests(request_id, query) whose query is blank."""
    blank = requests.select("request_id", (F.trim("query") == "").alias("blank"))
    both = profiled.join(blank, "request_id")
    return both.withColumn("error_code", F.coalesce("error_code", F.when(F.col("blank"), "INVALID_INPUT"))).drop("blank")


def warnings(requests: DataFrame) -> DataFrame:
    """(request_id, warning) of requests(request_id, has_vector, has_graph): a channel that is down is left out, the others go on."""
    down = F.array_compact(F.array(F.when(~F.col("has_vector"), "VECTOR_CHANNEL_UNAVAILABLE"), F.when(~F.col("has_graph"), "ONTOLOGY_CHANNEL_UNAVAILABLE")))
    return requests.select("request_id", F.explode(down).alias("warning"))


def restrict(found: DataFrame, filters: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of found(request_id, chunk_id, ...) that meet every kind of filter of their request.

    filters(request_id, kind, value) lists what a request is confined to, members(chunk_id, kind, value) what a chunk
    belongs to: its item, its concepts, their domains. A kind without a row for a request does not confine it, so an
    empty list means all; values of one kind are alternatives. A chunk stays when it has as many kinds as are asked for,
    so filters are joined, never gathered into lists, whatever their length.
    """
    # what was found is few rows a request: written, it is known for the smaller side, and neither filters nor members are sorted
    found = written(found)
    wanted = filters.groupBy("request_id").agg(F.countDistinct("kind").alias("wanted"))
    pairs = written(found.select("request_id", "chunk_id").distinct().join(wanted.select("request_id"), "request_id", "left_semi"))
    near = members.join(pairs.select("chunk_id"), "chunk_id", "left_semi")
    held = written(pairs.join(near.distinct(), "chunk_id").select("request_id", "chunk_id", "kind", "value"))
    have = filters.join(held, ["request_id", "kind", "value"]).groupBy("request_id", "chunk_id").agg(F.countDistinct("kind").alias("have"))
    both = found.join(wanted, "request_id", "left").join(have, ["request_id", "chunk_id"], "left")
    return both.where("wanted IS NULL OR have = wanted").drop("wanted", "have")


def gate(merged: DataFrame, chunks: DataFrame, requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """merged candidates with the chunk's columns, `stage` and `code` of the first gate that stops them, and specificity.

    chunks carry their status and their item's, both of which must be allowed, window, authorization and applicability
    rule ids (null: none); requests carry as_of and include_draft; verdicts(request_id, rule_id, state, spec_a, spec_b, allowed). An identity is `redacted` whenever
    authorization is denied, whatever gate stopped the row.
    """
    c = merged.join(chunks.hint("merge"), "chunk_id").join(requests.select("request_id", "as_of", "include_draft"), "request_id")
    auth = verdicts.select("request_id", F.col("rule_id").alias("authorization"), "allowed")
    appl = verdicts.select("request_id", F.col("rule_id").alias("applicability"), F.col("state").alias("appl_state"), "spec_a", "spec_b")
    c = c.join(auth, ["request_id", "authorization"], "left").join(appl, ["request_id", "applicability"], "left")
    denied = F.col("authorization").isNotNull() & ~F.coalesce("allowed", F.lit(False))
    allowed = lambda c: (F.col(c) == "published") | ((F.col(c) == "draft") & F.col("include_draft"))
    dead = ~(allowed("status") & allowed("item_status"))
    outside = F.coalesce(F.col("effective_from") > F.col("as_of"), F.lit(False)) | F.coalesce(F.col("effective_to") <= F.col("as_of"), F.lit(False))
    off = F.col("applicability").isNotNull() & (F.coalesce("appl_state", F.lit(0)) != 2)
    code = F.when(dead, "LIFECYCLE_NOT_PUBLISHED").when(outside, "OUTSIDE_EFFECTIVE_WINDOW").when(denied, "AUTHORIZATION_NO_MATCH").when(off, "APPLICABILITY_NO_MATCH")
    return c.withColumn("code", code).withColumn("redacted", denied).withColumn("spec_a", F.coalesce("spec_a", F.lit(0))).withColumn("spec_b", F.coalesce("spec_b", F.lit(0)))


def retrieve(candidates: DataFrame, chunks: DataFrame, requests: DataFrame, verdicts: DataFrame, modes: DataFrame, limits: DataFrame, filters: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Every candidate of every request with its code (null: packed), ranks, fused score and final rank.

    filters and members: see restrict; what they leave out is no candidate, so it neither competes nor is told of.

    limits(request_id, max_chunks, max_tokens, max_per_item): of its profile. modes(selection_group, mode): a group without a mode takes highest_priority.
    """
    merged = fusion.merge_channels(candidates)
    if filters is not None and members is not None:
        merged = restrict(merged, filters, members)
    gated = gate(merged, chunks, requests, verdicts).join(modes, "selection_group", "left")
    alive = gated.where("code IS NULL")
    chosen = alive.withColumn("wins", fusion.group_winner("selection_group", F.coalesce("mode", F.lit("highest_priority")), "chunk_id", ("request_id",)))
    lost = chosen.where("NOT wins").select("request_id", "chunk_id", F.lit("SELECTION_GROUP_NOT_SELECTED").alias("lost_code"))
    order = chosen.where("wins").withColumn("final_rank", fusion.final_order())
    order = order.join(limits.select("request_id", "max_chunks", "max_tokens", "max_per_item"), "request_id")
    packed = fusion.pack(order, F.col("max_chunks"), F.col("max_tokens"), F.col("max_per_item")).select("request_id", "chunk_id", "final_rank", "outcome")
    out = gated.join(lost, ["request_id", "chunk_id"], "left").join(packed, ["request_id", "chunk_id"], "left")
    code = F.coalesce("code", "lost_code", F.when(F.col("outcome") == "ITEM_CAP", "PACKING_ITEM_CAP").when(F.col("outcome") == "TOKEN_BUDGET", "PACKING_TOKEN_BUDGET"))
    return out.withColumn("code", code).drop("lost_code")


def exclusions(done: DataFrame) -> DataFrame:
    """(request_id, chunk_id, stage, code): what was left out; the id is null where authorization was denied."""
    stage = (
        F.when(F.col("code").isin("LIFECYCLE_NOT_PUBLISHED", "OUTSIDE_EFFECTIVE_WINDOW"), "lifecycle_filter")
        .when(F.col("code") == "AUTHORIZATION_NO_MATCH", "authorization")
        .when(F.col("code") == "APPLICABILITY_NO_MATCH", "applicability")
        .when(F.col("code") == "SELECTION_GROUP_NOT_SELECTED", "selection_groups")
        .otherwise("packing")
    )
    return done.where("code IS NOT NULL").select("request_id", F.when(~F.col("redacted"), F.col("chunk_id")).alias("chunk_id"), stage.alias("stage"), "code")


def funnel(done: DataFrame) -> DataFrame:
    """Candidates per request after each stage."""
    def left(*codes: str):
        return F.count_if(~F.coalesce(F.col("code").isin(*codes), F.lit(False)))

    a = ("LIFECYCLE_NOT_PUBLISHED", "OUTSIDE_EFFECTIVE_WINDOW")
    b = (*a, "AUTHORIZATION_NO_MATCH")
    c = (*b, "APPLICABILITY_NO_MATCH")
    d = (*c, "SELECTION_GROUP_NOT_SELECTED")
    return done.groupBy("request_id").agg(F.count("*").alias("merged"), left(*a).alias("alive"), left(*b).alias("authorized"), left(*c).alias("applicable"), left(*d).alias("selected"), F.count_if(F.col("code").isNull()).alias("packed"))
