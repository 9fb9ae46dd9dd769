"""Merging channels, choosing within groups, ordering, and packing into budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.operators.cuts import cut, written

RRF_K = 60
#: Channels in their fixed order.
CHANNELS = ["vector", "fullText", "trigram", "conceptLinked", "graphLinked"]


def merge_channels(candidates: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """One row per (request_id, chunk_id): the best rank and its score in each channel, and the fused score.

    rrf = sum of 1 / (RRF_K + rank) over channels in their order, so that equal inputs give equal doubles.
    """
    wide = candidates.groupBy("request_id", "chunk_id").pivot("channel", channels).agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    rrf: Column = F.lit(0.0)
    for c in channels:
        rrf = rrf + F.coalesce(1.0 / (RRF_K + F.col(f"{c}_rank")), F.lit(0.0))
    return wide.withColumn("rrf", F.round(rrf, 12))


def reasons(channels: list[str] = CHANNELS) -> Column:
    """Codes of the channels in which a merged row stands, in their order."""
    codes = {"vector": "VECTOR_MATCH", "fullText": "FULL_TEXT_MATCH", "trigram": "TRIGRAM_MATCH", "conceptLinked": "DIRECT_CONCEPT_LINK", "graphLinked": "ONTOLOGY_CONCEPT_LINK"}  # fixed values
    return F.array_compact(F.array(*[F.when(F.col(f"{c}_rank").isNotNull(), codes[c]) for c in channels]))


def group_winner(group: str, mode: Column, id_col: str, partition: tuple[str, ...] = ()) -> Column:
    """Whether a row is chosen: rows without a group, every row of a group with mode all, else the first one.

    highest_priority orders by priority, then specificity; most_specific the other way round; both end in the id.
    """
    specific = [F.desc("spec_a"), F.desc("spec_b")]
    by = (*partition, group)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("priority"), *specific, id_col))
    exact = F.row_number().over(Window.partitionBy(*by).orderBy(*specific, F.desc("priority"), id_col))
    return F.col(group).isNull() | (mode == "all") | F.when(mode == "most_specific", exact == 1).otherwise(first == 1)


def group_winners(rows: DataFrame, group: str, mode: Column, id_col: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """(partition..., id_col) of the rows that group_winner chooses, where a group has one mode, by aggregates instead of windows.

    Rows are first combined by what orders them, with the least id of each, which a hash table does before the shuffle;
    so neither a group nor the rows without one are ever sorted in one task, and what is sorted are different orders.
    """
    some = rows.withColumn("_mode", F.coalesce(mode, F.lit("highest_priority")))
    free = F.col(group).isNull() | (F.col("_mode") == "all")
    least = some.where(~free).groupBy(*partition, group, "_mode", "priority", "spec_a", "spec_b").agg(F.min(id_col).alias(id_col))
    most = F.lit((1 << 63) - 1)
    down = {c: F.coalesce(-F.col(c).cast("long"), most) for c in ("priority", "spec_a", "spec_b")}  # nulls come last
    place = lambda *by: F.struct(*[down[c].alias(f"_{i}") for i, c in enumerate(by)], id_col)
    first = F.when(F.col("_mode") == "most_specific", place("spec_a", "spec_b", "priority")).otherwise(place("priority", "spec_a", "spec_b"))
    won = least.groupBy(*partition, group).agg(F.min(first).alias("_first")).select(*partition, F.col(f"_first.{id_col}").alias(id_col))
    return some.where(free).select(*partition, id_col).unionByName(won)


def final_order() -> Column:
    """Rank within a request: fused score, authority (null: 0), priority, id."""
    return F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("rrf"), F.desc(F.coalesce("authority", F.lit(0.0))), F.desc("priority"), "chunk_id"))


def pack(rows: DataFrame, max_chunks: Column, max_tokens: Column, max_per_item: Column, order: str = "final_rank") -> DataFrame:
    """rows(request_id, chunk_id, item_id, token_count, order) plus outcome: PACKED, ITEM_CAP or TOKEN_BUDGET.

    Rows are taken in order; one that does not fit is passed over and the scan goes on. That is a fold over an ordered
    array per request, which is as long as the channels' limits allow.
    """
    tight = rows.select("request_id", F.col(order).alias("o"), "chunk_id", "item_id", "token_count", max_chunks.alias("mc"), max_tokens.alias("mt"), max_per_item.alias("mi"))
    folded = tight.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("o", "chunk_id", "item_id", F.col("token_count").cast("long").alias("t"), F.col("mc").cast("long").alias("mc"), F.col("mt").cast("long").alias("mt"), F.col("mi").cast("long").alias("mi")))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("items"), F.array().cast("array<struct<chunk_id:bigint,outcome:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        seen = F.size(F.filter(s["items"], lambda i: i == x["item_id"]))
        outcome = F.when(s["n"] >= x["mc"], "TOKEN_BUDGET").when(seen >= x["mi"], "ITEM_CAP").when(s["used"] + x["t"] > x["mt"], "TOKEN_BUDGET").otherwise("PACKED")
        took = outcome == "PACKED"
        return F.struct(
            (s["n"] + F.when(took, 1).otherwise(0)).cast("long").alias("n"),
            (s["used"] + F.when(took, x["t"]).otherwise(0)).cast("long").alias("used"),
            F.when(took, F.concat(s["items"], F.array(x["item_id"]))).otherwise(s["items"]).alias("items"),
            F.concat(s["out"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), outcome.alias("outcome")))).alias("out"),
        )

    done = folded.select("request_id", F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("x")).select("request_id", "x.*")
    return rows.join(done, ["request_id", "chunk_id"])


def pack_long(rows: DataFrame, max_chunks: int, max_tokens: int, max_per_item: int, order: str = "final_rank") -> DataFrame:
    """As pack, for requests with any number of rows; order tells the rows of a request apart.

    At most max_chunks rows of a request are packed. Each round finds the next one: the first row after the last packed
    one that fits. What a row is passed over for follows from those packed before it, so no request's rows ever meet.
    """
    slim = written(rows.select("request_id", F.col(order).alias("o"), "item_id", F.col("token_count").cast("long").alias("t")))
    packed = slim.select("request_id").distinct().withColumn("taken", F.array().cast("array<struct<o:bigint,t:bigint,item_id:bigint>>"))
    for _ in range(max_chunks):
        state = packed.withColumn("at", F.coalesce(F.get("taken", F.size("taken") - 1)["o"], F.lit(-(1 << 62))))
        after = slim.join(state, "request_id").where("o > at")
        used = F.aggregate("taken", F.lit(0).cast("long"), lambda s, x: s + x["t"])
        of_item = F.size(F.filter("taken", lambda x: x["item_id"] == F.col("item_id")))
        following = after.where((of_item < max_per_item) & (used + F.col("t") <= max_tokens)).groupBy("request_id").agg(F.min(F.struct(F.col("o").cast("long").alias("o"), "t", F.col("item_id").cast("long").alias("item_id"))).alias("next"))
        packed = cut(packed.join(following, "request_id", "left").select("request_id", F.when(F.col("next").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("next"))).alias("taken")))
    before = F.filter("taken", lambda x: x["o"] < F.col(order))
    outcome = (
        F.when(F.exists("taken", lambda x: x["o"] == F.col(order)), "PACKED")
        .when(F.size(before) >= max_chunks, "TOKEN_BUDGET")
        .when(F.size(F.filter(before, lambda x: x["item_id"] == F.col("item_id"))) >= max_per_item, "ITEM_CAP")
        .otherwise("TOKEN_BUDGET")
    )
    return rows.join(packed, "request_id").withColumn("outcome", outcome).drop("taken")
