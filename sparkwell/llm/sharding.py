"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.llm.stash import cut, free


def byte_shards(rows: DataFrame, size: Column, order: list[Column], shards: int) -> DataFrame:
    """rows plus size, shard (0 to shards - 1) and slot (place in its shard, gapless from 0).

    Rows are laid out in `order` (ties: in reading order, so repeated rows are fine). Each range partition gives one
    total; the running sum over those few totals places every partition, a running sum within a partition places
    every row, and a row goes where its middle byte falls between the equal targets. So shards are contiguous in
    `order` and differ from total/shards by one row's size at most. Sizes must be positive; nulls in `order` come
    first; an empty table gives an empty result. A text counts by its size alone, however long. Columns of rows called
    size, shard or slot are replaced, all others stay. Pass only the columns the result needs: all are shuffled once.
    """
    spark = rows.sparkSession
    names = free(rows, "tie", "part", "upto", "nth", "bytes0", "n0", "total", "row", "first", *[f"o{i}" for i in range(len(order))])
    tie, part, upto, nth, bytes0, n0, all_bytes, row, first, *by = names
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("size", "shard", "slot")]
    keyed = rows.select(*others, size.cast("long").alias("size"), F.monotonically_increasing_id().alias(tie), *[c.alias(o) for o, c in zip(by, order, strict=True)])
    by.append(tie)
    placed = cut(keyed.repartitionByRange(parts, *by).withColumn(part, F.spark_partition_id()))

    line = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(part).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # one row per range partition, whatever the number of rows
    before = totals.select(part, F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias(bytes0), F.coalesce(F.sum("n").over(line), F.lit(0)).alias(n0), F.sum("bytes").over(Window.partitionBy()).alias(all_bytes))
    inner = Window.partitionBy(part).orderBy(*by)
    run = placed.select("*", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias(upto), F.row_number().over(inner).alias(nth))
    at = run.join(F.broadcast(before), part).withColumn(row, F.col(n0) + F.col(nth) - 1)
    middle = f"2 * ({bytes0} + {upto}) - size"  # twice the middle byte's place
    at = cut(at.withColumn("shard", F.expr(f"least(CAST(({shards} * ({middle})) div (2 * {all_bytes}) AS INT), {shards - 1})")).drop(upto, nth, bytes0, n0, all_bytes, *by))
    firsts = at.groupBy("shard").agg(F.min(row).alias(first))
    return at.join(F.broadcast(firsts), "shard").withColumn("slot", F.col(row) - F.col(first)).drop(row, first, part)
