"""Structured Streaming over the same plans: a change feed into snapshots, and metric events into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from sparkwell.operators.cuts import cut, new_folder
from sparkwell.plans import snapshot


def shared(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the application ends."""
    return new_folder(spark, "feed")


def newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of every key; rows of one version: the greatest by its other columns.

    Combined before the shuffle, so that edits of one busy key coalesce where they are read.
    """
    order = [version, *[c for c in rows.columns if c not in (key, version)]]
    best = rows.groupBy(key).agg(F.max(F.struct(*order)).alias("best"))
    return best.select(key, "best.*").select(rows.columns)


def ingest_batch(spark: SparkSession, home: str, batch: DataFrame, epoch: int, key: str, version: str, buckets: int = snapshot.BUCKETS) -> dict:
    """Plans and applies one batch of rows with a column `deleted`; gives the pointer row.

    A key's newest row counts if it is newer than the stored one; a deleted one stays as a tombstone, so that an older
    edit that comes later does not bring the key back. Rows that change nothing touch no bucket. An epoch that the
    pointer has passed is left alone, and one that failed before the pointer moved is done again.
    """
    now = snapshot.pointer(spark, home)
    if epoch <= now["epoch"]:
        return now
    rows = cut(newest(batch, key, version))
    n = now["buckets"] if now["revision"] else buckets
    touched = [r[0] for r in rows.select(snapshot.bucket_of(F.col(key), n).alias("b")).distinct().collect()]
    stored = snapshot.read(spark, home, "rows", rows.schema, touched, now["revision"]).select(key, F.col(version).alias("old"))
    fresh = rows.join(stored, key, "left").where(F.col("old").isNull() | (F.col(version) > F.col("old"))).drop("old")
    fresh = cut(fresh.select(rows.columns))
    return snapshot.apply(spark, home, fresh.select(F.col(key).alias("id"), F.lit("upsert").alias("action")), {"rows": (key, fresh)}, epoch, n)


def ingest(feed: DataFrame, home: str, key: str, version: str, columns: list[str], deleted: Column, buckets: int = snapshot.BUCKETS) -> DataFrame:
    """What is left of a change feed (a streaming DataFrame) after all that it has now: every key's newest row, deleted ones out.

    home keeps the snapshots, the pointer and the log of the stream, so a query that was stopped anywhere goes on from
    there with the same home: epochs are done once, each after the one before.
    """
    spark = feed.sparkSession
    rows = feed.select(*columns, F.coalesce(deleted, F.lit(False)).alias("deleted"))

    def build(batch: DataFrame, epoch: int) -> None:
        ingest_batch(spark, home, batch, epoch, key, version, buckets)

    rows.writeStream.foreachBatch(build).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema if f.name != "deleted"] + [StructField("deleted", BooleanType())])
    return snapshot.read(spark, home, "rows", schema).where("NOT deleted").select(*columns)


def quantile_of_counts(counts: DataFrame, by: list[str], quantiles: dict[str, float], value: str = "value", n: str = "n") -> DataFrame:
    """by, n, total, most and a column for each quantile of counts(by..., value, n): nearest rank, exact, whatever the number of events."""
    part = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum(n).over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum(n).over(part))
    exact = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), F.col(value))).alias(name) for name, q in quantiles.items()]
    return run.groupBy(*by).agg(F.sum(n).alias("n"), F.round(F.sum(F.col(value) * F.col(n)), 4).alias("total"), F.max(value).alias("most"), *exact)


def metric_windows(spark: SparkSession, folder: str, schema, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events(ts, event_type, value) per tumbling window and type, once the watermark has passed it: count, total, most, p50 and p95.

    The stream keeps a count for each value of a window, so its state is spread over many small keys and is as large as
    the different values of open windows; the quantiles are read off those counts and are exact.
    """
    home = shared(spark)
    feed = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = feed.where("value IS NOT NULL").groupBy(F.window("ts", width), "event_type", "value").agg(F.count("*").alias("n"))
    flat = counts.select(F.col("window.start").alias("window_start"), "event_type", "value", "n")
    query = flat.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out").option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return quantile_of_counts(spark.read.schema(flat.schema).parquet(f"{home}/out"), ["window_start", "event_type"], {"p50": 0.5, "p95": 0.95})
