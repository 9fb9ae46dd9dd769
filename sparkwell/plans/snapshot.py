"""Snapshots in buckets: a revision writes the buckets it touches, a manifest names the files of all, and a pointer row says which manifest holds.

    home/data/<table>/<revision>/bucket=<k>   rows of a bucket, as that revision wrote them
    home/manifests/<revision>                 (table, bucket, path, n_rows) of every bucket of the revision
    home/pointer                              the row (revision, epoch, buckets), replaced by one rename

A reader takes the manifest of the pointer, so it sees a whole revision or the one before. What fails before the rename
leaves the pointer; the same revision is then written anew.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkwell.operators.cuts import written

#: Buckets of a table when it is first written; the pointer keeps the number.
BUCKETS = 64
_MANIFEST = "table string, bucket int, path string, n_rows long"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()), place


def pointer(spark: SparkSession, home: str) -> dict:
    """The pointer row; revision 0 where nothing was written yet."""
    files, place = _files(spark, f"{home}/pointer")
    if not files.util().exists(place):
        return {"revision": 0, "epoch": -1, "buckets": BUCKETS}
    return json.loads(spark.read.text(f"{home}/pointer", wholetext=True).first()[0])


def point(spark: SparkSession, home: str, row: dict) -> None:
    """Replaces the pointer by one rename."""
    jvm = spark._jvm
    files, made = _files(spark, f"{home}/pointer-{row['revision']}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    out = files.create(made, flags, none)
    out.write(bytearray(json.dumps(row).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(made, _files(spark, f"{home}/pointer")[1], over)


def manifest(spark: SparkSession, home: str, revision: int) -> list[dict]:
    """The buckets of a revision: as many rows as tables have buckets."""
    return [r.asDict() for r in spark.read.schema(_MANIFEST).parquet(f"{home}/manifests/{revision}").collect()] if revision else []


def read(spark: SparkSession, home: str, table: str, schema: StructType, buckets: list[int] | None = None, revision: int | None = None) -> DataFrame:
    """A table of a revision (the pointer's by default), or only some of its buckets."""
    rows = manifest(spark, home, pointer(spark, home)["revision"] if revision is None else revision)
    paths = [r["path"] for r in rows if r["table"] == table and (buckets is None or r["bucket"] in buckets)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply(spark: SparkSession, home: str, actions: DataFrame, built: Mapping[str, tuple[str, DataFrame]], epoch: int | None = None, buckets: int = BUCKETS) -> dict:
    """Makes the next revision of actions(id, action: upsert or delete), and gives its pointer row.

    built: for every table its key column and the rows that upserts bring; the first table holds the entities, and the
    others their children, keyed by their parent. A touched entity's rows go from every table, and those of an upsert
    are put in their place, so children are replaced with their parent. Only buckets with a touched id are read and
    written; the manifest takes the files of the others over. An epoch that the pointer has already passed changes
    nothing. Before the pointer moves, upserted ids must be there and deleted ones not.
    """
    now = pointer(spark, home)
    if epoch is not None and epoch <= now["epoch"]:
        return now
    if now["revision"]:
        buckets = now["buckets"]
    row = {"revision": now["revision"] + 1, "epoch": now["epoch"] if epoch is None else epoch, "buckets": buckets}
    doing = written(actions.select("id", "action", bucket_of(F.col("id"), buckets).alias("bucket")).distinct())
    touched = sorted(r[0] for r in doing.select("bucket").distinct().collect())  # no more than there are buckets
    rows = [r for r in manifest(spark, home, now["revision"]) if r["bucket"] not in set(touched)]
    for table, (key, new) in built.items() if touched else ():
        old = read(spark, home, table, new.schema, touched, now["revision"])
        kept = old.join(doing.select(F.col("id").alias(key)), key, "left_anti")
        brought = new.join(doing.where("action = 'upsert'").select(F.col("id").alias(key)), key, "left_semi")
        path = f"{home}/data/{table}/{row['revision']}"
        here = lambda df: df.withColumn("bucket", bucket_of(F.col(key), buckets))
        # what is kept is read bucket by bucket and goes back there, so only what is brought is dealt out
        both = here(kept).unionByName(here(brought).hint("rebalance", "bucket"))
        both.write.mode("overwrite").partitionBy("bucket").parquet(path)
        made = spark.read.schema(StructType([*new.schema.fields, both.schema["bucket"]])).parquet(path)
        rows += [{"table": table, "bucket": k, "path": f"{path}/bucket={k}", "n_rows": n} for k, n in made.groupBy("bucket").count().collect()]
        if table == next(iter(built)):
            there = made.select(F.col(key).alias("id")).distinct().withColumn("here", F.lit(True))
            wrong = doing.join(there, "id", "left").where((F.col("action") == "upsert") != F.coalesce("here", F.lit(False))).count()
            if wrong:
                raise RuntimeError(f"REVISION_NOT_VERIFIED: {wrong} ids of revision {row['revision']} are not as planned")
    ordered = [tuple(r[c] for c in ("table", "bucket", "path", "n_rows")) for r in rows]
    spark.createDataFrame(ordered, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{home}/manifests/{row['revision']}")
    point(spark, home, row)
    return row


def unused(spark: SparkSession, home: str, keep: int = 2) -> list[str]:
    """Folders of data that none of the last `keep` revisions names: what a clean-up may delete."""
    last = pointer(spark, home)["revision"]
    named = {r["path"] for k in range(max(1, last - keep + 1), last + 1) for r in manifest(spark, home, k)}
    every = {r["path"] for k in range(1, last + 1) for r in manifest(spark, home, k)}
    return sorted(every - named)
