"""Bucketed snapshots, the change feed that writes them, and exact quantiles of counts."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkwell.plans import snapshot
from sparkwell.streaming import feeds

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ITEMS, PARTS, ACTIONS = "id long, name string", "owner long, n int", "id long, action string"


def step(spark, home, actions, items, parts, **more):
    built = {"items": ("id", spark.createDataFrame(items, ITEMS)), "parts": ("owner", spark.createDataFrame(parts, PARTS))}
    return snapshot.apply(spark, home, spark.createDataFrame(actions, ACTIONS), built, buckets=8, **more)


def held(spark, home, **more):
    items, parts = (snapshot.read(spark, home, t, spark.createDataFrame([], s).schema, **more).collect() for t, s in (("items", ITEMS), ("parts", PARTS)))
    return sorted(map(tuple, items)), sorted(map(tuple, parts))


def paths(spark, home, revision):
    return {(r["table"], r["bucket"]): r["path"] for r in snapshot.manifest(spark, home, revision)}


def filled(spark, home):
    items, parts = [(k, f"item {k}") for k in range(40)], [(k, n) for k in range(40) for n in range(k % 3)]
    assert step(spark, home, [(k, "upsert") for k in range(40)], items, parts) == {"revision": 1, "epoch": -1, "buckets": 8}
    return items, parts


def test_a_revision_replaces_children_with_their_parent_and_writes_what_it_touches(spark, tmp_path):
    home = str(tmp_path)
    assert held(spark, home) == ([], [])
    items, parts = filled(spark, home)
    assert held(spark, home) == (items, sorted(parts))
    row = step(spark, home, [(2, "upsert"), (5, "delete"), (90, "upsert")], [(2, "new"), (90, "more"), (7, "not asked for")], [(2, 70), (90, 1), (7, 9)])
    assert row["revision"] == 2
    want = sorted([x for x in items if x[0] not in (2, 5)] + [(2, "new"), (90, "more")]), sorted([x for x in parts if x[0] not in (2, 5)] + [(2, 70), (90, 1)])
    assert held(spark, home) == want and held(spark, home, revision=1) == (items, sorted(parts))
    bucket = lambda k: spark.range(1).select(snapshot.bucket_of(F.lit(k).cast("long"), 8)).first()[0]
    touched, before, after = {bucket(k) for k in (2, 5, 90)}, paths(spark, home, 1), paths(spark, home, 2)
    assert 0 < len(touched) < 8
    assert all(after[k] == p for k, p in before.items() if k[1] not in touched) and all("/2/" in p for k, p in after.items() if k[1] in touched)
    assert set(snapshot.unused(spark, home, keep=1)) == {p for k, p in before.items() if k[1] in touched} and snapshot.unused(spark, home) == []


def test_a_plan_is_applied_without_copies_of_its_texts(spark, tmp_path, monkeypatch):
    from sparkwell.catalog import builds
    from sparkwell.operators import cuts

    folders = []
    monkeypatch.setattr(cuts, "new_folder", lambda _spark, kind: folders.append(f"{tmp_path}/{kind}-{len(folders)}") or folders[-1])
    assert builds.sink_apply_plan(spark, DATA).count() > 0
    tables = [f for f in folders if "/table-" in f]
    assert tables and not any("body" in spark.read.parquet(f).columns for f in tables)


def test_what_fails_before_the_pointer_moves_changes_nothing(spark, tmp_path, monkeypatch):
    home = str(tmp_path)
    items, parts = filled(spark, home)
    with pytest.raises(RuntimeError, match="REVISION_NOT_VERIFIED"):
        step(spark, home, [(1, "upsert")], [], [])  # the plan brings a row that was not built
    assert snapshot.pointer(spark, home)["revision"] == 1 and held(spark, home) == (items, sorted(parts))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshot, "point", fail)
        with pytest.raises(OSError, match="lost"):
            step(spark, home, [(1, "delete")], [], [])
    assert held(spark, home) == (items, sorted(parts))
    step(spark, home, [(1, "upsert")], [(1, "again")], [])
    assert (1, "again") in held(spark, home)[0] and not any(owner == 1 for owner, _ in held(spark, home)[1])


def test_an_epoch_is_applied_once_and_an_empty_plan_keeps_all_files(spark, tmp_path):
    home = str(tmp_path)
    filled(spark, home)
    assert step(spark, home, [(1, "delete")], [], [], epoch=4)["epoch"] == 4
    assert step(spark, home, [(2, "delete")], [], [], epoch=4) == snapshot.pointer(spark, home) == {"revision": 2, "epoch": 4, "buckets": 8}
    assert {2} <= {k for k, _ in held(spark, home)[0]}
    assert step(spark, home, [], [], [], epoch=5)["revision"] == 3 and paths(spark, home, 3) == paths(spark, home, 2)
    assert step(spark, home, [(k, "delete") for k in range(40)], [], [])["revision"] == 4 and held(spark, home) == ([], [])


FEED = "user long, at long, kind string"


def write_feed(spark, folder, rows, files):
    for k in range(files):
        spark.createDataFrame(rows[k::files], FEED).coalesce(1).write.mode("append").parquet(folder)


def run_feed(spark, folder, home):
    feed = spark.readStream.schema(spark.createDataFrame([], FEED).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return {tuple(r) for r in feeds.ingest(feed, home, "user", "at", ["user", "at", "kind"], F.col("kind") == "gone", 4).collect()}


def left(rows):
    best = {}
    for user, at, kind in rows:
        if user not in best or (at, kind) > best[user][1:]:
            best[user] = (user, at, kind)
    return {r for r in best.values() if r[2] != "gone"}


def test_the_feed_equals_a_batch_with_deletes_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(25), at, rng.choice(["view", "edit", "gone"])) for at in range(200)]
    rng.shuffle(rows)  # older edits come after tombstones
    write_feed(spark, f"{tmp_path}/feed", rows, 4)
    assert run_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/home") == left(rows)
    later = [(3, 1000, "view"), (4, 1001, "gone"), (3, 5, "gone")]
    write_feed(spark, f"{tmp_path}/feed", later, 1)
    before = snapshot.pointer(spark, f"{tmp_path}/home")
    assert run_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/home") == left(rows + later)  # the same log: only the new file
    after = snapshot.pointer(spark, f"{tmp_path}/home")
    assert (after["revision"], after["epoch"]) == (before["revision"] + 1, before["epoch"] + 1)


@pytest.mark.parametrize("fails_at", [1, 3])
def test_a_feed_stopped_between_write_and_pointer_goes_on(spark, tmp_path, monkeypatch, fails_at):
    rng = random.Random(fails_at)
    rows = [(rng.randrange(12), at, rng.choice(["view", "gone"])) for at in range(80)]
    write_feed(spark, f"{tmp_path}/feed", rows, 4)
    point, calls = snapshot.point, []

    def stopped(s, home, row):
        calls.append(row)
        if len(calls) == fails_at:
            raise OSError("stopped here")
        point(s, home, row)

    with monkeypatch.context() as m:
        m.setattr(snapshot, "point", stopped)
        with pytest.raises(Exception, match="stopped here"):
            run_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/home")
    assert snapshot.pointer(spark, f"{tmp_path}/home")["revision"] == fails_at - 1
    assert run_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/home") == left(rows)
    assert snapshot.pointer(spark, f"{tmp_path}/home")["revision"] == 4


def test_a_batch_that_is_played_again_changes_nothing(spark, tmp_path):
    home = str(tmp_path)
    batch = lambda *rows: spark.createDataFrame(list(rows), f"{FEED}, deleted boolean")
    one = feeds.ingest_batch(spark, home, batch((1, 1, "a", False), (2, 1, "b", False), (1, 2, "c", False)), 0, "user", "at", 4)
    assert feeds.ingest_batch(spark, home, batch((1, 9, "other", True)), 0, "user", "at", 4) == one
    two = feeds.ingest_batch(spark, home, batch((1, 1, "late", False)), 1, "user", "at", 4)  # older: nothing is touched
    assert two["revision"] == 2 and paths(spark, home, 2) == paths(spark, home, 1)
    schema = batch((1, 1, "", False)).schema
    assert {(r.user, r.kind) for r in snapshot.read(spark, home, "rows", schema).collect()} == {(1, "c"), (2, "b")}


def test_quantiles_of_counts_are_nearest_ranks(spark):
    rng = random.Random(3)
    values = {g: sorted(rng.choice([0.5, 1.0, 2.5, 7.0, 9.25]) for _ in range(rng.randint(1, 60))) for g in range(6)}
    counts = [(g, v, xs.count(v)) for g, xs in values.items() for v in set(xs)]
    got = feeds.quantile_of_counts(spark.createDataFrame(counts, "g int, value double, n long"), ["g"], {"p50": 0.5, "p95": 0.95}).collect()
    rank = lambda xs, q: xs[math.ceil(q * len(xs)) - 1]
    assert {r.g: (r.n, r.total, r.most, r.p50, r.p95) for r in got} == {g: (len(xs), sum(xs), xs[-1], rank(xs, 0.5), rank(xs, 0.95)) for g, xs in values.items()}
