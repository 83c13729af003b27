"""The store followed as a stream: each committed batch once, over restarts, folds, compaction and failing sinks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from chainsift.operators import store as S
from chainsift.streaming.feed import follow_available, folder_sink, read_folder_sink, start_store_feed

DAY = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
DDL = "user STRING, event STRING, block BIGINT, offset BIGINT, run_id STRING, batch_id INT"


def put(spark, path, run, batch, blocks, event="fill"):
    """One committed stream batch with a row per block."""
    rows = spark.createDataFrame([(f"0x{b}", event, b, "f", b, 0, 0) for b in blocks], "user string, event string, block bigint, file string, offset bigint, event_pos int, user_pos int")
    rows = S.with_ingest_time(rows.withColumn("data", F.parse_json(F.lit("{}"))), F.lit(DAY))
    name = f"{run}-{event}-{batch:010d}"
    units = S.write_segment(S.check_rows(rows).withColumns({"run_id": F.lit(run), "batch_id": F.lit(batch)}), path, name)
    S.commit(path, name, units, meta={"stream": True})


def follow(spark, scratch, sink=None, name="feed", **options):
    ckpt = os.path.join(scratch, f"{name}_checkpoint")
    sink = sink or folder_sink(os.path.join(scratch, name))
    follow_available(lambda: start_store_feed(spark, os.path.join(scratch, "store"), ckpt, sink, **options), ckpt, bounded="maxBatchesPerTrigger" in options)


def fed(spark, scratch, name="feed"):
    return sorted((r["event"], r["block"]) for r in read_folder_sink(spark, os.path.join(scratch, name), DDL).collect())


def test_each_batch_once_over_restarts_fold_and_compaction(spark, scratch):
    path = os.path.join(scratch, "store")
    S.create_store(spark, path)
    follow(spark, scratch)
    assert fed(spark, scratch) == []
    put(spark, path, "r1", 0, [1, 2])
    put(spark, path, "r1", 1, [3])
    follow(spark, scratch)
    assert fed(spark, scratch) == [("fill", 1), ("fill", 2), ("fill", 3)]
    put(spark, path, "r1", 2, [4])
    put(spark, path, "r2", 0, [5], event="misc")
    S.compact_day(spark, path, DAY.date())  # new and old batches are now in one segment, the commits in one fold
    put(spark, path, "r1", 3, [])
    put(spark, path, "r1", 4, [6])
    follow(spark, scratch)
    want = [("fill", 1), ("fill", 2), ("fill", 3), ("fill", 4), ("fill", 6), ("misc", 5)]
    assert fed(spark, scratch) == want
    S.fold_commits(path)
    follow(spark, scratch)
    assert fed(spark, scratch) == want
    follow(spark, scratch, name="second")  # a reader that starts after all this
    assert fed(spark, scratch, "second") == want


def test_failing_sink_gets_the_same_rows_again_after_a_compaction(spark, scratch):
    path, seen = os.path.join(scratch, "store"), []
    put(spark, path, "r", 0, [1])
    put(spark, path, "r", 1, [2])

    def failing(rows, number):
        seen.append((number, sorted(r["block"] for r in rows.collect())))
        if len(seen) == 1:
            raise OSError("sink lost")

    with pytest.raises(Exception):
        follow(spark, scratch, failing)
    put(spark, path, "r", 2, [3])
    S.compact_day(spark, path, DAY.date())
    follow(spark, scratch, failing)
    assert seen[0] == seen[1] == (0, [1, 2]) and seen[2:] == [(1, [3])]


def test_batches_per_trigger_and_later_start(spark, scratch):
    path, sizes = os.path.join(scratch, "store"), []
    for b in range(5):
        put(spark, path, "r", b, [10 + b])
    follow(spark, scratch, lambda rows, n: None, name="late", startingAt="latest")
    follow(spark, scratch, lambda rows, n: sizes.append(sorted(r["batch_id"] for r in rows.collect())), name="bounded", maxBatchesPerTrigger=2)
    assert sizes == [[0, 1], [2, 3], [4]]
    put(spark, path, "r", 5, [99])
    follow(spark, scratch, name="late", startingAt="latest")
    assert fed(spark, scratch, "late") == [("fill", 99)]


def test_backfills_are_not_fed_and_cover_nothing(spark, scratch):
    path = os.path.join(scratch, "store")
    put(spark, path, "r", 0, [1])
    rows = S.read_store(spark, path).drop("segment", "run_id", "batch_id").withColumn("block", F.lit(7).cast("long"))
    S.append_events(rows, path)
    S.compact_day(spark, path, DAY.date())
    put(spark, path, "r", 1, [2])
    follow(spark, scratch)
    assert fed(spark, scratch) == [("fill", 1), ("fill", 2)]


def test_only_segments_that_may_hold_a_batch_are_read(spark, scratch):
    path = os.path.join(scratch, "store")
    for b in range(4):
        put(spark, path, "r", b, [b])
    S.compact_day(spark, path, DAY.date())
    put(spark, path, "r", 4, [4])
    late = S.read_batches(spark, path, {"r-fill": (3, 4)})
    assert [f"segment=r-fill-{4:010d}" in f for f in late.inputFiles()] == [True]
    assert sorted(r["block"] for r in S.read_batches(spark, path, {"r-fill": (1, 4)}).collect()) == [2, 3, 4]
    S.fold_commits(path)
    assert len(S.read_batches(spark, path, {"r-fill": (3, 4)}).inputFiles()) == 1


def test_retention_keeps_what_is_left_in_the_feed(spark, scratch):
    path = os.path.join(scratch, "store")
    put(spark, path, "r", 0, [1])
    late = S.read_store(spark, path).drop("segment").withColumns({"created_at": F.lit(DAY + dt.timedelta(hours=5)), "block": F.lit(2).cast("long"), "batch_id": F.lit(1)})
    name = f"r-fill-{1:010d}"
    S.commit(path, name, S.write_segment(late, path, name), meta={"stream": True})
    assert S.apply_retention(spark, path, DAY + dt.timedelta(days=7, hours=1)) == 1
    follow(spark, scratch)
    assert fed(spark, scratch) == [("fill", 2)]


def test_listing_taken_during_a_fold_is_not_trusted(scratch, monkeypatch):
    """A listing that holds neither the fold's file nor those that it deleted must not lose units."""
    from chainsift.sources import storefeed

    path = scratch + "/store"
    for b in range(3):
        S.commit(path, f"run-fill-{b:010d}", [(f"run-fill-{b:010d}", "2024-01-01")], meta={"stream": True})
    S.fold_commits(path)
    S.commit(path, "run-fill-0000000003", [("run-fill-0000000003", "2024-01-01")], meta={"stream": True})
    real, listings = storefeed._fs(path), []

    class Torn:
        """The first listing misses the fold's file."""

        def get_file_info(self, where):
            listings.append(where)
            infos = real[0].get_file_info(where)
            return [i for i in infos if len(listings) > 1 or not i.base_name.startswith("fold-")]

        def open_input_stream(self, name):
            return real[0].open_input_stream(name)

    monkeypatch.setattr(storefeed, "_fs", lambda _: (Torn(), real[1]))
    assert len(storefeed.heads(storefeed.read_commits(path))) == 1
    listings.clear()
    units = {u[0] for c in storefeed.read_commits(path).values() for u in c["adds"]}
    assert units == {f"run-fill-{b:010d}" for b in range(4)}
