"""blocklog source: offsets, splits, torn tails, catch-up and stream restarts."""

import json
import os

from helpers import write_log
from pyspark.sql import functions as F

from chainsift.sources.blocklog import read_block_log, stream_block_log

F1 = "node_fills_by_block/hourly/20240101/5"
F2 = "node_fills_by_block/hourly/20240101/6"
NOW_OPEN = "2024-01-01T05:30:00"  # hour 5 is open
NOW_LATE = "2024-01-02T00:00:00"  # every hour above is closed


def expected_lines(text, rel):
    out, off = [], 0
    for ln in text.split("\n")[:-1]:
        out.append((rel, off, ln))
        off += len(ln.encode()) + 1
    return out


def test_offsets_and_small_splits(spark, scratch):
    text = "".join(f'{{"block_number":{i},"pad":"{"é" * (i % 7)}"}}\n' for i in range(200))
    write_log(scratch, F1, text)
    for split in (7, 64, 1 << 20):
        got = read_block_log(spark, scratch, splitBytes=split, now=NOW_LATE).orderBy("offset").collect()
        assert [tuple(r) for r in got] == expected_lines(text, F1), split


def test_torn_tail_open_vs_closed(spark, scratch):
    write_log(scratch, F1, '{"a":1}\n{"a":2}\n{"a":')
    open_rows = read_block_log(spark, scratch, now=NOW_OPEN).collect()
    closed_rows = read_block_log(spark, scratch, now=NOW_LATE).collect()
    assert [r["value"] for r in open_rows] == ['{"a":1}', '{"a":2}']
    assert sorted(r["value"] for r in closed_rows) == ['{"a":', '{"a":1}', '{"a":2}']


def test_starting_positions_catch_up(spark, scratch):
    write_log(scratch, F1, "a\nbb\nccc\n")
    write_log(scratch, F2, "d\n")
    write_log(scratch, "node_fills_by_block/hourly/20240101/4", "old\n")
    got = read_block_log(spark, scratch, startingPositions={F1: 2}, now=NOW_LATE).collect()
    assert sorted((r["file"], r["offset"], r["value"]) for r in got) == [(F1, 2, "bb"), (F1, 5, "ccc"), (F2, 0, "d")]


def test_ignores_paths_outside_the_layout(spark, scratch):
    write_log(scratch, F1, "a\n")
    write_log(scratch, "node_fills_by_block/hourly/20240101/24", "x\n")
    write_log(scratch, "node_fills_by_block/hourly/20240231/3", "x\n")
    write_log(scratch, "node_fills_by_block/daily/20240101/3", "x\n")
    assert [r["value"] for r in read_block_log(spark, scratch, now=NOW_LATE).collect()] == ["a"]


def _run_stream(spark, root, out, ckpt, **opts):
    q = (
        stream_block_log(spark, root, **opts)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert q.exception() is None


def test_stream_restart_no_loss_no_repeat(spark, scratch):
    root, out, ckpt = (os.path.join(scratch, x) for x in ("logs", "out", "ckpt"))
    write_log(root, F1, "l1\nl2\nl3-torn")
    _run_stream(spark, root, out, ckpt, now=NOW_OPEN)
    write_log(root, F1, "-rest\nl4\n", mode="a")
    _run_stream(spark, root, out, ckpt, now=NOW_OPEN)
    write_log(root, F2, "m1\n")  # a new hour appears
    write_log(root, F1, "l5\n", mode="a")
    _run_stream(spark, root, out, ckpt, now=NOW_LATE)
    _run_stream(spark, root, out, ckpt, now=NOW_LATE)  # nothing new: no repeat
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("file", "value").collect())
    assert got == sorted([(F1, "l1"), (F1, "l2"), (F1, "l3-torn-rest"), (F1, "l4"), (F1, "l5"), (F2, "m1")])
    # the offset log keeps closed hours out of the per-file map
    last = sorted(os.listdir(os.path.join(ckpt, "offsets")), key=lambda x: int(x) if x.isdigit() else -1)[-1]
    off = json.loads(open(os.path.join(ckpt, "offsets", last)).read().strip().split("\n")[-1])
    assert off["floor"]["node_fills_by_block"] == "2024010107"
    assert off["files"] == {}


def test_batch_equals_stream(spark, scratch):
    root, out, ckpt = (os.path.join(scratch, x) for x in ("logs", "out", "ckpt"))
    for h in range(3):
        write_log(root, f"misc_events_by_block/hourly/20240101/{h}", "".join(f"{h}-{i}\n" for i in range(50)))
    _run_stream(spark, root, out, ckpt, now=NOW_LATE, maxBytesPerTrigger=100)
    a = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    b = sorted(tuple(r) for r in read_block_log(spark, root, now=NOW_LATE).collect())
    assert a == b and len(a) == 150


def test_bounded_trigger(spark, scratch):
    root, out, ckpt = (os.path.join(scratch, x) for x in ("logs", "out", "ckpt"))
    for h in range(4):
        write_log(root, f"node_fills_by_block/hourly/20240101/{h}", "x" * 99 + "\n")
    _run_stream(spark, root, out, ckpt, now=NOW_LATE)
    write_log(root, "node_fills_by_block/hourly/20240101/5", "y\n")
    _run_stream(spark, root, out, ckpt, now=NOW_LATE, maxBytesPerTrigger=1)
    assert spark.read.parquet(out).where(F.col("value") == "y").count() == 1


def test_invalid_utf8_is_replaced_not_fatal(spark, scratch):
    path = os.path.join(scratch, F1)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b'{"a":"\xff"}\nok\n')
    got = sorted((r["offset"], r["value"]) for r in read_block_log(spark, scratch, now=NOW_LATE).collect())
    assert got == [(0, '{"a":"�"}'), (10, "ok")]


def test_publish_once_concurrent(spark, scratch):
    import threading

    from chainsift.sources.fixtures import publish_once

    final = os.path.join(scratch, "pub")
    calls = []

    def build(tmp):
        calls.append(tmp)
        write_log(tmp, F1, "a\nb\n")

    ts = [threading.Thread(target=publish_once, args=(spark, final, build)) for _ in range(3)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert os.path.exists(os.path.join(final, "_SUCCESS"))
    assert sorted(os.listdir(scratch)) == ["pub"]  # losers removed their copies
    assert publish_once(spark, final, build) == final and len(calls) <= 3


def test_catch_up_is_per_type(spark, scratch):
    # Q19: a saved position for fills does not stop misc from being read from its start.
    write_log(scratch, F1, "a\nb\n")
    write_log(scratch, "misc_events_by_block/hourly/20240101/2", "m\n")
    got = sorted((r["file"], r["value"]) for r in read_block_log(spark, scratch, startingPositions={F1: 2}, now=NOW_LATE).collect())
    assert got == sorted([(F1, "b"), ("misc_events_by_block/hourly/20240101/2", "m")])


def test_same_hour_other_day_is_not_current(spark, scratch):
    # Q20: the current-hour test compares date and hour; hour 5 of the previous day is closed.
    write_log(scratch, F1, "a\ntail")
    got = [r["value"] for r in read_block_log(spark, scratch, now="2024-01-02T05:30:00").collect()]
    assert sorted(got) == ["a", "tail"]


def test_hour_range_pruning(spark, scratch):
    for d, h in [("20240101", 3), ("20240101", 23), ("20240102", 0), ("20240103", 1)]:
        write_log(scratch, f"node_fills_by_block/hourly/{d}/{h}", f"{d}-{h}\n")
    got = sorted(r["value"] for r in read_block_log(
        spark, scratch, now=NOW_LATE, startHour="2024-01-01T23:00:00", endHour="2024-01-02T00:00:00").collect())
    assert got == ["20240101-23", "20240102-0"]
