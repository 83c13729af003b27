"""T11 in the stream: overlapping readers, restarts, old hours that come late."""

import os

from helpers import write_log

from chainsift.operators.store import read_store
from chainsift.schemas import FILL_TYPE
from chainsift.sources.blocklog import stream_block_log
from chainsift.streaming.dedupe import start_deduped_events

F4 = "node_fills_by_block/hourly/20240101/4"
F5 = "node_fills_by_block/hourly/20240101/5"


def fill(block, users):
    return f'{{"block_number":{block},"events":[{",".join(f"""["{u}",{{"oid":1}}]""" for u in users)}]}}\n'


def test_repeated_spans_are_stored_once_across_restarts(spark, scratch):
    root, store, ckpt = (os.path.join(scratch, n) for n in ("logs", "store", "ckpt"))
    wl = spark.createDataFrame([("0xa", 1.0), ("0xb", 1.0)], "address string, score double")
    first = fill(1, ["0xa", "0xz"])
    write_log(root, F5, first + "not json\n" + fill(2, ["0xb", "0xb"]))

    def run():
        again = {F5: len(first)}  # a second reader that starts inside the file: everything after is read twice
        opts = {"now": "2024-01-01T05:10:00"}
        readers = [stream_block_log(spark, root, [FILL_TYPE], **opts), stream_block_log(spark, root, [FILL_TYPE], startingPositions=again, **opts)]
        q = start_deduped_events(spark, readers, FILL_TYPE, wl, store, ckpt)
        q.awaitTermination()
        assert q.exception() is None
        return sorted((r["user"], r["block"], r["event_pos"]) for r in read_store(spark, store).collect())

    once = [("0xa", 1, 0), ("0xb", 2, 0), ("0xb", 2, 1)]  # equal events of one line are different events
    assert run() == once
    write_log(root, F5, fill(3, ["0xa"]), mode="a")
    write_log(root, F4, fill(9, ["0xb"]))  # an earlier hour, after a later one was read
    assert run() == sorted([*once, ("0xa", 3, 0), ("0xb", 9, 0)])
    assert run() == sorted([*once, ("0xa", 3, 0), ("0xb", 9, 0)])


def test_equal_lineage_in_one_batch_is_one_event(spark, scratch):
    root, store, ckpt = (os.path.join(scratch, n) for n in ("logs", "store", "ckpt"))
    wl = spark.createDataFrame([("0xa", 1.0)], "address string, score double")
    write_log(root, F5, fill(1, ["0xa"]) * 3)
    readers = [stream_block_log(spark, root, [FILL_TYPE], now="2024-01-01T05:10:00") for _ in range(3)]
    start_deduped_events(spark, readers, FILL_TYPE, wl, store, ckpt).awaitTermination()
    assert sorted(r["offset"] for r in read_store(spark, store).collect()) == [k * len(fill(1, ["0xa"])) for k in range(3)]
