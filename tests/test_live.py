"""Live pipeline (T1 T3 T6 T12) and default ingest time (K3)."""

import os

from helpers import write_log
from pyspark.sql import functions as F

from chainsift.operators.store import with_ingest_time
from chainsift.streaming.live import PipelineConfig, delivered_events, start_pipeline

F5 = "node_fills_by_block/hourly/20240101/5"
M5 = "misc_events_by_block/hourly/20240101/5"


def fill(block, user, oid):
    return f'{{"block_number":{block},"events":[["{user}",{{"oid":{oid}}}]]}}\n'


def misc(block, users):
    us = ",".join(f'"{u}"' for u in users)
    return f'{{"block_number":{block},"events":[{{"time":"t","hash":"h{block}","inner":{{"LedgerUpdate":{{"users":[{us}]}}}}}}]}}\n'


def test_default_ingest_time(spark):
    ev = spark.createDataFrame([("u", "fill", 1, "f", 0, 0, 0)] * 3, "user string, event string, block bigint, file string, offset bigint, event_pos int, user_pos int")
    rows = with_ingest_time(ev.withColumn("data", F.parse_json(F.lit("{}")))).select("created_at", "ingest_date").distinct().collect()
    assert len(rows) == 1 and rows[0]["created_at"] is not None


def test_live_pipeline_tails_and_refreshes(spark, scratch):
    root, wl_path = os.path.join(scratch, "logs"), os.path.join(scratch, "wl")
    spark.createDataFrame([("0xa", 1.0)], "address string, score double").write.parquet(wl_path)
    subs = spark.createDataFrame([(7, "subscribe", "fill", 1), (8, "subscribe", "misc", 2)], "client_id long, action string, event string, seq long").withColumn(
        "ts", F.current_timestamp()
    )
    write_log(root, F5, fill(1, "0xa", 1) + fill(2, "0xb", 2))
    cfg = PipelineConfig(
        root=root, store_path=os.path.join(scratch, "store"), checkpoint=os.path.join(scratch, "ckpt"),
        whitelist=lambda s: s.read.parquet(wl_path), subscriptions=lambda s: subs,
        delivery_path=os.path.join(scratch, "delivery"), options={"now": "2024-01-01T05:10:00"},
    )
    q = start_pipeline(spark, cfg, available_now=False, processing_time="200 milliseconds")
    try:
        q.processAllAvailable()
        # the whitelist grows: 0xb counts from now on, not for block 2 already stored
        spark.createDataFrame([("0xa", 1.0), ("0xb", 2.0)], "address string, score double").write.mode("overwrite").parquet(wl_path)
        write_log(root, F5, fill(3, "0xb", 3) + '{"block_number":4,"events":[["0xa",', mode="a")  # torn tail
        write_log(root, M5, misc(5, ["0xb", "0xz", "0xb"]))
        q.processAllAvailable()
        write_log(root, F5, '{"oid":4}]]}\n', mode="a")
        q.processAllAvailable()
        read = {t: sum(m["lines"] for m in q.metrics() if m["type"] == t) for t in ("node_fills_by_block", "misc_events_by_block")}
        assert read == {"node_fills_by_block": 4, "misc_events_by_block": 1}
    finally:
        q.stop()
    from chainsift.operators.store import read_store

    st = read_store(spark, cfg.store_path)
    got = sorted((r["user"], r["event"], r["block"]) for r in st.collect())
    assert got == [("0xa", "fill", 1), ("0xa", "fill", 4), ("0xb", "fill", 3), ("0xb", "misc", 5), ("0xb", "misc", 5)]
    d = delivered_events(spark, cfg.store_path, cfg.delivery_path)
    assert sorted((r["client_id"], r["block"]) for r in d.collect()) == [(7, 1), (7, 3), (7, 4), (8, 5), (8, 5)]
    # the stream wrote one row per change of a subscriber, not one per batch or delivery
    assert spark.read.parquet(os.path.join(cfg.delivery_path, "changes-*")).count() == 2


def test_batch_and_stream_share_one_store(spark, scratch):
    from chainsift.operators.parse import parse_fills
    from chainsift.operators.explode import explode_fills
    from chainsift.operators.store import append_events, read_store
    from chainsift.sources.blocklog import read_block_log
    from chainsift.streaming.live import run_available_now

    root, store = os.path.join(scratch, "logs"), os.path.join(scratch, "store")
    write_log(root, "node_fills_by_block/hourly/20240101/3", fill(1, "0xa", 1))
    # batch backfill of hour 3 ...
    old = explode_fills(parse_fills(read_block_log(spark, root, now="2024-01-02T00:00:00")))
    append_events(with_ingest_time(old), store)
    # ... then the live pipeline picks up hour 4 from a saved position into the same store
    write_log(root, "node_fills_by_block/hourly/20240101/4", fill(2, "0xa", 2))
    cfg = PipelineConfig(
        root=root, store_path=store, checkpoint=os.path.join(scratch, "ckpt"),
        whitelist=lambda s: s.createDataFrame([("0xa", 1.0)], "address string, score double"),
        types=("node_fills_by_block",),
        options={"now": "2024-01-02T00:00:00", "startingPositions": {"node_fills_by_block/hourly/20240101/4": 0}},
    )
    run_available_now(spark, cfg)
    got = sorted((r["block"], r["batch_id"]) for r in read_store(spark, store).collect())
    assert got == [(1, -1), (2, 0)]


def test_rejected_lines_of_the_live_run(spark, scratch):
    """They are published with the batch's events, a batch without commit shows none."""
    from chainsift.operators import store as S
    from chainsift.streaming.live import WhitelistCache, process_batch, read_bad_lines, run_available_now

    root = os.path.join(scratch, "logs")
    write_log(root, F5, fill(1, "0xa", 1) + "{broken\n" + "  \n" + '{"block_number":"x"}\n' + fill(2, "0xa", 2))
    write_log(root, M5, misc(3, ["0xa"]) + "[]\n")
    cfg = PipelineConfig(
        root=root, store_path=os.path.join(scratch, "store"), checkpoint=os.path.join(scratch, "ckpt"), bad_lines_path=os.path.join(scratch, "bad"),
        whitelist=lambda s: s.createDataFrame([("0xa", 1.0)], "address string, score double"), options={"now": "2024-01-02T00:00:00"},
    )
    assert read_bad_lines(spark, cfg).count() == 0
    run_available_now(spark, cfg)
    want = [("fill", '{"block_number":"x"}'), ("fill", "{broken"), ("misc", "[]")]
    assert sorted((r.event, r.value) for r in read_bad_lines(spark, cfg).collect()) == want
    assert S.read_store(spark, cfg.store_path).count() == 3

    lines = spark.createDataFrame([(F5, 0, "late and broken")], "file string, offset bigint, value string")
    real = S.commit
    try:
        S.commit = None  # the job dies before its commit
        try:
            process_batch(spark, cfg, "node_fills_by_block", lines, 7, "other", WhitelistCache(cfg))
        except TypeError:
            pass
    finally:
        S.commit = real
    assert os.path.isdir(os.path.join(scratch, "bad", "batch=other-fill-0000000007"))
    assert read_bad_lines(spark, cfg).count() == 3
    process_batch(spark, cfg, "node_fills_by_block", lines, 7, "other", WhitelistCache(cfg))
    S.fold_commits(cfg.store_path)
    assert read_bad_lines(spark, cfg).count() == 4
