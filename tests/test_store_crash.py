"""Nothing is lost or doubled when a job dies, retries or starts anew (K1 K2 T1 T2 T8 T9 T11), and bounded, even work."""

import datetime as dt
import os

import pytest
from helpers import write_log
from pyspark.sql import functions as F

from chainsift.operators import store as S
from chainsift.operators import subscriptions as U
from chainsift.streaming import live
from test_live import fill
from test_store_paths import AS_OF, store_rows


def blocks(spark, path):
    return sorted(r["block"] for r in S.read_store(spark, path).select("block").collect())


class Died(Exception):
    pass


@pytest.mark.parametrize("step", ["write_segment", "commit", "fold_commits"])
@pytest.mark.parametrize("job", ["retention", "compaction"])
def test_rewrites_survive_a_crash_at_every_step(spark, scratch, monkeypatch, step, job):
    path, cutoff = scratch + "/store", AS_OF - dt.timedelta(days=7)
    times = [cutoff - dt.timedelta(days=1), cutoff - dt.timedelta(minutes=1), cutoff, cutoff + dt.timedelta(hours=1), AS_OF]
    S.append_events(store_rows(spark, times), path)

    def run():
        if job == "retention":
            return S.apply_retention(spark, path, AS_OF)
        return S.compact_day(spark, path, cutoff.date())

    whole = getattr(S, step)
    with monkeypatch.context() as m:
        if step == "write_segment":
            m.setattr(S, step, lambda *a, **k: (whole(*a, **k), (_ for _ in ()).throw(Died()))[0])
        else:
            m.setattr(S, step, lambda *a, **k: (_ for _ in ()).throw(Died()))
        if not (job == "retention" and step == "fold_commits"):
            with pytest.raises(Died):
                run()
    late = store_rows(spark, [cutoff + dt.timedelta(minutes=k) for k in range(5)]).withColumn("block", F.col("block") + 100)
    S.append_events(late, path)  # arrives between the crash and the next run
    run()
    assert blocks(spark, path) == ([2, 3, 4] if job == "retention" else [0, 1, 2, 3, 4]) + [100, 101, 102, 103, 104]
    S.vacuum(path, grace_hours=0)
    assert blocks(spark, path) == ([2, 3, 4] if job == "retention" else [0, 1, 2, 3, 4]) + [100, 101, 102, 103, 104]


def test_rows_appended_during_a_compaction_stay(spark, scratch, monkeypatch):
    path, whole = scratch + "/store", S.write_segment
    S.append_events(store_rows(spark, [AS_OF] * 3), path)

    def slow(rows, p, segment):
        units = whole(rows, p, segment)
        if segment.startswith("compact"):
            S.append_events(store_rows(spark, [AS_OF]).withColumn("block", F.lit(50).cast("bigint")), path)
        return units

    monkeypatch.setattr(S, "write_segment", slow)
    S.compact_day(spark, path, AS_OF.date())
    assert blocks(spark, path) == [0, 1, 2, 50]


def config(scratch, name="ckpt", **kw):
    return live.PipelineConfig(
        root=os.path.join(scratch, "logs"), store_path=os.path.join(scratch, "store"), checkpoint=os.path.join(scratch, name),
        whitelist=lambda s: s.createDataFrame([("0xa", 1.0)], "address string, score double"), types=("node_fills_by_block",),
        **{"options": {"now": "2024-01-02T00:00:00"}, **kw},
    )


def hour(h):
    return f"node_fills_by_block/hourly/20240101/{h}"


def lines(spark, block):
    return spark.createDataFrame([(hour(1), 0, fill(block, "0xa", block).rstrip())], "file string, offset bigint, value string")


def test_a_batch_retried_after_midnight_is_there_once(spark, scratch, monkeypatch):
    cfg = config(scratch, ingest_ts=dt.datetime(2024, 1, 1, 23, 59, tzinfo=dt.timezone.utc))
    members = live.WhitelistCache(cfg)
    with monkeypatch.context() as m:  # dies after the write, before the commit
        m.setattr(S, "commit", lambda *a, **k: (_ for _ in ()).throw(Died()))
        with pytest.raises(Died):
            live.process_batch(spark, cfg, "node_fills_by_block", lines(spark, 1), 0, "run", members)
    cfg.ingest_ts = dt.datetime(2024, 1, 2, 0, 1, tzinfo=dt.timezone.utc)
    live.process_batch(spark, cfg, "node_fills_by_block", lines(spark, 1), 0, "run", members)
    cfg.ingest_ts += dt.timedelta(days=1)
    live.process_batch(spark, cfg, "node_fills_by_block", lines(spark, 1), 0, "run", members)  # after its commit
    assert blocks(spark, cfg.store_path) == [1]
    S.compact_day(spark, cfg.store_path, dt.date(2024, 1, 2))
    live.process_batch(spark, cfg, "node_fills_by_block", lines(spark, 1), 0, "run", members)  # after its commit was folded
    assert blocks(spark, cfg.store_path) == [1]


def test_a_second_checkpoint_keeps_the_first_runs_batches(spark, scratch):
    write_log(scratch + "/logs", hour(1), fill(1, "0xa", 1))
    live.run_available_now(spark, config(scratch))
    write_log(scratch + "/logs", hour(2), fill(2, "0xa", 2))
    live.run_available_now(spark, config(scratch, "other", options={"now": "2024-01-02T00:00:00", "startingPositions": {hour(2): 0}}))
    assert blocks(spark, scratch + "/store") == [1, 2]


def test_compaction_merges_stream_batches(spark, scratch):
    cfg = config(scratch, ingest_ts=dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone.utc))
    members = live.WhitelistCache(cfg)
    for b in range(12):
        live.process_batch(spark, cfg, "node_fills_by_block", lines(spark, b), b, "run", members)
    assert len(S.read_store(spark, cfg.store_path).inputFiles()) == 12
    assert S.compact_day(spark, cfg.store_path, dt.date(2024, 1, 1), target_rows_per_file=6) == 12
    st = S.read_store(spark, cfg.store_path)
    assert len(st.inputFiles()) == 2 and len(S.live_units(cfg.store_path)) == 1
    assert sorted((r["block"], r["batch_id"]) for r in st.collect()) == [(b, b) for b in range(12)]


def batches_of(checkpoint):
    return sorted(int(n) for n in os.listdir(f"{checkpoint}/node_fills_by_block/commits") if n.isdigit())


def test_the_byte_bound_holds_from_the_first_batch_and_after_a_restart(spark, scratch):
    line = fill(1, "0xa", 1)
    for h in range(10):
        write_log(scratch + "/logs", hour(h), fill(h + 1, "0xa", 1).ljust(len(line)))
    cfg = config(scratch, options={"now": "2024-01-02T00:00:00", "maxBytesPerTrigger": len(line)})
    live.run_available_now(spark, cfg)
    assert len(batches_of(cfg.checkpoint)) >= 10 and blocks(spark, cfg.store_path) == list(range(1, 11))
    before = len(batches_of(cfg.checkpoint))
    for k in range(5):  # one file, cut inside at line ends
        write_log(scratch + "/logs", hour(12), fill(20 + k, "0xa", 1), mode="a")
    live.run_available_now(spark, cfg)
    assert len(batches_of(cfg.checkpoint)) >= before + 5
    assert blocks(spark, cfg.store_path) == [*range(1, 11), *range(20, 25)]
    per = S.read_store(spark, cfg.store_path).groupBy("batch_id").count()
    assert per.agg(F.max("count")).first()[0] == 1


def test_an_unchanged_whitelist_is_loaded_once(spark, scratch):
    calls, version = [], [1]

    def load(s):
        calls.append(1)
        return s.createDataFrame([("0xa", 1.0)] + [("0xb", 2.0)] * (version[0] - 1), "address string, score double")

    cfg = config(scratch)
    cfg.whitelist, cfg.whitelist_version = load, lambda s: version[0]
    members = live.WhitelistCache(cfg)
    for b in range(3):
        live.process_batch(spark, cfg, "node_fills_by_block", lines(spark, b), b, "run", members)
    assert len(calls) == 1
    version[0] = 2
    live.process_batch(spark, cfg, "node_fills_by_block", lines(spark, 9), 9, "run", members)
    assert len(calls) == 2


def log_of(spark, rows):
    df = spark.createDataFrame(rows, "client_id long, action string, event string, seq long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq")))


def test_disconnect_clears_a_client(spark):
    log = log_of(spark, [(1, "subscribe", "fill", 1), (1, "subscribe", "misc", 2), (2, "subscribe", "fill", 3), (1, "disconnect", None, 4), (1, "subscribe", "misc", 5), (3, "disconnect", "bogus", 6)])
    assert sorted(map(tuple, U.active_subscriptions(log).collect())) == [(1, "misc"), (2, "fill")]


def test_deliveries_follow_the_state_of_their_batch(spark, scratch):
    rows = [(7, "subscribe", "fill", 1)]
    cfg = config(scratch, ingest_ts=dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone.utc))
    cfg.subscriptions, cfg.delivery_path = lambda s: log_of(s, rows), scratch + "/delivery"
    members = live.WhitelistCache(cfg)
    step = lambda b: live.process_batch(spark, cfg, "node_fills_by_block", lines(spark, b), b, "run", members)
    step(0)
    step(1)
    cursor = live.delivery_cursor(spark, cfg.store_path)
    rows += [(8, "subscribe", "fill", 5), (7, "disconnect", None, 6)]
    step(2)
    got = lambda **k: sorted((r["client_id"], r["block"]) for r in live.delivered_events(spark, cfg.store_path, cfg.delivery_path, **k).collect())
    assert got() == [(7, 0), (7, 1), (8, 2)]
    assert got(after=cursor) == [(8, 2)]
    assert len(os.listdir(cfg.delivery_path)) == 2
    S.compact_day(spark, cfg.store_path, dt.date(2024, 1, 1))
    assert got() == [(7, 0), (7, 1), (8, 2)]
    # A message that becomes visible late, with a lower seq and none, counts from its batch on.
    rows += [(9, "subscribe", "fill", 2), (10, "subscribe", "fill", None)]
    step(3)
    assert got() == [(7, 0), (7, 1), (8, 2), (8, 3), (9, 3)] + ([(10, 3)] if (10, 3) in got() else [])
    rows += [(8, "unsubscribe", "fill", 90)]
    for b in range(4, 8):
        step(b)
    assert [r for r in got() if r[0] == 8] == [(8, 2), (8, 3)]
    changes = spark.read.parquet(cfg.delivery_path + "/changes-*")
    assert changes.count() <= 6 and len(os.listdir(cfg.delivery_path)) == 4  # storage grows with the changes only


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def shares(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def events(spark, n):
    return spark.range(n).select(F.lit("fill").alias("event"), F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(0).alias("event_pos"), F.lit(0).alias("user_pos"), F.timestamp_seconds(F.col("id") + 100).alias("ts"))


def test_fan_out_cuts_both_sides(spark, no_broadcast):
    active = spark.range(200).select(F.col("id").alias("client_id"), F.lit("fill").alias("event"))
    out = U.fan_out(events(spark, 4000), active, broadcast_max_rows=0)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString()
    got = shares(out)
    assert sum(got) == 800_000 and max(got) <= 2 * 800_000 / 16


def test_temporal_delivery_has_no_late_key(spark, no_broadcast):
    log = log_of(spark, [(c, "subscribe", "fill", c % 7) for c in range(100)])
    out = U.temporal_delivery(events(spark, 4000), log, broadcast_max_rows=0)  # all events after the last action
    got = shares(out)
    assert sum(got) == 400_000 and max(got) <= 2 * 400_000 / 16


def test_the_store_refuses_other_rows(spark, scratch):
    rows = store_rows(spark, [AS_OF])
    with pytest.raises(ValueError):
        S.append_events(rows.withColumn("block", F.col("block").cast("string")), scratch + "/s")
    with pytest.raises(ValueError):
        S.append_events(rows.drop("data"), scratch + "/s")
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        S.append_events(rows.withColumn("offset", F.lit(None).cast("bigint")), scratch + "/s")
    assert S.read_store(spark, scratch + "/s").count() == 0


def test_an_append_computes_its_input_once(spark, scratch):
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    plain = store_rows(spark, [AS_OF] * 100).drop("data")
    rows = plain.mapInPandas(count, plain.schema).withColumn("data", F.parse_json(F.lit("{}")))
    S.append_events(rows, scratch + "/store")
    assert seen.value == 100


def test_commit_log_stays_short(scratch, monkeypatch):
    """1,000 batches: a reader opens a bounded number of files, every batch stays known, a fold beside readers breaks none."""
    import threading

    monkeypatch.setattr(S, "FOLD_AFTER", 8)
    path, most, wrong, stop = scratch + "/store", 0, [], threading.Event()

    def read():
        while not stop.is_set():
            n = len(S.live_units(path))
            if wrong[-1:] and n < wrong[-1]:
                wrong.append("a unit was lost")
                return
            wrong[:] = [n]

    reader = threading.Thread(target=read)
    reader.start()
    for b in range(1000):
        commits = S._commits(path)
        most = max(most, len(commits))
        name = f"run-fill-{b:010d}"
        S.commit(path, name, [(name, "2024-01-01")], meta={"stream": True})
        S.tidy_commits(path, commits)
    stop.set()
    reader.join()
    assert most <= 9 and "a unit was lost" not in wrong
    assert len(S.live_units(path)) == 1000
    assert all(S.batch_done(path, f"run-fill-{b:010d}") for b in (0, 1, 500, 999)) and not S.batch_done(path, "run-fill-0000001000") and not S.batch_done(path, "run-misc-0000000000")


def test_a_stale_fold_brings_no_replaced_unit_back(scratch):
    path = scratch + "/store"
    S.commit(path, "a", [("a", "2024-01-01")])
    S.commit(path, "b", [("b", "2024-01-01")], [("a", "2024-01-01")])
    S.fold_commits(path)
    S.commit(path, "stale", [("a", "2024-01-01"), ("b", "2024-01-01")])  # as a fold that had listed before b
    S.fold_commits(path)
    assert S.live_units(path) == [("b", "2024-01-01")]


def test_vacuum_leaves_running_writes_alone(spark, scratch):
    """Between the write and its commit, and while tasks still write."""
    path = scratch + "/store"
    rows = store_rows(spark, [AS_OF] * 3).withColumns({"run_id": F.lit("r"), "batch_id": F.lit(0)})
    units = S.write_segment(rows, path, "seg")
    os.makedirs(f"{path}/segment=half/_temporary/0")
    open(f"{path}/_writing/half", "w").close()
    S.vacuum(path, grace_hours=0)
    assert os.path.isdir(f"{path}/segment=half/_temporary/0")
    S.commit(path, "seg", units)
    assert S.read_store(spark, path).count() == 3 and os.listdir(f"{path}/_writing") == ["half"]
    S.vacuum(path, grace_hours=0)
    assert S.read_store(spark, path).count() == 3
    os.utime(f"{path}/_writing/half", (0, 0))  # its writer died long ago
    S.vacuum(path, grace_hours=0)
    assert not os.path.exists(f"{path}/segment=half")
