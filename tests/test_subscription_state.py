"""T5: keyed subscription state over a streamed log."""

import random

from pyspark.sql import functions as F

from chainsift.operators import subscriptions as U
from chainsift.streaming.subscriptions import LOG_DDL, current_subscriptions, start_subscription_state


def run(spark, log, out, ckpt, **k):
    src = spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", 1).parquet(log)
    q = start_subscription_state(spark, src, out, ckpt, **k)
    q.awaitTermination()
    assert q.exception() is None


def frame(spark, rows):
    df = spark.createDataFrame(rows, "client_id long, action string, event string, t double, seq long")
    return df.select("client_id", "action", "event", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "seq")


def test_equals_the_batch_state_out_of_order_with_restart(spark, scratch):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.choice(["subscribe", "subscribe", "unsubscribe", "disconnect", "bogus"]), rng.choice(["fill", "misc", "other", None]), float(rng.randrange(40)), k) for k in range(300)]
    rng.shuffle(rows)
    log = scratch + "/log"
    for part in (rows[:150], rows[150:]):  # a restart in between
        for k in range(0, len(part), 50):
            frame(spark, part[k: k + 50]).coalesce(1).write.mode("append").parquet(log)
        run(spark, log, scratch + "/out", scratch + "/ckpt")
    want = sorted(map(tuple, U.active_subscriptions(frame(spark, rows)).collect()))
    assert sorted(map(tuple, current_subscriptions(spark, scratch + "/out").collect())) == want


def test_silent_clients_are_ended(spark, scratch):
    log = scratch + "/log"
    steps = [[(1, "subscribe", "fill", 10.0, 1), (2, "subscribe", "misc", 10.0, 2)], [(1, "subscribe", "misc", 55.0, 3)], [(3, "subscribe", "fill", 100.0, 4)], [(3, "subscribe", "misc", 101.0, 5)]]
    for rows in steps:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(log)
        run(spark, log, scratch + "/out", scratch + "/ckpt", silent_ms=60_000, delay="1 second")
    assert sorted(map(tuple, current_subscriptions(spark, scratch + "/out").collect())) == [(1, "fill"), (1, "misc"), (3, "fill"), (3, "misc")]
