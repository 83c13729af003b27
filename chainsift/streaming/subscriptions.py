"""Subscription state as keyed streaming state (T5).

Each client's state is the last action per event type, ordered by (ts, seq) and
not by arrival: a message that comes late changes nothing that a later one has
decided. Every change of a subscription is one row in the result, written with
its micro-batch, so storage and state grow with clients and changes only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chainsift.operators.subscriptions import valid_messages

LOG_DDL = "client_id BIGINT, action STRING, event STRING, ts TIMESTAMP, seq BIGINT"
CHANGES_DDL = "client_id BIGINT, event STRING, subscribed INT, ts_us BIGINT"
#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What a null seq counts as: before every other.
NO_SEQ = -(1 << 63)


class LastAction(StatefulProcessor):
    """One client: {event type: (ts, seq, subscribed)}; with ``silent_ms`` a client without messages for so long is unsubscribed."""

    def __init__(self, silent_ms: int | None = None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "event STRING", "ts_us BIGINT, seq BIGINT, subscribed INT")
        self.heard = handle.getValueState("heard", "ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        now = {k[0]: tuple(v) for k, v in self.last.iterator()} if self.last.exists() else {}
        before, latest = dict(now), None
        for pdf in rows:
            for event, ts, seq, on in zip(pdf.event, pdf.ts_us, pdf.seq, pdf.subscribed):
                own = (int(ts), int(seq), int(on))
                latest = own[0] if latest is None else max(latest, own[0])
                if event not in now or own[:2] > now[event][:2]:
                    now[event] = own
        for event, own in now.items():
            if own != before.get(event):
                self.last.updateValue((event,), own)
        if self.silent_ms is not None and latest is not None:
            old = self.heard.get()[0] if self.heard.exists() else None
            if old is None or latest // 1000 > old:
                if old is not None:
                    self.handle.deleteTimer(old + self.silent_ms)
                self.heard.update((latest // 1000,))
                self.handle.registerTimer(latest // 1000 + self.silent_ms)
        out = [(key[0], e, own[2], own[0]) for e, own in now.items() if own[2] != (before[e][2] if e in before else 0)]
        yield pd.DataFrame(out, columns=["client_id", "event", "subscribed", "ts_us"]).astype({"subscribed": "int32", "ts_us": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        on = [(k[0], tuple(v)) for k, v in self.last.iterator() if v[2] == 1]
        for event, own in on:
            self.last.updateValue((event,), (max(own[0], at), own[1], 0))
        self.heard.clear()
        yield pd.DataFrame([(key[0], e, 0, at) for e, _ in on], columns=["client_id", "event", "subscribed", "ts_us"]).astype({"subscribed": "int32", "ts_us": "int64"})

    def close(self) -> None:
        pass


def start_subscription_state(spark: SparkSession, log: DataFrame, out_path: str, checkpoint: str, silent_ms: int | None = None, delay: str = "1 hour"):
    """Follow a streamed log (LOG_DDL) and append the changes of every (client, event type) under ``<out_path>/batch=<n>``.

    With ``silent_ms`` event time ends silent connections, ``delay`` being how
    late messages may come. Messages without a client or a time are ignored.
    """
    messages = valid_messages(log.where("client_id is not null and ts is not null"))
    if silent_ms is not None:
        messages = messages.withWatermark("ts", delay)
    columns = ["client_id", "event", F.unix_micros("ts").alias("ts_us"), F.coalesce("seq", F.lit(NO_SEQ)).alias("seq"), (F.col("action") == "subscribe").cast("int").alias("subscribed")]
    rows = messages.select(*columns, *(["ts"] if silent_ms is not None else []))
    changes = rows.groupBy("client_id").transformWithStateInPandas(LastAction(silent_ms), CHANGES_DDL, "Update", "EventTime" if silent_ms is not None else "None")

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out_path}/batch={batch}")  # a retry writes the same folder again

    old = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    finally:
        if old is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], old)


def current_subscriptions(spark: SparkSession, out_path: str) -> DataFrame:
    """(client_id, event) subscribed after the last batch: the newest change of each."""
    rows = spark.read.schema(CHANGES_DDL + ", batch BIGINT").option("basePath", out_path).parquet(out_path)
    newest = rows.groupBy("client_id", "event").agg(F.max_by("subscribed", "batch").alias("on"))
    return newest.where("on = 1").select("client_id", "event")
