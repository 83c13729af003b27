"""Stream form of T11: a source may give a span of the log again, each event is stored once.

The state is one row per whitelisted event (its lineage key, which names the
same event in every reading of its line) and is let go a fixed time after the
event first arrived. The clock of that time is the batch's own timestamp, not
the hour of the log: an old hour that is read late is then no late row, so
nothing is dropped but copies, and a retried batch sees the same clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainsift.operators import store as S
from chainsift.schemas import LINEAGE_KEY
from chainsift.streaming.live import EVENT_OF, run_id, type_events

#: How long after an event's first arrival its copies are recognised.
WITHIN = "2 days"


def first_arrivals(events: DataFrame, within: str = WITHIN) -> DataFrame:
    """Streaming events without the copies that arrive up to ``within`` after the first (later ones count as new)."""
    seen = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return seen.dropDuplicatesWithinWatermark(LINEAGE_KEY).drop("_arrived")


def start_deduped_events(
    spark: SparkSession, readers: list[DataFrame], log_type: str, whitelist: DataFrame, store_path: str, checkpoint: str,
    within: str = WITHIN, created_at=None, available_now: bool = True, processing_time: str = "5 seconds",
):
    """Store the whitelisted events of several streaming readers of one log type, whose spans may overlap, each once.

    A batch is one store segment and one commit, as in the live pipeline: a
    batch that is retried after its commit is skipped. Null lineage fields
    fail the job; empty lines and bad lines give no event.
    """
    run, event = run_id(checkpoint), EVENT_OF[log_type]
    S.create_store(spark, store_path)
    lines = reduce(DataFrame.unionByName, readers)
    events = first_arrivals(S.require_lineage(type_events(lines, log_type, whitelist)), within)

    def sink(df: DataFrame, batch_id: int) -> None:
        name = f"{run}-{event}-{batch_id:010d}"
        commits = S._commits(store_path)
        if S.batch_done(store_path, name, commits):
            return
        rows = S.check_rows(S.with_ingest_time(df, created_at)).withColumns({"run_id": F.lit(run), "batch_id": F.lit(batch_id)})
        units = S.write_segment(rows.sortWithinPartitions("ingest_date", "event", "block", *LINEAGE_KEY), store_path, name)
        S.commit(store_path, name, units, meta={"stream": True})
        S.tidy_commits(store_path, commits)

    w = events.writeStream.option("checkpointLocation", f"{checkpoint}/{log_type}").foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
