"""Building blocks shared by the named queries: lines, events, store, whitelist."""

from __future__ import annotations

import datetime as _dt
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainsift.functions.paths import decode_path
from chainsift.operators.explode import explode_fills, explode_misc_users, misc_payload, union_events
from chainsift.operators.membership import whitelisted
from chainsift.operators.parse import decode_fill_lines, parse_fills, parse_misc
from chainsift.operators.store import append_events, read_store, with_ingest_time
from chainsift.schemas import FILL_TYPE, MISC_TYPE
from chainsift.session import sub_dir
from chainsift.sources import fixtures
from chainsift.sources.blocklog import read_block_log

# Fixed parameters of the registered queries.
# (UTC-aware: PySpark reads naive datetimes in the driver's system time zone.)
AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0, tzinfo=_dt.timezone.utc)
INGEST_TS = _dt.datetime(2024, 2, 1, 0, 0, 0, tzinfo=_dt.timezone.utc)


def with_hour(lines: DataFrame) -> DataFrame:
    """Add hour_ts (and log type) decoded from the file path."""
    d = decode_path("file")
    return lines.withColumn("log_type", d["type"]).withColumn("hour_ts", d["hour_ts"])


def lines(spark: SparkSession, sf_dir: str, log_type: str) -> DataFrame:
    root = fixtures.fixture_root(spark, sf_dir)
    return read_block_log(spark, root, [log_type])


def fill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_fills(parse_fills(lines(spark, sf_dir, FILL_TYPE)))


def misc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_misc_users(parse_misc(lines(spark, sf_dir, MISC_TYPE)))


def whitelisted_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitelisted(fill_events(spark, sf_dir), fixtures.whitelist(spark, sf_dir))


def whitelisted_misc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misc_payload(whitelisted(misc_rows(spark, sf_dir), fixtures.whitelist(spark, sf_dir)))


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_events(whitelisted_fills(spark, sf_dir), whitelisted_misc(spark, sf_dir))


def decoded_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hour(decode_fill_lines(lines(spark, sf_dir, FILL_TYPE)))


def newest_height(spark: SparkSession, root: str) -> DataFrame:
    """A2: the last valid fill line's block, reading only the newest hours.

    Starts with the newest hour file; while that holds no valid line the
    range grows backwards (1, 2, 4, ... hour files). One row, 0 without any.
    """
    from chainsift.operators.query import latest_height
    from chainsift.sources.blocklog import list_block_log

    hour = decode_path("file")["hour_ts"]
    files, back = list_block_log(spark, root, [FILL_TYPE]).where("size > 0").select(hour.alias("h")), 1
    while True:
        first = files.orderBy(F.desc("h")).limit(back).agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
        if first["h"] is None:
            return latest_height(decode_fill_lines(spark.createDataFrame([], "file string, offset bigint, value string")).withColumn("hour_ts", hour))
        start = first["h"].astimezone(_dt.timezone.utc) if first["h"].tzinfo else first["h"]
        got = latest_height(with_hour(decode_fill_lines(read_block_log(spark, root, [FILL_TYPE], startHour=_utc_text(spark, start)))))
        if first["n"] < back or got.where("height > 0").limit(1).count():
            return got
        back *= 2


def _utc_text(spark: SparkSession, ts) -> str:
    """An instant as the source's hour option (UTC), whatever the driver's zone."""
    return spark.range(1).select(F.date_format(F.lit(ts), "yyyy-MM-dd'T'HH:mm:ss").alias("t")).first()["t"]


def store_path(spark: SparkSession, sf_dir: str) -> str:
    """The event store of all whitelisted events, written once per work folder."""
    tag = hashlib.sha1((fixtures.FIXTURE_VERSION + sf_dir.rstrip("/")).encode()).hexdigest()[:12]
    path = sub_dir(spark, "store", tag)
    return fixtures.publish_once(
        spark, path, lambda tmp: append_events(with_ingest_time(all_events(spark, sf_dir), F.lit(INGEST_TS)), tmp)
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(spark, store_path(spark, sf_dir))


def fill_columns(df: DataFrame) -> DataFrame:
    """Typed payload columns of fill events (for comparison with SQL)."""
    d = F.col("data")
    return df.select(
        "user", "event", "block", "event_pos",
        F.try_variant_get(d, "$.coin", "string").alias("coin"),
        F.try_variant_get(d, "$.px", "string").alias("px"),
        F.try_variant_get(d, "$.sz", "string").alias("sz"),
        F.try_variant_get(d, "$.side", "string").alias("side"),
        F.try_variant_get(d, "$.time", "bigint").alias("time"),
        F.try_variant_get(d, "$.oid", "bigint").alias("oid"),
        F.try_variant_get(d, "$.crossed", "boolean").alias("crossed"),
        F.try_variant_get(d, "$.tid", "bigint").alias("tid"),
    )


def misc_columns(df: DataFrame) -> DataFrame:
    d = F.col("data")
    return df.select(
        "user", "event", "block", "event_pos", "user_pos",
        F.try_variant_get(d, "$.hash", "string").alias("hash"),
        F.try_variant_get(d, "$.time", "string").alias("time"),
        F.try_variant_get(d, "$.LedgerUpdate.delta.type", "string").alias("delta_type"),
        F.try_variant_get(d, "$.LedgerUpdate.delta.usdc", "string").alias("usdc"),
    )


def resume_position(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A saved position: start of the first valid fill line at or after the middle block."""
    from chainsift.sources.tables import table

    top = table(spark, sf_dir, "events").agg(F.max("event_id").alias("m")).first()["m"]
    target = fixtures.BASE_BLOCK + (top // 4) // 2
    d = decode_fill_lines(lines(spark, sf_dir, FILL_TYPE))
    r = d.where(F.col("reason").isNull() & (F.col("block") >= target)).orderBy("block", "offset").select("file", "offset").first()
    return r["file"], int(r["offset"])


def resumed_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill events read through the source from the saved position (catch-up)."""
    f, pos = resume_position(spark, sf_dir)
    root = fixtures.fixture_root(spark, sf_dir)
    src = read_block_log(spark, root, [FILL_TYPE], startingPositions={f: pos})
    return explode_fills(parse_fills(src))
