"""File positions and hour enumeration."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainsift.functions.paths import hour_path


def positions(lines: DataFrame) -> DataFrame:
    """A3: per file, the byte position after its last line read (offset + bytes + newline)."""
    end = F.col("offset") + F.octet_length("value") + F.lit(1)
    return lines.groupBy("file").agg(F.max(end).cast("bigint").alias("position"))


def _epoch(t) -> int:
    """Epoch seconds of an int, an aware datetime, or a naive datetime taken as UTC."""
    if isinstance(t, (int, float)):
        return int(t)
    if t.tzinfo is None:
        t = t.replace(tzinfo=_dt.timezone.utc)
    return int(t.timestamp())


def files_between(spark: SparkSession, log_type: str, start, end) -> DataFrame:
    """One hour path per hour from start's hour to end inclusive (distributed range).

    ``start``/``end``: epoch seconds or datetimes (naive = UTC).
    """
    s = _epoch(start) // 3600
    e = _epoch(end) // 3600
    hours = spark.range(s, e + 1).select(F.timestamp_seconds(F.col("id") * 3600).alias("hour_ts"))
    return hours.select(hour_path(log_type, "hour_ts").alias("file"), "hour_ts")


def newest_lines(spark: SparkSession, root: str, log_type: str) -> DataFrame:
    """Lines of the newest hour file of a type that has any byte (found by listing; older files are not opened)."""
    from chainsift.functions.paths import decode_path
    from chainsift.sources.blocklog import list_block_log, read_block_log

    files = list_block_log(spark, root, [log_type]).where("size > 0")
    top = files.agg(F.max_by("file", decode_path("file")["hour_ts"]).alias("f")).first()["f"]
    if top is None:
        return spark.createDataFrame([], "file string, offset bigint, value string")
    return read_block_log(spark, root, [log_type], startingPositions={top: 0})


def save_positions(lines: DataFrame, path: str) -> None:
    """K5: per log type, the last file read and the byte position reached in it."""
    from chainsift.functions.paths import decode_path

    p = positions(lines).withColumn("_d", decode_path("file"))
    last = p.groupBy(F.col("_d.type").alias("log_type")).agg(
        F.max_by(F.struct("file", "position"), F.col("_d.hour_ts")).alias("p")
    )
    last.select("log_type", "p.file", "p.position").write.mode("overwrite").parquet(path)


def saved(spark: SparkSession, path: str) -> DataFrame:
    """The saved positions (log_type, file, position)."""
    return spark.read.parquet(path)


def load_positions(spark: SparkSession, path: str) -> dict:
    """Saved positions as the source's ``startingPositions`` (one row per log type).

    Types are independent: a type without a saved position simply starts from
    its oldest file.
    """
    return {r["file"]: int(r["position"]) for r in saved(spark, path).select("file", "position").collect()}
