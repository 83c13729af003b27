"""Store retention and dedupe (P16 T8 T11 A4), paths (S3 S4 S5), positions (A3)."""

import datetime as dt

from helpers import lines_df
from pyspark.sql import functions as F

from chainsift.functions import decode_path, hour_path
from chainsift.operators.positions import files_between, positions
from chainsift.operators.store import apply_retention, dedupe, expired_count, read_store, retain, append_events, with_ingest_time

AS_OF = dt.datetime(2024, 1, 31)


def store_rows(spark, times):
    rows = [(f"u{i}", "fill", i, f"f{i}", i, 0, 0, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "user string, event string, block bigint, file string, offset bigint, event_pos int, user_pos int, created_at timestamp")
    return with_ingest_time(df.withColumn("data", F.parse_json(F.lit("{}"))), F.col("created_at"))


def test_retention_boundary_and_in_place(spark, scratch):
    cutoff = AS_OF - dt.timedelta(days=7)
    times = [cutoff - dt.timedelta(days=3), cutoff - dt.timedelta(microseconds=1), cutoff, cutoff + dt.timedelta(hours=5), AS_OF]
    rows = store_rows(spark, times)
    assert retain(rows, AS_OF).count() == 3
    assert expired_count(rows, AS_OF).first()["removed"] == 2
    path = scratch + "/store"
    append_events(rows, path)
    assert apply_retention(spark, path, AS_OF) == 2
    assert sorted(r["block"] for r in read_store(spark, path).collect()) == [2, 3, 4]
    assert apply_retention(spark, path, AS_OF) == 0


def test_dedupe_by_lineage(spark):
    rows = store_rows(spark, [AS_OF] * 3)
    assert dedupe(rows.unionByName(rows)).count() == 3


def test_paths(spark):
    df = spark.createDataFrame(
        [("node_fills_by_block/hourly/20240101/0",), ("x/node_fills_by_block/hourly/20240229/23",),
         ("node_fills_by_block/hourly/20240231/1",), ("node_fills_by_block/hourly/20241301/1",),
         ("node_fills_by_block/hourly/20240101/24",), ("node_fills_by_block/daily/20240101/1",)],
        "p string",
    )
    d = df.select("p", decode_path("p").alias("d")).collect()
    ok = [r["p"] for r in d if r["d"]["hour_ts"] is not None]
    assert ok == ["node_fills_by_block/hourly/20240101/0", "x/node_fills_by_block/hourly/20240229/23"]
    hp = spark.createDataFrame([(dt.datetime(2024, 1, 2, 7, 59),)], "ts timestamp").select(hour_path("misc_events_by_block", "ts")).first()[0]
    assert hp == "misc_events_by_block/hourly/20240102/7"
    fb = [r["file"] for r in files_between(spark, "t", dt.datetime(2024, 1, 1, 22, 30), dt.datetime(2024, 1, 2, 1, 0)).orderBy("hour_ts").collect()]
    assert fb == ["t/hourly/20240101/22", "t/hourly/20240101/23", "t/hourly/20240102/0", "t/hourly/20240102/1"]


def test_positions_count_bytes(spark):
    df = lines_df(spark, ["ab", "é", ""])
    assert positions(df).first()["position"] == 3 + 3 + 1


def test_saved_positions_round_trip(spark, scratch):
    from chainsift.operators.positions import load_positions, save_positions

    rows = [("node_fills_by_block/hourly/20240101/3", 0, "ab"), ("node_fills_by_block/hourly/20240101/4", 0, "abc"),
            ("node_fills_by_block/hourly/20240101/4", 4, "d"), ("misc_events_by_block/hourly/20240101/1", 0, "x")]
    df = spark.createDataFrame(rows, "file string, offset bigint, value string")
    save_positions(df, scratch + "/pos")
    assert load_positions(spark, scratch + "/pos") == {
        "node_fills_by_block/hourly/20240101/4": 6, "misc_events_by_block/hourly/20240101/1": 2,
    }


def test_create_store_idempotent_and_json(spark, scratch):
    from chainsift.operators.query import as_json
    from chainsift.operators.store import create_store

    create_store(spark, scratch + "/s")
    create_store(spark, scratch + "/s")
    assert read_store(spark, scratch + "/s").count() == 0
    ev = spark.createDataFrame([("u", "fill", 5)], "user string, event string, block bigint").withColumn(
        "data", F.parse_json(F.lit('{"b":1,"a":"x"}'))
    )
    assert as_json(ev).first()["json"] == '{"user":"u","event":"fill","block":5,"data":{"a":"x","b":1}}'


def test_compact_day(spark, scratch):
    from chainsift.operators.store import compact_day

    path = scratch + "/store"
    rows = store_rows(spark, [AS_OF + dt.timedelta(minutes=i) for i in range(40)])
    for i in range(4):  # four small appends
        append_events(rows.where(F.col("block") % 4 == i), path)
    before = sorted(tuple(r) for r in read_store(spark, path).drop("data", "segment").collect())
    assert compact_day(spark, path, AS_OF.date(), target_rows_per_file=15) == 40
    after = read_store(spark, path)
    assert sorted(tuple(r) for r in after.drop("data", "segment").collect()) == before
    assert len(after.inputFiles()) == 3


def test_compaction_tasks_stay_small_by_default(spark, scratch):
    """A day of many rows is sorted in several tasks: one task's memory does not follow the day."""
    from chainsift.operators.store import FILE_ROWS, compact_day

    n = FILE_ROWS + 100_000
    rows = spark.range(n).select(
        F.lit("u").alias("user"), F.lit("fill").alias("event"), F.col("id").alias("block"), F.parse_json(F.lit("{}")).alias("data"),
        F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(0).alias("event_pos"), F.lit(0).alias("user_pos"),
    )
    path = scratch + "/store"
    append_events(with_ingest_time(rows, F.lit(AS_OF)), path)
    assert compact_day(spark, path, AS_OF.date()) == n
    files = read_store(spark, path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi")).orderBy("lo").collect()
    assert len(files) > 1 and max(f["n"] for f in files) <= FILE_ROWS
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:]))


def test_writers_follow_the_rows(spark, scratch):
    from chainsift.sources.fixtures import WRITER_ROWS, writers

    for name, n in (("events", 20 * WRITER_ROWS), ("orders", 5)):
        spark.range(n).write.parquet(f"{scratch}/{name}.parquet")
    assert writers(spark, scratch, "events", "orders") == 21
    assert writers(spark, scratch, "orders") == spark.sparkContext.defaultParallelism
