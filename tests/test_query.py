"""Pages, seek pages, height."""

import pytest
from helpers import lines_df
from pyspark.sql import functions as F

from chainsift.operators import query as Q
from chainsift.operators.parse import decode_fill_lines
from chainsift.plans.common import with_hour


def events(spark, n=57):
    rows = [(f"u{i % 5}", "fill" if i % 3 else "misc", 100 + i // 4, "f", i // 4, i % 4, 0) for i in range(n)]
    return spark.createDataFrame(rows, "user string, event string, block bigint, file string, offset bigint, event_pos int, user_pos int")


def test_argument_validation():
    with pytest.raises(ValueError):
        Q.validate_page_args(1, 2, 0, 10)
    with pytest.raises(ValueError):
        Q.validate_page_args(1, 2, 1, 0)
    with pytest.raises(ValueError):
        Q.validate_page_args(3, 2, 1, 10)


def test_offset_pages_equal_seek_pages(spark):
    ev = events(spark)
    size, full = 6, [tuple(r) for r in ev.where("block between 101 and 110").orderBy(*Q.PAGE_ORDER).collect()]
    pages, cursor = [], None
    while True:
        p = Q.events_after(ev, 101, 110, cursor, size).collect()
        if not p:
            break
        pages += [tuple(r) for r in p]
        cursor = p[-1].asDict()
    assert pages == full
    offset_pages = []
    for n in range(1, len(full) // size + 2):
        offset_pages += [tuple(r) for r in Q.events_by_block(ev, 101, 110, n, size).collect()]
    assert offset_pages == full


def test_latest_is_last_seen_not_max(spark):
    vals = ['{"block_number":10}', '{"block_number":12}', '{"block_number":11}', "junk"]
    d = with_hour(decode_fill_lines(lines_df(spark, vals)))
    assert Q.latest_height(d).first()["height"] == 11
    assert Q.max_height(d).first()["height"] == 12
    empty = d.where(F.lit(False))
    assert Q.latest_height(empty).first()["height"] == 0


def test_block_filter_reaches_parquet_scan(spark, scratch):
    ev = events(spark)
    ev.write.parquet(scratch + "/ev")
    plan = Q.events_by_block(spark.read.parquet(scratch + "/ev"), 101, 110, 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(block,101)" in plan


def test_page_json(spark):
    ev = events(spark, 12).withColumn("data", F.parse_json(F.concat(F.lit('{"k":'), F.col("block").cast("string"), F.lit("}"))))
    page = Q.events_by_block(ev, 101, 102, 1, 3)
    text = Q.page_json(page).first()["json"]
    import json

    rows = json.loads(text)
    assert [r["block"] for r in rows] == [101, 101, 101] and rows[0]["data"] == {"k": 101}
    empty = Q.page_json(Q.events_by_block(ev, 500, 600, 1, 3)).first()["json"]
    assert empty == "[]"
