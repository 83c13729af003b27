"""Explode rules."""

from helpers import lines_df
from pyspark.sql import functions as F

from chainsift.operators.explode import explode_fills, explode_misc
from chainsift.operators.parse import parse_fills, parse_misc


def test_fill_tuple_shape(spark):
    line = (
        '{"block_number":9,"events":[["0xa",{"px":"1"}],["0xb"],[7,{}],["0xc",[1]],'
        '["0xd",{"tid":320000000000000001},9],null,["0xe","s"]]}'
    )
    ev = explode_fills(parse_fills(lines_df(spark, [line]))).orderBy("event_pos").collect()
    assert [(r["user"], r["event_pos"]) for r in ev] == [("0xa", 0), ("0xd", 4)]
    # integers above 2^53 stay exact (Q10)
    tid = explode_fills(parse_fills(lines_df(spark, [line]))).where("user = '0xd'").select(
        F.try_variant_get("data", "$.tid", "bigint").alias("t")
    ).first()["t"]
    assert tid == 320000000000000001


def test_negative_fill_block_keeps_line_drops_events(spark):
    df = lines_df(spark, ['{"block_number":-5,"events":[["0xa",{}]]}'])
    assert parse_fills(df).count() == 1
    assert explode_fills(parse_fills(df)).count() == 0


def test_misc_users_repeats_order_and_payload(spark):
    line = (
        '{"block_number":3,"events":[{"time":"T","hash":"H","inner":{"hash":"old","time":"x",'
        '"LedgerUpdate":{"users":["u1","u1",7,null,"u2"]}}},'
        '{"inner":{"CDeposit":{}}},{"inner":{"LedgerUpdate":{"users":"u9"}}},'
        '{"inner":{"LedgerUpdate":{"users":["u3"]}}}]}'
    )
    ev = explode_misc(parse_misc(lines_df(spark, [line], "misc_events_by_block/hourly/20240101/0")))
    rows = ev.select(
        "user", "event_pos", "user_pos",
        F.try_variant_get("data", "$.hash", "string").alias("h"),
        F.try_variant_get("data", "$.time", "string").alias("t"),
    ).orderBy("event_pos", "user_pos").collect()
    assert [(r["user"], r["event_pos"], r["user_pos"]) for r in rows] == [
        ("u1", 0, 0), ("u1", 0, 1), ("u2", 0, 4), ("u3", 3, 0),
    ]
    assert (rows[0]["h"], rows[0]["t"]) == ("H", "T")  # outer values overwrite inner keys
    assert (rows[3]["h"], rows[3]["t"]) == ("", "")  # absent outer values -> ""


def test_quotes_in_data_are_stored_typed(spark, scratch):
    # Q9: text with quotes is data, not SQL; it round-trips through the store.
    from chainsift.operators.store import append_events, read_store, with_ingest_time

    line = '{"block_number":9,"events":[["0xa\'b",{"note":"it\'s \\"quoted\\""}]]}'
    ev = explode_fills(parse_fills(lines_df(spark, [line])))
    path = scratch + "/store"
    append_events(with_ingest_time(ev), path)
    r = read_store(spark, path).select("user", F.try_variant_get("data", "$.note", "string").alias("n")).first()
    assert (r["user"], r["n"]) == ("0xa'b", 'it\'s "quoted"')
