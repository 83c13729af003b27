"""Plan shape regressions: the parse runs once per line, filters reach Parquet, no forced broadcast."""

from helpers import lines_df

from chainsift.operators.explode import explode_fills
from chainsift.operators.membership import whitelisted
from chainsift.operators.parse import parse_fills


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parse_appears_once(spark):
    df = explode_fills(parse_fills(lines_df(spark, ['{"block_number":1,"events":[["0xa",{}]]}'])))
    assert _plan(df).count("parseJson") == 1, _plan(df)


def test_membership_not_forced_to_broadcast(spark, scratch):
    spark.range(200).selectExpr("concat('0x', id) as address", "1.0 as score").write.parquet(scratch + "/wl")
    ev = explode_fills(parse_fills(lines_df(spark, ['{"block_number":1,"events":[["0x1",{}]]}'])))
    wl = spark.read.parquet(scratch + "/wl")
    small = whitelisted(ev, wl)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        # the member-count check broadcasts a small list even when statistics would not
        checked = whitelisted(ev, wl)
        assert "BroadcastHashJoin" in checked._jdf.queryExecution().executedPlan().toString()
        # above the bound nothing forces a broadcast
        big = whitelisted(ev, wl, broadcast_max_rows=0)
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert [r["user"] for r in big.collect()] == ["0x1"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_user_semi_join_is_split(spark):
    """A user holding a third of the events: AQE splits its partition of the shuffled semi-join."""
    from pyspark.sql import functions as F

    ev = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 2000).cast("string"))).alias("user"),
        F.col("id"),
    )
    wl = spark.range(600).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("address")).unionByName(
        spark.createDataFrame([("hot",)], "address string")
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = whitelisted(ev, wl, broadcast_max_rows=0)  # a list too large to broadcast
        n = len(df.collect())  # runs this plan, so its adaptive plan becomes final
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == 10000 + 20000 * 600 // 2000
    assert "SortMergeJoin(skew=true)" in plan
