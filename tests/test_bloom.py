"""Bloom table properties (A1 J2): no false negatives, false positives near theory."""

import math

from pyspark.sql import functions as F

from chainsift.functions import address
from chainsift.operators.bloom import bloom_build, bloom_members, bloom_merge, bloom_params


def test_params_match_service_sizing():
    assert bloom_params(100_000_000, 0.01) == (958505838, 7)


def test_no_false_negatives_and_fp_bound(spark):
    members = spark.range(1000).select(address("id").alias("address"))
    m, k = 16384, 7
    bits = bloom_build(members, m, k)
    probes = spark.range(20000).select(address("id").alias("user"))
    hits = bloom_members(probes, bits, m, k)
    got = {r["user"] for r in hits.collect()}
    assert {r["address"] for r in members.collect()} <= got
    fp = len(got) - 1000
    theory = 19000 * (1 - math.exp(-k * 1000 / m)) ** k
    assert fp <= 8 * theory + 5  # one 64-bit block per key costs accuracy


def test_incremental_merge_equals_rebuild(spark):
    a = spark.range(0, 300).select(address("id").alias("address"))
    b = spark.range(300, 600).select(address("id").alias("address"))
    m, k = 8192, 5
    merged = {tuple(r) for r in bloom_merge(bloom_build(a, m, k), bloom_build(b, m, k)).collect()}
    whole = {tuple(r) for r in bloom_build(a.unionByName(b), m, k).collect()}
    assert merged == whole
    assert bloom_build(a, m, k).where(F.col("bits") == 0).count() == 0


def test_stored_filter_grows(spark, scratch):
    """Deltas give the filter of all members; past its design fill it is built anew, and never loses a member."""
    from chainsift.operators.bloom import BloomStore, bloom_build, bloom_members, bloom_params

    names = lambda a, b: spark.range(a, b).selectExpr("concat('0x', id) AS address")
    store = BloomStore(spark, scratch + "/bloom", items=200)
    store.add(names(0, 60))
    store.add(names(60, 150))
    want = {tuple(r) for r in bloom_build(names(0, 150), *bloom_params(200)).collect()}
    assert {tuple(r) for r in store.bits().collect()} == want and store.state() == {"version": 2, "items": 200}
    store.add(names(150, 1000), names(0, 1000))
    state = store.state()
    assert state["items"] >= 800
    again = BloomStore(spark, scratch + "/bloom", items=200)
    m, k = again.params()
    assert bloom_members(names(0, 1000).withColumnRenamed("address", "user"), again.bits(), m, k).count() == 1000
    assert bloom_members(names(5000, 15000).withColumnRenamed("address", "user"), again.bits(), m, k).count() < 500
