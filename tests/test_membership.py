"""Whitelist operators."""

from chainsift.operators.membership import (
    whitelist_delta,
    whitelist_merge,
    whitelist_page,
    whitelist_range,
    whitelisted,
)


def wl(spark, n=23):
    return spark.createDataFrame([(f"a{i:03d}", float(i % 4)) for i in range(n)], "address string, score double")


def test_range_bounds(spark):
    w = wl(spark)
    assert whitelist_range(w, 1, 2, lo_open=True).count() == 6
    assert whitelist_range(w, 1, 2).count() == 12
    assert whitelist_range(w, "-inf", "+inf").count() == 23


def test_seek_pages_lose_no_ties(spark):
    w = wl(spark)
    seen, cursor = [], None
    while True:
        p = whitelist_page(w, cursor, 5).collect()
        if not p:
            break
        seen += [r["address"] for r in p]
        cursor = (p[-1]["score"], p[-1]["address"])
    assert sorted(seen) == sorted(r["address"] for r in w.collect()) and len(seen) == len(set(seen))


def test_delta_cursor(spark):
    w = wl(spark)
    d, c = whitelist_delta(w, 1.0, 2.0)
    assert d.count() == 6 and c == 2.0
    d, c = whitelist_delta(w, 3.0, 10.0)
    assert d.count() == 0 and c == 3.0


def test_merge_and_semi_join(spark):
    old = wl(spark, 5)
    delta = spark.createDataFrame([("a001", 9.0), ("zz", 1.0)], "address string, score double")
    m = {r["address"]: r["score"] for r in whitelist_merge(old, delta).collect()}
    assert m["a001"] == 9.0 and m["zz"] == 1.0 and len(m) == 6
    ev = spark.createDataFrame([("a001", 1), ("a001", 2), ("A001", 3), ("nope", 4)], "user string, k int")
    assert sorted(r["k"] for r in whitelisted(ev, delta.unionByName(old)).collect()) == [1, 2]


def test_point_lookup(spark):
    from chainsift.operators.membership import member_score

    w = wl(spark)
    assert [r["score"] for r in member_score(w, "a005").collect()] == [1.0]
    assert member_score(w, "zzz").count() == 0
